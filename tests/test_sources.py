"""Files written and read back, and the streaming operators over files."""

import gzip
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.operators import relational
from lumenfold.sources import binary
from lumenfold.sources import text as sources
from lumenfold.streaming import segments as G

SF = "/root/testdata/sf0.001"


def test_csv_round_trip(spark, tmp_path):
    nation = spark.read.parquet(f"{SF}/nation.parquet").select("n_nationkey", "n_name")
    sources.write_csv(nation.withColumn("n_name", F.when(F.col("n_nationkey") != 3, F.col("n_name"))), str(tmp_path / "a"), na="NULL", quote_all=True)
    back = sources.read_csv(spark, str(tmp_path / "a"), nation.schema, na=["NULL"])
    assert sorted(map(tuple, back.collect())) == sorted((k, None if k == 3 else n) for k, n in map(tuple, nation.collect()))
    assert sources.read_csv(spark, str(tmp_path / "a"), nation.schema, rows=7).count() == 7
    parts = sources.read_chunks(spark, str(tmp_path / "a"), 3, "n_nationkey", schema=nation.schema)
    assert sum(p.count() for p in parts) == 25
    sources.write_csv(nation, str(tmp_path / "t"), columns=["n_name"], header=False, sep="\t")
    named = sources.read_tsv(spark, str(tmp_path / "t"), header=False, names=["name"])
    assert sorted(r["name"] for r in named.collect()) == sorted(r["n_name"] for r in nation.collect())


@pytest.mark.parametrize("mode,rows", [("drop", 2), ("keep", 3)])
def test_bad_lines(spark, tmp_path, mode, rows):
    (tmp_path / "b.csv").write_text("a,b\n1,2\nx,y,z\n3,4\n")
    df = sources.read_csv(spark, str(tmp_path / "b.csv"), "a int, b int", bad_lines=mode)
    assert len(df.collect()) == rows


def test_json(spark, tmp_path):
    (tmp_path / "d.json").write_text('[{"a": 1, "b": "x", "c": 0}, {"a": 2, "b": "y"}]')
    assert sorted(map(tuple, sources.read_json_array(spark, str(tmp_path / "d.json"), ["a", "b"]).collect())) == [(1, "x"), (2, "y")]
    orders = spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey", "o_totalprice")
    sources.write_json_lines(orders, str(tmp_path / "l"), ["o_orderkey"], 50)
    assert [r[0] for r in spark.read.json(str(tmp_path / "l")).select("o_orderkey").orderBy("o_orderkey").collect()] == [r[0] for r in orders.orderBy("o_orderkey").limit(50).collect()]
    (tmp_path / "r").mkdir()
    for name, body in {"a": '{"id": 1, "text": "t"}', "b": '{"error": "gone"}', "c": "broken"}.items():
        (tmp_path / "r" / name).write_text(body)
    good, bad = sources.read_records(spark, str(tmp_path / "r"), "id int, text string")
    assert [r["id"] for r in good.filter("id is not null").collect()] == [1] and "gone" in [r["error"] for r in bad.collect()]


def test_lines_and_processes(spark, tmp_path):
    (tmp_path / "p").write_text(" 12 0.1 redis port=6379\n 7 0.2 bash\n")
    assert sources.read_lines(spark, str(tmp_path / "p")).count() == 2
    got = sorted(map(tuple, sources.read_process_list(spark, str(tmp_path / "p")).collect()))
    assert [g[0] for g in got] == [7, 12] and [g[2] for g in got] == [None, 6379]


def test_score_matrix_and_matrix(spark, tmp_path):
    scores = spark.createDataFrame([(0, 1, 0.5, True), (1, 0, 0.25, False)], "row int, col int, score double, chosen boolean")
    sources.write_score_matrix(scores, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).exceptAll(scores).count() == 0
    m = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0])], "row int, values array<double>")
    binary.write_matrix(m, str(tmp_path / "m"))
    assert binary.read_matrix(spark, str(tmp_path / "m")).exceptAll(m).count() == 0


def test_idx_and_image_folder(spark, tmp_path):
    x = np.arange(12, dtype=np.uint8).reshape(3, 2, 2)
    (tmp_path / "i").mkdir()
    (tmp_path / "i" / "x.gz").write_bytes(gzip.compress(struct.pack(">HBB3I", 0, 8, 3, 3, 2, 2) + x.tobytes()))
    rows = binary.read_idx(spark, str(tmp_path / "i"), rescale=True).orderBy("index").collect()
    assert np.allclose([r["values"] for r in rows], x.reshape(3, 4) / 255 - 0.5)
    for folder in ("c0", "c7", "other"):
        (tmp_path / "f" / folder).mkdir(parents=True)
        (tmp_path / "f" / folder / "a.jpg").write_bytes(b"123")
    got = {(r["name"], r["length"], r["label"]) for r in binary.image_labels(spark, str(tmp_path / "f"), "*.jpg").collect()}
    assert got == {("a.jpg", 3, 0), ("a.jpg", 3, 7), ("a.jpg", 3, None)}


def test_subset(spark):
    a, b = spark.range(5), spark.range(9)
    assert relational.is_subset(a, b) and not relational.is_subset(b, a)


def stream(spark, df, path):
    df.coalesce(1).write.parquet(str(path))
    return spark.readStream.schema(df.schema).parquet(str(path))


def collected(spark, df, name, path, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(path)).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_running_decisions(spark, tmp_path):
    df = spark.createDataFrame([("a", i, 3.0 if i < 64 else 1.0) for i in range(130)], "device string, frame long, score double")
    got = collected(spark, G.running_decision(stream(spark, df, tmp_path / "in")), "decided", tmp_path / "ck")
    assert sorted(map(tuple, got.collect())) == [("a", 0, 3.0, True), ("a", 1, 1.0, False)]


def test_first_seen_and_counts(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    seen = collected(spark, G.first_seen(stream(spark, e, tmp_path / "a"), "ts", "400 days", ["user_id"]), "seen", tmp_path / "c1")
    assert seen.count() == e.select("user_id").distinct().count()
    counts = collected(spark, G.windowed_counts(stream(spark, e, tmp_path / "b"), "ts", "1 day", "1 day", "event_type"), "counts", tmp_path / "c2", "complete")
    want = e.groupBy(F.window("ts", "1 day"), "event_type").count()
    assert counts.count() == want.count() and counts.agg(F.sum("n")).first()[0] == e.count()


def test_dispatch(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 9)], G.SEGMENT_SCHEMA)
    found = {"enrol": [], "detect": []}
    for mode in found:
        handlers = [lambda b, i, m=m: found[m].extend(b.collect()) for m in ("enrol", "detect")]
        q = G.dispatch(stream(spark, df, tmp_path / mode), *handlers, mode, str(tmp_path / f"ck{mode}")).start()
        q.processAllAvailable()
        q.stop()
    assert len(found["enrol"]) == len(found["detect"]) == 1
