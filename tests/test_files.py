"""Files by byte offset: chunks of lines, growing files, one file from many tasks."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.sources import files
from lumenfold.sources import text as sources


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rng = random.Random(3)
    path = tmp_path_factory.mktemp("lines")
    all_ = []
    for name in ("a", "b", "c"):
        lines = ["é" * rng.choice([0, 1, 5, 300]) + str(rng.random()) for _ in range(rng.choice([0, 120, 200]))] if name != "c" else ["one", "", "two\r", "last"]
        (path / name).write_text("\n".join(lines) + ("" if name == "c" else "\n" if lines else ""), newline="")
        all_ += [x.removesuffix("\r") for x in lines]
    (path / "_skipped").write_text("no\n")
    (path / "empty").write_text("")
    return path, all_


@pytest.mark.parametrize("size", [1, 7, 1000, 10**9])
def test_each_line_is_in_one_chunk(spark, folder, size):
    path, lines = folder
    rows = files.read_line_chunks(spark, str(path), size if size > 1 else 64).orderBy("chunk", "offset").collect()
    assert [r["line"] for r in rows] == lines
    assert [r["line"] for r in files.head(spark, f"file://{path}", 5, max(size, 64)).collect()] == lines[:5]
    with pytest.raises(ValueError):
        files.local_path("viewfs://store/x")


def test_a_stream_goes_on_after_it_died(spark, tmp_path):
    source, out, check = tmp_path / "in", tmp_path / "out", tmp_path / "ck"
    source.mkdir()
    written = []

    def grow(name, lines, end="\n"):
        with open(source / name, "a") as f:
            f.write("\n".join(lines) + end)

    def run(fail_on=None):
        def put(batch, number):
            if fail_on is not None and number == fail_on:
                raise RuntimeError("the sink died")
            batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

        q = files.stream_lines(spark, str(source), max_bytes=200, bytes_=64).writeStream.foreachBatch(put).option("checkpointLocation", str(check)).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    written += [f"x{i}" for i in range(100)]
    grow("a", written)
    with pytest.raises(Exception):
        run(fail_on=1)
    grow("b", ["y" * 500, "y"])
    written += ["y" * 500, "y"]
    grow("a", ["half a l"], end="")
    run()
    seen = spark.read.parquet(str(out))
    assert sorted(r["line"] for r in seen.collect()) == sorted(written) and seen.select("batch").distinct().count() > 2
    grow("a", ["ine", "z"])
    written += ["half a line", "z"]
    run()
    run()
    assert sorted(r["line"] for r in spark.read.parquet(str(out)).collect()) == sorted(written)


def test_one_file_from_many_tasks(spark, tmp_path):
    rows = spark.range(5000).repartition(7).select("id", F.concat(F.lit("line "), F.repeat(F.lit("é"), (F.col("id") % 9).cast("int"))).alias("line"))
    path = tmp_path / "f"
    files.write_in_order(rows, F.concat("line", F.lit("\n")), ["id"], str(path))
    assert path.read_text() == "".join(f"line {'é' * (i % 9)}\n" for i in range(5000)) and os.listdir(tmp_path) == ["f"]
    broken = rows.withColumn("line", F.when(F.col("id") == 4321, F.raise_error(F.lit("bad row"))).otherwise(F.col("line")))
    with pytest.raises(Exception):
        files.write_in_order(broken, F.col("line"), ["id"], str(path))
    assert path.stat().st_size > 5000 and os.listdir(tmp_path) == ["f"]
    files.write_in_order(rows.limit(0), F.col("line"), ["id"], str(path))
    assert path.read_bytes() == b""


def test_a_failed_writer_leaves_nothing(spark, tmp_path):
    """Rows that change between measuring and writing end the job; the part is removed and the old file stays."""
    spark.dataSource.register(files.OrderedFile)
    (tmp_path / "f").write_text("old")
    df = spark.createDataFrame([(bytearray(b"abc"),)], "data binary").coalesce(1)
    with pytest.raises(Exception):
        df.write.format("ordered_file").mode("append").options(path=str(tmp_path / "f"), part=str(tmp_path / ".p"), starts="[0, 99]").save()
    assert os.listdir(tmp_path) == ["f"] and (tmp_path / "f").read_text() == "old"


def test_score_file(spark, tmp_path):
    people = spark.createDataFrame([(0, "A", True), (1, "B", False), (2, "C", True)], "place int, name string, enabled boolean")
    scores = spark.createDataFrame([(0, 0, 7.9, False), (0, 1, -1.5, True), (0, 2, 1 / 3, True), (2, 0, 0.5, True), (2, 2, 9.0, False), (1, 1, 5.0, True)], "row int, col int, score double, chosen boolean")
    files.write_score_file(scores, people, str(tmp_path / "s.csv"))
    lines = (tmp_path / "s.csv").read_text().splitlines()
    assert lines[:2] == ["A,B,C", "Y,N,Y"] and lines[3] == "X,X,X" and lines[4] == "0.5/1,0.0/0,9.0/0"
    back = sources.read_score_matrix(spark, str(tmp_path / "s.csv")).select("row", "col", "score", "chosen")
    want = [r for r in scores.collect() if r["row"] != 1]
    assert sorted(map(tuple, back.filter("not (row = 2 and col = 1)").collect())) == sorted(map(tuple, want))


@pytest.mark.parametrize("code", [0, 1, 2, 3])
def test_matrix_file(spark, tmp_path, code):
    x = np.arange(60).reshape(20, 3) * (0.25 if code == 3 else 1) - 5
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x.astype(float))], "row long, values array<double>").repartition(4)
    files.write_matrix_file(df, str(tmp_path / "m"), code)
    got = files.read_matrix_file(spark, str(tmp_path / "m"), 100).orderBy("row").collect()
    assert np.array_equal([r["values"] for r in got], x) and [r["row"] for r in got] == list(range(20))
    raw = (tmp_path / "m").read_bytes()
    assert files.HEADER.unpack(raw[:12]) == (code, 20, 3) and np.array_equal(np.frombuffer(raw[12:], files.MATRIX_TYPES[code]).reshape(20, 3), x)


def test_columnar_formats(spark, tmp_path):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
    assert files.copy_as(orders, str(tmp_path / "o"), "orc", compression="zstd").exceptAll(orders).count() == 0


def test_csv_in_chunks(spark, tmp_path):
    for part in range(2):
        (tmp_path / f"{part}.csv").write_text("id,name\n" + "".join(f"{part * 500 + i},n{i % 7}\n" for i in range(500)))
    whole = sources.read_csv_chunks(spark, str(tmp_path), "id int, name string", 1000)
    counts = whole.groupBy("chunk").count().collect()
    assert len(counts) >= 8 and sum(r["count"] for r in counts) == 1000
    assert [r["id"] for r in whole.orderBy("chunk", "offset").collect()] == list(range(1000))
    assert [r["id"] for r in sources.read_csv(spark, str(tmp_path), "id int, name string", rows=3, order=["id"]).collect()] == [0, 1, 2]
