"""Goldens, invariants and batch-against-stream checks of operators that SQL does not cover."""

import numpy as np
from pyspark.sql import functions as F

from lumenfold.functions import scalars as S
from lumenfold.operators import cleaning, evaluation, relational, text, windows
from lumenfold.sources import binary
from lumenfold.sources import text as sources
from lumenfold.streaming import segments as G


def test_joins_of_missing_keys(spark):
    a = spark.createDataFrame([("a", "31"), ("b", None)], "n string, k string")
    b = spark.createDataFrame([("31", "x"), (None, "y"), ("35", "z")], "k string, d string")
    assert relational.null_safe_join(a, b, [("k", "k")]).count() == 2
    full = relational.null_safe_join(a, b, [("k", "k")], "full").collect()
    assert {(r["n"], r["k"], r["d"]) for r in full} == {("a", "31", "x"), ("b", None, "y"), (None, "35", "z")}


def test_clean_strings(spark):
    dirty = ["   Alabama ", "Georgia!", "Georgia", "georgia", "FlOrIda", "south   carolina##", "West virginia?"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(dirty)], "i int, s string")
    out = df.select("i", S.clean_strings(F.col("s"), [S.strip, S.remove_punctuation, S.title]).alias("s")).orderBy("i").collect()
    assert [r["s"] for r in out] == ["Alabama", "Georgia", "Georgia", "Georgia", "Florida", "South   Carolina", "West Virginia"]


def test_duplicates(spark):
    df = spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(zip(["one"] * 3 + ["two"] * 4, [1, 1, 2, 3, 3, 4, 4]))], "k1 string, k2 int, v1 int")
    flags = windows.duplicate_flag(df, ["k1", "k2"], ["v1"]).orderBy("v1").collect()
    assert [r["duplicated"] for r in flags] == [False, True, False, False, True, False, True]
    assert sorted(r["v1"] for r in windows.drop_duplicates(df, ["k1"], ["v1"]).collect()) == [0, 3]
    assert sorted(r["v1"] for r in windows.drop_duplicates(df, ["k1", "k2"], ["v1"], "last").collect()) == [1, 2, 4, 6]


def test_age_bins(spark):
    ages = [20, 22, 25, 27, 21, 23, 37, 31, 61, 45, 41, 32]
    df = spark.createDataFrame([(a,) for a in ages], "a int")
    codes = [r[0] for r in df.select(cleaning.cut_code(F.col("a"), [18, 25, 35, 60, 100])).collect()]
    assert codes == [0, 0, 0, 1, 0, 0, 2, 1, 3, 2, 2, 1]


def test_exact_stratified_sample(spark):
    df = spark.range(100).withColumn("c", F.when(F.col("id") < 40, "Y").otherwise("N"))
    got = {r["c"]: r["count"] for r in cleaning.stratified_sample(df, "c", {"Y": 0.5, "N": 0.1}, ["id"]).groupBy("c").count().collect()}
    assert got == {"Y": 20, "N": 6}
    parts = cleaning.hash_split(df, ["id"], [0.8, 0.2])
    assert sum(p.count() for p in parts) == 100


def test_phone_and_orders(spark):
    lines = ["型号：X1，收件人：甲乙，电话：13800000000，地址：某市某路1号，寄件人：丙", "收件地址：丁，13900000000，某省某县发件人：戊", "nothing"]
    df = spark.createDataFrame([(s,) for s in lines], "s string")
    got = [r["o"] for r in df.select(text.order_record(F.col("s")).alias("o")).collect()]
    assert (got[0]["layout"], got[0]["model"], got[0]["receiver"], got[0]["phone"], got[0]["sender"]) == (1, "X1", "甲乙", "13800000000", "丙")
    assert (got[1]["layout"], got[1]["receiver"], got[1]["phone"], got[1]["address"]) == (2, "丁", "13900000000", "某省某县")
    assert got[2] is None


def test_unrelated_tags(spark):
    df = spark.createDataFrame([(["music", "mus", "art", "modern art", "food"],)], "t array<string>")
    assert df.select(S.add_unrelated_tags(F.col("t"))).first()[0] == ["music", "art", "food"]


def _speech(spark):
    flags = [False] * 30 + [True] * 40 + [False] * 40 + [True] * 3 + [False] * 40 + [True] * 30 + [False] * 60
    return flags, spark.createDataFrame([("d", i, f) for i, f in enumerate(flags)], "device string, frame long, speech boolean")


def test_segments(spark):
    flags, df = _speech(spark)
    got = sorted((r["first"], r["last"]) for r in G.segments_batch(df).collect())
    assert len(got) == 2 and got[0][0] <= 30 <= got[0][1] and got[1][0] <= 153 <= got[1][1] and G.long_enough(G.segments_batch(df), 40).count() == 2


def test_segments_stream_equals_batch(spark, tmp_path):
    _, df = _speech(spark)
    for i, part in enumerate((df.filter("frame < 60"), df.filter("frame >= 60 and frame < 150"), df.filter("frame >= 150"))):
        part.coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = G.segments_stream(source).writeStream.format("memory").queryName("found").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("found").collect())) == sorted(map(tuple, G.segments_batch(df).collect()))


def test_wav_round_trip(spark, tmp_path):
    x = (np.sin(np.arange(2000) / 20) * 9000).round()
    df = spark.createDataFrame([("a", x.tolist()), ("b", x[:100].tolist())], "name string, samples array<double>")
    assert binary.write_wav(df, f"file://{tmp_path}/w").count() == 2
    (tmp_path / "w" / "bad.wav").write_bytes(b"nothing")
    got = {r["path"].rsplit("/", 1)[1]: r for r in binary.read_wav(spark, f"file://{tmp_path}/w").collect()}
    assert got["a.wav"]["samples"] == x.tolist() and got["b.wav"]["n_samples"] == 100 and got["bad.wav"]["error"]


def test_csv_and_matrix(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("something,a,message\none,1,NA\ntwo,2,world\nfoo,,two\n")
    df = sources.read_csv(spark, str(p), "something string, a int, message string", na=["NA"], na_by_column={"something": ["two"]})
    assert [tuple(r) for r in df.collect()] == [("one", 1, None), (None, 2, "world"), ("foo", None, "two")]
    m = tmp_path / "m.csv"
    m.write_text("u1,u2\nY,N\n0.5/0,0.25/1\nX,X\n")
    got = {(r["row"], r["col"]): (r["score"], r["chosen"], r["col_name"]) for r in sources.read_score_matrix(spark, str(m)).collect()}
    assert got == {(0, 0): (0.5, False, "u1"), (0, 1): (0.25, True, "u2")}


def test_imposter_updates(spark):
    s = spark.createDataFrame([(r, c, float(10 * r + c)) for r in range(3) for c in range(3)], "row int, col int, score double")
    new = spark.createDataFrame([(0, 1, 99.0)], "row int, col int, score double")
    gone = spark.createDataFrame([(2,)], "user int")
    got = {(r["row"], r["col"]): (r["score"], r["chosen"]) for r in evaluation.update_imposters(s, new, gone, 1).collect()}
    assert got == {(0, 0): (0.0, False), (0, 1): (99.0, True), (1, 0): (10.0, True), (1, 1): (11.0, False)}
    assert [r["row"] for r in evaluation.confused_users(s).orderBy("row").collect()] == [0, 1]


def test_stratified_draws_repeat_rows_and_skip_strata_without_a_share(spark):
    df = spark.createDataFrame([(i, None if i % 7 == 0 else i % 3) for i in range(100)], "id long, s int")
    size = {r["s"]: r["count"] for r in df.groupBy("s").count().collect()}
    draws = cleaning.stratified_draws(df, "s", {0: 2.0, 1: 0.25}, ["id"], chunk=10).collect()
    assert sorted((r["s"], r["draw"]) for r in draws) == [(0, i) for i in range(2 * size[0])] + [(1, i) for i in range(size[1] // 4)]
    assert len({r["id"] for r in draws if r["s"] == 0}) <= size[0]
    assert cleaning.stratified_draws(df.limit(0), "s", {0: 1.0}, ["id"]).isEmpty()


def test_stratified_sample_is_exact_without_repeats(spark):
    df = spark.createDataFrame([(i, None if i % 7 == 0 else i % 2) for i in range(100)], "id long, s int")
    got = [r["id"] for r in cleaning.stratified_sample(df, "s", {1: 0.5}, ["id"]).collect()]
    assert len(got) == len(set(got)) == df.filter("s = 1").count() // 2 and all(i % 2 for i in got)
