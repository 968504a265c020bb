"""Prefix joins, seeded columns and threshold sweeps against plain loops."""

import math

from pyspark.sql import functions as F

from lumenfold.functions import draws
from lumenfold.operators import evaluation, relational


def test_starts_with(spark):
    words, prefixes = ["abc", "ab", "a", "", "éa", "xyz", None], ["a", "ab", "", "é", "abcd", None, "ab"]
    w = spark.createDataFrame([(x, 1) for x in words], "w string, n int")
    p = spark.createDataFrame([(x, 2) for x in prefixes], "p string, m int")
    want = sorted((a, b) for a in words for b in prefixes if a is not None and b is not None and a.startswith(b))
    assert sorted((r["w"], r["p"]) for r in relational.starts_with_join(w, p, "w", "p").collect()) == want
    assert relational.starts_with_join(w, p.limit(0), "w", "p").count() == 0


def test_draws_depend_on_keys_alone(spark):
    df = spark.range(4000)
    columns = [draws.uniform(["id"], 1).alias("u"), draws.normal(["id"], 2, 5.0, 3.0).alias("z"), draws.integers(["id"], 3, -2, 3).alias("i"), draws.choice(["id"], 4, ["a", "b"], [3, 1]).alias("c")]
    rows = df.select("id", *columns).orderBy("id").collect()
    assert rows == df.repartition(7).select("id", *columns).orderBy("id").collect()
    u, z = [r["u"] for r in rows], [r["z"] for r in rows]
    assert 0 <= min(u) and max(u) < 1 and abs(sum(u) / 4000 - 0.5) < 0.02
    mean = sum(z) / 4000
    assert abs(mean - 5) < 0.2 and abs(math.sqrt(sum((x - mean) ** 2 for x in z) / 4000) - 3) < 0.15
    assert {r["i"] for r in rows} == {-2, -1, 0, 1, 2} and 0.7 < sum(r["c"] == "a" for r in rows) / 4000 < 0.8


def test_threshold_sweep(spark):
    rows = [("a", "a", 0.1), ("a", "b", 0.2), ("a", "b", 0.6), ("a", "a", None), ("b", "a", 0.3), ("b", None, 0.1)]
    df = spark.createDataFrame(rows, "t string, s string, d double")
    got = {(r["t"], r["threshold"]): (r["tp"], r["tn"], r["fp"], r["fn"], r["far"], r["frr"]) for r in evaluation.threshold_sweep(df, "t", "s", "d", [0.15, 0.5]).collect()}
    for (t, limit), (tp, tn, fp, fn, far, frr) in got.items():
        own = [(s == t, d is not None and d <= limit) for x, s, d in rows if x == t]
        assert (tp, tn, fp, fn) == (own.count((True, True)), own.count((False, False)), own.count((False, True)), own.count((True, False)))
        assert far == (fp / (fp + tn) if fp + tn else None) and frr == (fn / (fn + tp) if fn + tp else None)
    assert len(got) == 4 and evaluation.threshold_sweep(df.filter(F.lit(False)), "t", "s", "d", [1]).count() == 0


def test_many_missing_keys(spark):
    """Every kind of join, with the group of missing keys in a grid and whole, equals plain loops."""
    a = [(i, None if i % 2 else i % 7, None if i % 3 else "x") for i in range(60)]
    b = [(i, None if i % 4 else i % 9, None if i % 5 else "x") for i in range(50)]
    left, right = spark.createDataFrame(a, "n int, k int, l string"), spark.createDataFrame(b, "m int, k int, r string").repartition(3)
    for keys in ([("k", "k")], [("k", "k"), ("l", "r")]):
        own, other = [1, 2][: len(keys)], [1, 2][: len(keys)]
        met = [(x[0], y[0]) for x in a for y in b if [x[i] for i in own] == [y[i] for i in other]]
        lone = [(x[0], None) for x in a if x[0] not in {p for p, _ in met}], [(None, y[0]) for y in b if y[0] not in {q for _, q in met}]
        want = {"inner": met, "left": met + lone[0], "right": met + lone[1], "full": met + lone[0] + lone[1]}
        for how, pairs in want.items():
            for most in (20, 10_000):
                rows = relational.null_safe_join(left, right, keys, how, most)
                assert rows.columns == ["n", "k", "l", "m"] + (["r"] if len(keys) == 1 else [])
                got = rows.collect()
                assert sorted(map(repr, ((r["n"], r["m"]) for r in got))) == sorted(map(repr, pairs))
                key = {**{("a", x[0]): x[1] for x in a}, **{("b", y[0]): y[1] for y in b}}
                assert all(r["k"] == (key["a", r["n"]] if r["n"] is not None else key["b", r["m"]] if how in ("right", "full") else None) for r in got)


def test_full_join_does_not_hold_a_keys_pairs(spark):
    """Spark's own full join keeps all pairs of a key in one task's memory, so the plan has none."""
    ids = spark.range(10).select(F.lit(None).cast("long").alias("k"), "id")
    plan = relational.null_safe_join(ids, ids.withColumnRenamed("id", "other"), [("k", "k")], "full")._jdf.queryExecution().optimizedPlan().toString()
    assert "FullOuter" not in plan
