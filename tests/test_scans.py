"""Recurrences in blocks against loops over all rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.operators import scans, signal
from lumenfold.streaming import segments as G


@pytest.fixture(scope="module")
def series(spark):
    rng = random.Random(6)
    rows = [(k, rng.randrange(10**6), rng.uniform(-5, 5)) for k, n in (("a", 9000), ("b", 1), ("c", 64), ("d", 65), (None, 300)) for _ in range(n)]
    rows = list({(k, o): (k, o, v) for k, o, v in rows}.values())
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "k string, o long, v double").repartition(7)


def by_key(rows):
    out = {}
    for k, o, v in sorted(rows, key=lambda r: r[1]):
        out.setdefault(k, []).append((o, v))
    return out


def test_places(series):
    rows, df = series
    want = {(k, o): i for k, xs in by_key(rows).items() for i, (o, _) in enumerate(xs)}
    assert {(r["k"], r["o"]): r["place"] for r in scans.placed(df, ["k"], ["o"]).collect()} == want
    same = scans.placed(df.withColumn("o", F.lit(1)), ["k"], ["o"]).groupBy("k").agg(F.count_distinct("place").alias("n"), F.max("place").alias("m"), F.count("*").alias("c")).collect()
    assert all(r["n"] == r["c"] == r["m"] + 1 for r in same)
    assert scans.placed(df.limit(0), ["k"], ["o"]).count() == 0


def test_moving_average(series):
    rows, df = series
    want, last = {}, {}
    for k, xs in by_key(rows).items():
        y = None
        for o, v in xs:
            y = v if y is None else y * 0.998 + v * 0.002
            want[k, o] = last[k] = y
    got = scans.moving_average(df.withColumn("y", F.lit("clash")), ["k"], ["o"], "v", 0.998, "y").collect()
    assert len(got) == len(want) and all(abs(r["y"] - want[r["k"], r["o"]]) < 1e-9 for r in got)
    got = G.noise_floor(df, "k", "o", "v").collect()
    assert len(got) == len(last) and all(abs(r["floor"] - last[r["k"]]) < 1e-9 for r in got)


def test_deemphasis_and_changing_factors(series):
    rows, df = series
    got = {(r["k"], r["o"]): r["y"] for r in signal.deemphasised(df, ["k"], ["o"], "v", "y").collect()}
    placed = scans.placed(df, ["k"], ["o"]).withColumn("v", F.when(F.col("place") % 10 != 3, F.col("v")))
    other = {(r["k"], r["o"]): r["y"] for r in scans.affine_scan(placed, ["k"], "place", F.when(F.col("place") % 2 == 0, -0.5).otherwise(1.0), F.col("v"), "y").collect()}
    for k, xs in by_key(rows).items():
        y = z = 0.0
        for i, (o, v) in enumerate(xs):
            y = y * 0.97 + v
            if i % 10 != 3:
                z = z * (-0.5 if i % 2 == 0 else 1.0) + v
            assert abs(got[k, o] - y) < 1e-9 and abs(other[k, o] - z) < 1e-9


def test_vectors(spark):
    x = np.random.default_rng(3).normal(size=(500, 3))
    df = spark.createDataFrame([("u", i, r.tolist()) for i, r in enumerate(x)], "k string, place long, x array<double>")
    got = {r["place"]: r["y"] for r in scans.affine_scan(df, ["k"], "place", F.lit(0.9), F.col("x"), "y").collect()}
    y = np.zeros(3)
    for i, r in enumerate(x):
        y = 0.9 * y + r
        assert np.allclose(got[i], y)


def speech_of(rng, n):
    out = []
    while len(out) < n:
        out += [rng.random() < rng.choice([0.02, 0.9, 0.5])] * 1 if rng.random() < 0.2 else [rng.random() < 0.5] * rng.choice([1, 3, 20, 60])
    return out[:n]


@pytest.mark.parametrize("size, warm", [(64, 16), (500, 300), (37, 0)])
def test_segments_in_blocks(spark, size, warm):
    rng = random.Random(size)
    rows = [(d, n, s) for d, length in (("a", 2500), ("b", 300), ("c", 1)) for n, s in enumerate(speech_of(rng, length))]
    rows += [("gaps", n * 7 + (n > 200) * 5000, s) for n, s in enumerate(speech_of(rng, 400))]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "device string, frame long, speech boolean")
    rules = G.Rules(context=6, context_silent=3, enter=4, enter_speech=3, leave=4, leave_silent=3, trail=4, trail_silent=2, pre_roll=3, most=120)
    for flush in (False, True):
        stats = {}
        got = sorted(map(tuple, G.segments_in_blocks(df, rules, flush, size, warm, stats).collect()))
        assert got == sorted(map(tuple, G.segments_batch(df, rules, flush).collect())) and len(got) > 10
        assert stats["rounds"][-1] == 0
        if not warm:
            assert len(stats["rounds"]) > 1  # without a warm-up the entries are wrong at first
    assert G.segments_in_blocks(df.limit(0), rules, True, size, warm).count() == 0


def test_long_speech_without_silence(spark):
    """A device that never falls silent keeps its state over block ends, so blocks are corrected one after the other."""
    df = spark.range(3000).select(F.lit("x").alias("device"), F.col("id").alias("frame"), (F.col("id") > 40).alias("speech"))
    rules = G.Rules(most=100_000)
    stats = {}
    got = G.segments_in_blocks(df, rules, True, 500, 50, stats).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, G.segments_batch(df, rules, True).collect())) and len(got) == 1
    assert len(stats["rounds"]) > 3


def test_energy_frames(spark):
    rows = [("a", i, None if i == 5 else (9.0 if 40 <= i < 80 else 0.5)) for i in range(118)]
    df = spark.createDataFrame(rows, "d string, o long, v double")
    got = {r["frame"]: r["speech"] for r in G.energy_frames(df, "d", ["o"], "v", 4, 1.0).collect()}
    assert got == {i: 10 <= i < 20 for i in range(30)}
