"""Bounded buffers: a table at rest and a stream give the same overruns, by rows and as metrics."""

import random
import time

import pytest
from pyspark.sql import Observation

from lumenfold.streaming import buffers as B
from lumenfold.streaming import enrolment

SCHEMA = "device string, number long, kind string, frames long"


def machine(events, capacity):
    out, levels = [], {}
    for device, number, kind, n in sorted(events, key=lambda e: e[1]):
        level = levels.get(device, 0)
        put = min(n, capacity - level) if kind == "put" else 0
        taken = min(n, level) if kind == "take" else 0
        levels[device] = level + put - taken
        out.append((device, number, put, n - put if kind == "put" else 0, taken, levels[device]))
    return sorted(out)


@pytest.fixture(scope="module")
def events():
    rng = random.Random(2)
    return [(rng.choice("aaaab"), i, rng.choice(["put", "put", "take"]), rng.randint(0, 9)) for i in range(1500)]


def totals(rows):
    return {"put": sum(r[2] for r in rows), "dropped": sum(r[3] for r in rows), "taken": sum(r[4] for r in rows), "highest": max(r[5] for r in rows)}


def test_batch(spark, events):
    seen = Observation("buffer")
    df = spark.createDataFrame(events, SCHEMA).repartition(3)
    got = sorted(map(tuple, B.buffered(df, 20, seen).collect()))
    assert got == machine(events, 20) and seen.get == totals(got) and seen.get["dropped"] > 100
    assert B.buffered(df.limit(0), 20).count() == 0


def test_stream(spark, events, tmp_path):
    for k, v in enrolment.STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        spark.createDataFrame(events[:700], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)  # files are read in order of their times
        spark.createDataFrame(events[700:], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = B.buffered_stream(rows, 20).writeStream.format("memory").queryName("buffered").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
        q.processAllAvailable()
        seen = [p.observedMetrics["buffer"] for p in q.recentProgress if "buffer" in p.observedMetrics]
        q.stop()
        got = sorted(map(tuple, spark.table("buffered").collect()))
        assert got == machine(events, 20)
        assert sum(s["dropped"] or 0 for s in seen) == totals(got)["dropped"] and sum(s["put"] or 0 for s in seen) == totals(got)["put"]
    finally:
        for k in enrolment.STATE_STORE:
            spark.conf.unset(k)
