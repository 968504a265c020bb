"""Enrolment of users from a stream of frames and commands: start, frames, then confirm or abort, or the time runs out.

Frames of an enrolment are staged in the state of its user, and nothing of them is seen before a confirm; an abort or a
timer drops them.  `models` writes what was confirmed, one folder for each micro-batch, and `current_models` reads the
last model of each user.  `enrolments` gives the same sessions of a table at rest, with the rows of a user in many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import scans

MOST_FRAMES = 500
SESSIONS = "user string, session long, outcome string, frames long, mean array<double>, variance array<double>"
COLUMNS = ["user", "session", "outcome", "frames", "mean", "variance"]
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


class Enrolment(StatefulProcessor):
    """State of a user: the running session, and its frames as a list.

    Commands that do not suit the state are ignored: a start within a session, an end without one.  A session takes at
    most `most` frames, further ones are ignored.  It expires `patience` milliseconds after its start.
    """

    def __init__(self, most: int = MOST_FRAMES, patience: int = 60_000):
        self.most, self.patience = most, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", "number long, frames int, deadline long")
        self.staged = handle.getListState("staged", "frame array<double>")

    def _end(self, user: str, outcome: str) -> tuple:
        number, n, deadline = self.session.get()
        mean = variance = None
        if outcome == "confirmed" and not n:
            outcome = "empty"
        if outcome == "confirmed":
            x = np.array([f[0] for f in self.staged.get()], np.float64)
            mean, variance = x.mean(axis=0).tolist(), x.var(axis=0).tolist()
        self.session.clear()
        self.staged.clear()
        return user, number, outcome, n, mean, variance

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out, events = [], pd.concat(list(rows)).sort_values("number")
        running = self.session.get() if self.session.exists() else None
        fresh = []

        def keep() -> None:
            if running is not None:
                self.session.update(running)
                if fresh:
                    self.staged.appendList([(f,) for f in fresh])
                    fresh.clear()

        for number, kind, at, frame in zip(events["number"].tolist(), events["kind"].tolist(), events["at"], events["frame"]):
            now = int(at.timestamp() * 1000)
            if running is not None and now >= running[2]:
                keep()
                self.handle.deleteTimer(running[2])
                out.append(self._end(key[0], "expired"))
                running = None
            if kind == "start" and running is None:
                running = (number, 0, now + self.patience)
                self.handle.registerTimer(running[2])
            elif kind == "frame" and running is not None and running[1] < self.most:
                fresh.append([float(v) for v in frame])
                running = (running[0], running[1] + 1, running[2])
            elif kind in ("confirm", "abort") and running is not None:
                keep()
                self.handle.deleteTimer(running[2])
                out.append(self._end(key[0], "confirmed" if kind == "confirm" else "aborted"))
                running = None
        keep()
        yield pd.DataFrame(out, columns=COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        over = self.session.exists() and self.session.get()[2] <= expiredTimerInfo.getExpiryTimeInMs()
        yield pd.DataFrame([self._end(key[0], "expired")] if over else [], columns=COLUMNS)


def sessions(events: DataFrame, most: int = MOST_FRAMES, patience: int = 60_000, late: str = "10 seconds") -> DataFrame:
    """A stream of (user, number, kind, at, frame) to one row for each session that ends.

    Kinds are start, frame, confirm and abort; `number` orders the events of a user, `at` is their time.  The stream of
    commands and that of frames may be two, put together by `unionByName`.  Needs the state store of `STATE_STORE`.
    """
    rows = events.select("user", "number", "kind", "at", "frame").withWatermark("at", late)
    return rows.groupBy("user").transformWithStateInPandas(statefulProcessor=Enrolment(most, patience), outputStructType=SESSIONS, outputMode="append", timeMode="eventTime")


def models(ended: DataFrame, path: str, checkpoint: str):
    """A writer of confirmed models: each micro-batch replaces its own folder, so one that is run again leaves one copy."""

    def swap(batch: DataFrame, number: int) -> None:
        found = batch.filter("outcome = 'confirmed'").drop("outcome")
        found.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return ended.writeStream.foreachBatch(swap).option("checkpointLocation", checkpoint)


def current_models(spark: SparkSession, path: str) -> DataFrame:
    """The last confirmed model of each user."""
    rows = spark.read.parquet(path)
    columns = [c for c in rows.columns if c not in ("user", "batch")]
    return rows.groupBy("user").agg(F.max_by(F.struct(*columns), F.struct("batch", "session")).alias("m")).select("user", "m.*")


def enrolments(events: DataFrame, most: int = MOST_FRAMES, order: tuple[str, ...] = ("number",)) -> DataFrame:
    """The sessions of a table (user, number, kind, frame), as `sessions` gives them where none expires.

    Ends before a row are counted by a scan in blocks, so a user's rows are not one task.  The rows between two ends of a
    user hold at most one session: its first start, and the frames after it.  Frames have one number of components.
    """
    rows = scans.placed(events.select("user", "number", "kind", "frame", *[c for c in order if c != "number"]), ["user"], list(order))
    is_end, is_frame = F.col("kind").isin("confirm", "abort"), F.col("kind") == "frame"
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    rows = scans.affine_scan(rows, ["user"], "place", F.lit(1.0), F.array(one(is_end), one(is_frame)), "counts")
    rows = rows.withColumn("part", (F.col("counts")[0] - one(is_end)).cast("long")).withColumn("nth", F.col("counts")[1].cast("long"))
    first = F.min(F.when(F.col("kind") == "start", F.struct("place", "number", "nth")))
    parts = rows.groupBy("user", "part").agg(first.alias("start"), F.max(F.when(is_end, F.struct("place", "kind"))).alias("end"))
    parts = parts.filter("start is not null and end.place > start.place").select(F.col("user").alias("_user"), F.col("part").alias("_part"), "start", "end")
    same = F.col("user").eqNullSafe(F.col("_user")) & (F.col("part") == F.col("_part"))
    staged = rows.filter(is_frame).join(parts, same).filter("place > start.place").filter((F.col("nth") - F.col("start.nth")) <= most)
    cells = staged.select("user", "part", F.posexplode("frame").alias("i", "v")).groupBy("user", "part", "i").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.var_pop("v").alias("variance"))
    stats = cells.groupBy("user", "part").agg(F.max("n").alias("frames"), F.array_sort(F.collect_list(F.struct("i", "mean", "variance"))).alias("c"))
    same = F.col("_user").eqNullSafe(F.col("user")) & (F.col("_part") == F.col("part"))
    out = parts.join(stats, same, "left")
    confirmed = (F.col("end.kind") == "confirm") & F.col("frames").isNotNull()
    outcome = F.when(F.col("end.kind") == "abort", "aborted").when(F.col("frames").isNull(), "empty").otherwise("confirmed")
    each = lambda c: F.when(confirmed, F.transform("c", lambda x: x[c]))
    return out.select(
        F.col("_user").alias("user"), F.col("start.number").alias("session"), outcome.alias("outcome"), F.coalesce("frames", F.lit(0)).cast("long").alias("frames"),
        each("mean").alias("mean"), each("variance").alias("variance"),
    )
