"""A bounded buffer of each device between those who put frames in and those who take them out, with its overruns.

Events are rows (device, number, kind, frames): a put adds `frames` frames, a take removes as many, if there are.  What
does not fit is dropped and counted.  The level is y = min(y + put, capacity) or max(y - take, 0), so a table at rest is
a scan of clipped sums in blocks; a stream keeps the frames in a ring of `capacity` slots.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import scans

EVENTS = "device string, number long, put long, dropped long, taken long, level long"
COLUMNS = ["device", "number", "put", "dropped", "taken", "level"]


class Ring(StatefulProcessor):
    """Slots of a ring by place, and a value with the place of the oldest frame, the level and the frames ever put."""

    def __init__(self, capacity: int):
        self.capacity = capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.slots = handle.getMapState("slots", "slot int", "frame long")
        self.ends = handle.getValueState("ends", "oldest long, level long, next long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        oldest, level, following = self.ends.get() if self.ends.exists() else (0, 0, 0)
        out = []
        for number, kind, n in pd.concat(list(rows)).sort_values("number")[["number", "kind", "frames"]].itertuples(index=False):
            put = taken = 0
            if kind == "put":
                put = min(int(n), self.capacity - level)
                for i in range(put):
                    self.slots.updateValue(((oldest + level + i) % self.capacity,), (following + i,))
                following += int(n)  # a dropped frame has a number too, so a gap shows where frames are lost
                level += put
            else:
                taken = min(int(n), level)
                oldest, level = (oldest + taken) % self.capacity, level - taken
            out.append((key[0], int(number), put, int(n) - put if kind == "put" else 0, taken, level))
        self.ends.update((oldest, level, following))
        yield pd.DataFrame(out, columns=COLUMNS)


def buffered_stream(events: DataFrame, capacity: int, metric: str = "buffer") -> DataFrame:
    """A stream of events to what each did, with the sums of put, dropped and taken frames as an observed metric."""
    rows = events.select("device", "number", "kind", "frames").groupBy("device")
    out = rows.transformWithStateInPandas(statefulProcessor=Ring(capacity), outputStructType=EVENTS, outputMode="append", timeMode="none")
    return out.observe(metric, *_sums())


def _sums() -> list:
    return [F.sum("put").alias("put"), F.sum("dropped").alias("dropped"), F.sum("taken").alias("taken"), F.max("level").alias("highest")]


def buffered(events: DataFrame, capacity: int, observation: Observation | None = None, order: tuple[str, ...] = ("number",)) -> DataFrame:
    """The same of a table at rest; the rows of a device are many tasks."""
    rows = scans.placed(events.select("device", "number", "kind", "frames", *[c for c in order if c != "number"]), ["device"], list(order))
    n, is_put = F.col("frames"), F.col("kind") == "put"
    # A put never lowers the level and a take never raises it, so both bounds hold for either.
    rows = scans.clipped_scan(rows, ["device"], "place", F.when(is_put, n).otherwise(-n), F.lit(0), F.lit(capacity), "level", "before")
    before = F.coalesce("before", F.lit(0.0))
    put, taken = F.when(is_put, F.col("level") - before).otherwise(0), F.when(is_put, 0).otherwise(before - F.col("level"))
    out = rows.select("device", "number", put.cast("long").alias("put"), F.when(is_put, n - put).otherwise(0).cast("long").alias("dropped"), taken.cast("long").alias("taken"), F.col("level").cast("long").alias("level"))
    return out.observe(observation, *_sums()) if observation is not None else out
