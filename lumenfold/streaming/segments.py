"""Endpoint detection and running decisions over streams of frames."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import scans
from ..session import cut


@dataclass(frozen=True)
class Rules:
    """Counts of frames that drive the phases."""

    context: int = 15
    context_silent: int = 11
    enter: int = 6
    enter_speech: int = 4
    leave: int = 10
    leave_silent: int = 7
    last_silent: int = 2
    trail: int = 15
    trail_silent: int = 11
    pre_roll: int = 10
    most: int = 2000


@dataclass
class State:
    phase: str = "idle"
    alert: list = field(default_factory=list)
    window: list = field(default_factory=list)
    pre: list = field(default_factory=list)
    buffer: list = field(default_factory=list)
    dropped: int = 0


class Segmenter:
    """Idle, entering, speech, leaving, trailing: one frame at a time, one segment out when a phase of silence ends it.

    Works on frame numbers, so that the state stays small: a segment is (first, last) frame.  A segment over `most`
    frames is dropped and counted, so the state is bounded.
    """

    def __init__(self, rules: Rules = Rules(), state: State | None = None):
        self.rules, self.s = rules, state or State()

    def _pre(self, n: int) -> None:
        self.s.pre = [*self.s.pre, n][-self.rules.pre_roll :]

    def _reset(self) -> None:
        dropped = self.s.dropped
        self.s = State(dropped=dropped)

    def step(self, n: int, speech: bool) -> tuple[int, int] | None:
        r, s = self.rules, self.s
        if s.phase == "idle":
            ready = speech and sum(s.alert) > r.context_silent
            s.alert = [*s.alert, int(not speech)][-r.context :]
            if ready:
                s.phase, s.window, s.buffer = "entering", [1], [n]
            else:
                self._pre(n)
        elif s.phase == "entering":
            s.window.append(int(speech))
            if speech:
                s.buffer.append(n)
            else:
                self._pre(n)
            if len(s.window) >= r.enter:
                if sum(s.window) >= r.enter_speech:
                    s.phase, s.window = "speech", []
                else:
                    for b in s.buffer:
                        self._pre(b)
                    s.phase, s.window, s.buffer = "idle", [], []
        elif s.phase in ("speech", "leaving"):
            if len(s.buffer) >= r.most and speech:
                self._reset()
                self.s.dropped += 1
                return None
            if len(s.buffer) < r.most:
                s.buffer.append(n)
            if s.phase == "speech" and not speech:
                s.phase, s.window = "leaving", [1]
            elif s.phase == "leaving":
                s.window.append(int(not speech))
                if len(s.window) >= r.leave:
                    done = sum(s.window) >= r.leave_silent and sum(s.window[-4:]) >= r.last_silent
                    s.phase, s.window = ("trailing" if done else "speech"), []
        else:
            s.window.append(int(not speech))
            s.buffer.append(n)
            if len(s.window) >= r.trail:
                silent = sum(s.window) > r.trail_silent
                out = (min([*s.pre, s.buffer[0]]), s.buffer[-1] - r.leave) if silent else None
                self._reset()
                return out
        return None

    def flush(self) -> tuple[int, int] | None:
        """The open segment at the end of a stream, if wanted."""
        out = (min([*self.s.pre, self.s.buffer[0]]), self.s.buffer[-1]) if self.s.phase not in ("idle", "entering") else None
        self._reset()
        return out


SEGMENT_SCHEMA = "device string, first long, last long"


def segments_batch(frames: DataFrame, rules: Rules = Rules(), flush: bool = False) -> DataFrame:
    """Rows (device, frame, speech) to segments."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("frame")
        g = Segmenter(rules)
        found = [x for n, s in zip(p["frame"].tolist(), p["speech"].tolist()) if (x := g.step(n, s))]
        if flush and (x := g.flush()):
            found.append(x)
        return pd.DataFrame([(p["device"].iloc[0], a, b) for a, b in found], columns=["device", "first", "last"])

    return frames.select("device", "frame", "speech").groupBy("device").applyInPandas(run, SEGMENT_SCHEMA)


BLOCK_SCHEMA = "device string, block long, start string, stop string, dropped int, found array<struct<first:long,last:long>>"


def _dump(g: Segmenter) -> str:
    return json.dumps(asdict(g.s) | {"dropped": 0}, sort_keys=True)


FRESH = _dump(Segmenter())


def segments_in_blocks(frames: DataFrame, rules: Rules = Rules(), flush: bool = False, size: int = 65_536, warm: int = 4_096, stats: dict | None = None) -> DataFrame:
    """The same as `segments_batch`, with the frames of one device in many tasks.

    Frames are cut into blocks of `size` frame numbers.  The machine forgets: after some silence its state does not
    depend on how it began.  So each block first runs over the last `warm` frames before it, starting fresh, and notes
    the state in which it enters and leaves the block.  Where a block's entry is not what the block before it left, it
    runs again from there, until all agree; the first wrong block of a device is right after each round, so the result
    is that of one run from the first frame, whatever the frames are.  Only states, one for each block, go into windows.
    `stats`, if given, gets the number of blocks that each round ran again.
    """
    frames = cut(frames.select(F.col("device").cast("string").alias("device"), F.col("frame").cast("long").alias("frame"), F.coalesce("speech", F.lit(False)).alias("speech")))
    block = F.floor(F.col("frame") / size)

    def over(p: pd.DataFrame, number: int, start: str | None) -> pd.DataFrame:
        p = p.sort_values("frame")
        g = Segmenter(rules, State(**json.loads(start)) if start is not None else None)
        at = int(p["frame"].searchsorted(number * size))
        steps = list(zip(p["frame"].tolist(), p["speech"].tolist()))
        for n, s in steps[:at]:
            g.step(n, s)
        entry, g.s.dropped = _dump(g), 0
        found = [{"first": x[0], "last": x[1]} for n, s in steps[at:] if (x := g.step(n, s))]
        device = None if pd.isna(p["device"].iloc[0]) else p["device"].iloc[0]
        return pd.DataFrame([(device, number, entry, _dump(g), g.s.dropped, found)], columns=["device", "block", "start", "stop", "dropped", "found"])

    def first_run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        own = (p["frame"] >= int(key[1]) * size).any()
        return over(p, int(key[1]), None) if own else pd.DataFrame(columns=["device", "block", "start", "stop", "dropped", "found"])

    def again(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        return over(p, int(key[1]), p["entry"].iloc[0])

    both = F.when(F.pmod(F.col("frame"), F.lit(size)) >= size - warm, F.array(block, block + 1)).otherwise(F.array(block))
    runs = cut(frames.withColumn("block", F.explode(both)).groupBy("device", "block").applyInPandas(first_run, BLOCK_SCHEMA))
    in_order = Window.partitionBy("device").orderBy("block")
    while True:
        entry = F.coalesce(F.lag("stop").over(in_order), F.lit(FRESH))
        wrong = cut(runs.select("device", "block", "start", entry.alias("entry")).filter("start <> entry").drop("start"))
        left = wrong.count()
        if stats is not None:
            stats.setdefault("rounds", []).append(left)
        if not left:
            break
        same = F.col("f.device").eqNullSafe(F.col("w.device")) & (F.col("f.block") == F.col("w.block"))
        redone = frames.withColumn("block", block).alias("f").join(wrong.alias("w"), same).select("f.*", "w.entry").groupBy("device", "block").applyInPandas(again, BLOCK_SCHEMA)
        same = F.col("r.device").eqNullSafe(F.col("w.device")) & (F.col("r.block") == F.col("w.block"))
        runs = cut(runs.alias("r").join(wrong.alias("w"), same, "left_anti").unionByName(redone))
    out = runs.select("device", F.explode("found").alias("s")).select("device", "s.first", "s.last")
    if not flush:
        return out

    def open_ones(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            found = [(d, x) for d, s in zip(p["device"], p["stop"]) if (x := Segmenter(rules, State(**json.loads(s))).flush())]
            yield pd.DataFrame([(d, *x) for d, x in found], columns=["device", "first", "last"])

    last = runs.groupBy("device").agg(F.max_by("stop", "block").alias("stop"))
    return out.unionByName(last.mapInPandas(open_ones, SEGMENT_SCHEMA))


def energy_frames(samples: DataFrame, device: str, order: list[str], value: str, length: int, above: float) -> DataFrame:
    """Rows (device, frame, speech): frames of `length` samples that follow each other, speech where the mean square is
    over `above` times the device's.  The last frame may be shorter; null samples count as silence."""
    rows = scans.placed(samples.select(F.col(device).alias("device"), *[c for c in order if c != device], F.coalesce(value, F.lit(0.0)).alias("_v")), ["device"], order)
    frames = rows.groupBy("device", F.floor(F.col("place") / length).alias("frame")).agg(F.avg(F.col("_v") * F.col("_v")).alias("_e"))
    mean = rows.groupBy("device").agg((F.avg(F.col("_v") * F.col("_v")) * above).alias("_least")).withColumnRenamed("device", "_device")
    return frames.join(mean, F.col("device").eqNullSafe(F.col("_device"))).select("device", "frame", (F.col("_e") > F.col("_least")).alias("speech"))


def segments_stream(frames: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The same over a stream; each micro-batch is put in order of frame number, and the state is a small JSON text."""

    def run(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        g = Segmenter(rules, State(**json.loads(state.get[0])) if state.exists else None)
        p = pd.concat(list(parts)).sort_values("frame")
        found = [x for n, s in zip(p["frame"].tolist(), p["speech"].tolist()) if (x := g.step(int(n), bool(s)))]
        state.update((json.dumps(asdict(g.s)),))
        yield pd.DataFrame([(key[0], a, b) for a, b in found], columns=["device", "first", "last"])

    return frames.select("device", "frame", "speech").groupBy("device").applyInPandasWithState(run, SEGMENT_SCHEMA, "state string", "append", "NoTimeout")


def long_enough(segments: DataFrame, template_frames: int) -> DataFrame:
    """Leave out segments shorter than half a template."""
    return segments.filter((F.col("last") - F.col("first") + 1) * 2 >= template_frames)


def overlapping_windows(events: DataFrame, time: str, length: str, step: str, by: str) -> DataFrame:
    """Sliding windows by time, in batch or with a watermark in a stream."""
    return events.groupBy(by, F.window(time, length, step).alias("w")).agg(F.count("*").alias("n"))


def running_decision(scores: DataFrame, frames: int = 64, above: float = 2.0) -> DataFrame:
    """Stream of (device, frame, score) to one decision for each `frames` frames: device, block, mean, accepted."""

    def run(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        total, n, block = state.get if state.exists else (0.0, 0, 0)
        out = []
        for v in pd.concat(list(parts)).sort_values("frame")["score"]:
            total, n = total + float(v), n + 1
            if n == frames:
                out.append((key[0], block, total / n, total / n > above))
                total, n, block = 0.0, 0, block + 1
        state.update((total, n, block))
        yield pd.DataFrame(out, columns=["device", "block", "mean", "accepted"])

    return scores.groupBy("device").applyInPandasWithState(run, "device string, block long, mean double, accepted boolean", "total double, n long, block long", "append", "NoTimeout")


def dispatch(segments: DataFrame, enrol, detect, mode: str, checkpoint: str):
    """Hand each micro-batch of segments to the enrolment or the detection function."""
    handler = enrol if mode == "enrol" else detect
    return segments.writeStream.foreachBatch(lambda df, batch_id: handler(df, batch_id)).option("checkpointLocation", checkpoint)


def noise_floor(values: DataFrame, by: str, order: str | list[str], value: str, keep: float = 0.998) -> DataFrame:
    """Exponential moving average in order, one row for each key; the rows of a key are many tasks."""
    return scans.last_average(values, [by], [order] if isinstance(order, str) else order, value, keep, "floor")


def windowed_counts(events: DataFrame, time: str, late: str, length: str, by: str) -> DataFrame:
    """Tumbling counts with a watermark: late rows within `late` count, later ones are dropped in a stream."""
    return events.withWatermark(time, late).groupBy(F.window(time, length), by).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, time: str, gap: str, by: str, value: str) -> DataFrame:
    """Session windows: rows of a key that follow each other within `gap`; in a stream after a watermark."""
    return events.groupBy(by, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(by, F.col("w.start").alias("start"), "n", "total")


def stream_join(left: DataFrame, right: DataFrame, key: str, time: str, other_time: str, within: str) -> DataFrame:
    """Rows of two streams with one key whose times are at most `within` apart, the right one later; both need watermarks."""
    near = (F.col(other_time) >= F.col(time)) & (F.col(other_time) <= F.col(time) + F.expr(f"interval {within}"))
    return left.join(right, (left[key] == right[key]) & near).drop(right[key])


def first_seen(events: DataFrame, time: str, late: str, keys: list[str]) -> DataFrame:
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
