"""Enrolment on streams, with restarts and timers, and the same sessions of a table."""

import datetime as dt
import random

import pytest

from lumenfold.streaming import enrolment as E

SCHEMA = "user string, number long, kind string, at timestamp, frame array<double>"
START = dt.datetime(2024, 1, 1)


def event(user, number, kind, seconds, frame=None):
    return user, number, kind, START + dt.timedelta(seconds=seconds), frame


class Feed:
    """A folder of Parquet files that a stream reads, and its query, which may be ended and begun again."""

    def __init__(self, spark, folder, **options):
        self.spark, self.folder, self.options, self.files = spark, folder, options, 0
        (folder / "in").mkdir(parents=True)

    def put(self, *events):
        self.files += 1
        self.spark.createDataFrame(list(events), SCHEMA).coalesce(1).write.mode("append").parquet(str(self.folder / "in"))

    def run(self):
        rows = self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(self.folder / "in"))
        q = E.models(self.ended(rows), str(self.folder / "models"), str(self.folder / "check")).start()
        q.processAllAvailable()
        q.stop()

    def ended(self, rows):
        return E.sessions(rows, **self.options)

    def models(self):
        return {r["user"]: (r["session"], r["frames"], r["mean"], r["variance"]) for r in E.current_models(self.spark, str(self.folder / "models")).collect()}


@pytest.fixture(scope="module", autouse=True)
def store(spark):
    before = {k: spark.conf.get(k, None) for k in E.STATE_STORE}
    for k, v in E.STATE_STORE.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_confirm_abort_timeout_and_restart(spark, tmp_path):
    feed = Feed(spark, tmp_path, most=3, patience=60_000)
    feed.put(event("a", 1, "start", 0), event("a", 2, "frame", 1, [1.0, 2.0]), event("b", 1, "start", 0), event("b", 2, "frame", 1, [5.0, 5.0]), event("c", 1, "frame", 1, [9.0, 9.0]))
    feed.run()
    assert feed.models() == {}  # staged frames are not seen
    # The query begins again from its checkpoint with the staged frames.
    feed.put(event("a", 3, "frame", 2, [3.0, 4.0]), event("a", 4, "start", 3), event("a", 5, "confirm", 4), event("b", 3, "abort", 4), event("c", 2, "confirm", 5))
    feed.run()
    assert feed.models() == {"a": (1, 2, [2.0, 3.0], [1.0, 1.0])}
    # A new session replaces the model only when it is confirmed; at most three frames count.
    feed.put(event("a", 6, "start", 10), *[event("a", 7 + i, "frame", 11, [float(i), 0.0]) for i in range(5)])
    feed.run()
    assert feed.models()["a"][0] == 1
    feed.put(event("a", 20, "confirm", 12), event("d", 1, "start", 12), event("d", 2, "frame", 13, [1.0, 1.0]))
    feed.run()
    assert feed.models() == {"a": (6, 3, [1.0, 0.0], [2 / 3, 0.0])}
    # d never ends: its session expires when the watermark passes, and a late confirm finds nothing.
    feed.put(event("z", 1, "start", 500))
    feed.run()
    feed.put(event("d", 3, "confirm", 501), event("z", 2, "abort", 502))
    feed.run()
    assert set(feed.models()) == {"a"}


def machine(events, most):
    """One event after the other."""
    out, state = [], {}
    for user, number, kind, _, frame in sorted(events, key=lambda e: e[1]):
        s = state.get(user)
        if kind == "start" and s is None:
            state[user] = (number, [])
        elif kind == "frame" and s is not None and len(s[1]) < most:
            s[1].append(frame)
        elif kind in ("confirm", "abort") and s is not None:
            outcome = "aborted" if kind == "abort" else "confirmed" if s[1] else "empty"
            mean = variance = None
            if outcome == "confirmed":
                mean = [sum(c) / len(c) for c in zip(*s[1])]
                variance = [sum((x - m) ** 2 for x in c) / len(c) for c, m in zip(zip(*s[1]), mean)]
            out.append((user, s[0], outcome, len(s[1]), mean, variance))
            del state[user]
    return out


def near(rows):
    r = lambda x: x and [round(v, 6) for v in x]
    return sorted(((*row[:4], r(row[4]), r(row[5])) for row in rows), key=repr)


def test_batch_and_stream_give_the_same_sessions(spark, tmp_path):
    rng = random.Random(9)
    events = [event(rng.choice(["u", "u", "v", "w"]), i, rng.choice(["start", "confirm", "abort", *["frame"] * 6]), 0, None) for i in range(900)]
    events = [(*e[:4], [rng.random(), rng.random()] if e[2] == "frame" else None) for e in events]
    want = near(machine(events, 4))
    df = spark.createDataFrame(events, SCHEMA).repartition(3)
    assert near(map(tuple, E.enrolments(df, 4).collect())) == want and len(want) > 40
    assert E.enrolments(df.limit(0)).count() == 0
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    q = E.sessions(rows, 4).writeStream.format("memory").queryName("enrolled").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert near(map(tuple, spark.table("enrolled").collect())) == want
