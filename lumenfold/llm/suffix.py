"""Repeated passages by prefix doubling over sampled positions.

A byte goes if a string of `width` bytes (200) that covers it starts anywhere else.  Ranking every position of a corpus
in every round would write many times the input, so the positions are sampled: in each window of `width` bytes the one
with the least hash is its anchor, and equal windows have equal anchors.  About one position in 65 stays, and it answers
for the `reach` windows (160 at most) that begin up to `reach` - 1 bytes before it.

Positions are ranked by longer and longer strings, and Spark counts the (position, rank) pairs:

1. The first rank is that of the `core` bytes (41) at the anchor, which all of its windows hold.  Where it is unique, no
   window repeats, and the position leaves.
2. The bytes of all its windows together are its span.  Where the span repeats, all windows do, and the position is
   settled; one position stays for each span, for others to be compared with.
3. In a round every position in a large group gives two with half the reach: one whose string goes on to the right, one
   whose string goes on to the left.  The new rank is that of the pair (old rank, bytes at the offset).  Unique ranks
   leave, repeated spans are settled.  After at most eight rounds strings have `width` bytes and are past the threshold.
4. Groups of at most `group` positions need no more rounds: their windows are compared with each other in one task.

All choices depend on content alone, so the result is exact but for collisions of 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .bpe import text_slices
from .common import drop_table, save, small_batches

WIDTH = 200
CORE = 41
GROUP = 512
CHUNK = 1 << 18
_POS = np.uint64(24)
_MASK = np.uint64((1 << 24) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return x * np.uint64(0xBF58476D1CE4E5B9)


def _windows_min(buf: np.ndarray, reach: int) -> np.ndarray:
    """For each start the leftmost position, among `reach`, of the least hash of the next 8 bytes."""
    n = len(buf)
    padded = np.concatenate([buf, np.zeros(16, np.uint8)])
    grams = np.empty(n, np.uint64)
    for o in range(min(8, n)):
        part = grams[o::8]
        part[:] = padded[o : o + 8 * len(part)].view("<u8")
    best = ((_mix(grams) >> _POS) << _POS) | np.arange(n, dtype=np.uint64)
    size = 1
    while size * 2 <= reach:
        np.minimum(best[:-size], best[size:], out=best[:-size])
        size *= 2
    rest = reach - size
    return np.minimum(best[: n - rest], best[rest:]) if rest else best


def anchors(data: bytes, width: int = WIDTH, core: int = CORE) -> np.ndarray:
    """Anchor positions of one text."""
    reach, out = width - core + 1, []
    for a in range(0, len(data) - width + 1, CHUNK):
        buf = np.frombuffer(data, np.uint8)[a : a + CHUNK + width - 1]
        best = _windows_min(buf, reach)[: len(buf) - width + 1]
        at = (best & _MASK).astype(np.int64) + a
        out.append(at[np.concatenate([[True], at[1:] != at[:-1]])])
    if not out:
        return np.empty(0, np.int64)
    at = np.concatenate(out)
    return at[np.concatenate([[True], at[1:] != at[:-1]])]


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _ranks(width: int, core: int):
    reach = width - core + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            for part in text_slices(batch):
                rows: list[tuple[int, np.ndarray]] = []
                keys, spans = [], []
                for i, data in enumerate(part.column("text").cast(pa.binary()).to_pylist()):
                    if len(data) < width:
                        continue
                    at = anchors(data, width, core)
                    rows.append((i, at))
                    n = len(data)
                    for p in at.tolist():
                        keys.append(digest(data[p : p + core]))
                        # Cut at a text's ends: how much is missing belongs to the rank.
                        left, right = p - reach + 1, p + width
                        if left >= 0 and right <= n:
                            spans.append(digest(data[left:right]))
                        else:
                            spans.append(digest(data[max(left, 0) : right], seed=1 + max(0, -left) * 1000 + max(0, right - n)))
                if not rows:
                    continue
                row = np.repeat([r[0] for r in rows], [len(r[1]) for r in rows])
                at = pa.array(np.concatenate([r[1] for r in rows]), pa.int32())
                yield pa.RecordBatch.from_arrays([_signed(keys), _signed(spans), part.column("doc").take(pa.array(row)), at], ["key", "span", "doc", "pos"])

    return run


def _contexts(width: int, core: int):
    """Rows (text, list of positions) to one row per position with the bytes of all its windows."""
    reach = width - core + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, places in zip(*(batch.column(c).to_pylist() for c in ("doc", "text", "places"))):
                data = text.encode()
                for x in places:
                    p = x["pos"]
                    left = min(p, reach - 1)
                    out.append((x["key"], x["subject"], x["large"], doc, p, left, data[p - left : p + width]))
            for a in range(0, len(out), 2000):
                some = out[a : a + 2000]
                types = [pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in some], t) for i, t in enumerate(types)], ["key", "subject", "large", "doc", "pos", "left", "around"])

    return run


def _halves(width: int, reach: int):
    """Each position to those of half its reach: the string grows to the right, or the position and the string to the left."""
    half = (reach + 1) // 2
    step, size = reach - half, width - reach + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            out = []
            for i, (key, left, x) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("key", "left", "around")))):
                for shift in (0, step) if step else (0,):
                    # Windows back from the new position: from `first`, what the text's end leaves, to `most`.
                    at = left - shift
                    first, most = max(0, at + width - len(x)), min(at, half - 1)
                    if first > most:
                        continue
                    grown = x[at : at + step] if shift else x[at + size : at + size + step]
                    rank = digest(grown, seed=(key * 2 + bool(shift)) % 2**64)
                    out.append((i, rank, digest(x[at - most : at - first + width], seed=first * 1000 + most), -shift, most, x[at - most : at + width]))
            at = pa.array([r[0] for r in out], pa.int64())
            doc, pos, subject = (batch.column(c).take(at) for c in ("doc", "pos", "subject"))
            moved = pa.array(pos.to_numpy() + np.array([r[3] for r in out], np.int64))
            new = [_signed([r[1] for r in out]), _signed([r[2] for r in out]), doc, moved, subject, pa.array([r[4] for r in out], pa.int32()), pa.array([r[5] for r in out], pa.binary())]
            yield pa.RecordBatch.from_arrays(new, ["key", "span", "doc", "pos", "subject", "left", "around"])

    return run


def _repeats(keys: np.ndarray, around: list[bytes], left: np.ndarray, width: int, reach: int) -> np.ndarray:
    """rows x windows: whether another row with the same key has the same window, counted back from the position."""
    core, n = width - reach + 1, len(keys)
    table = np.zeros((n, reach - 1 + width), np.uint8)
    for i, (a, x) in enumerate(zip(left.tolist(), around)):
        table[i, reach - 1 - a : reach - 1 - a + len(x)] = np.frombuffer(x, np.uint8)
    right = np.array([len(x) for x in around]) - left
    mix = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64)
    powers = np.multiply.accumulate(np.full(reach, 0x9E3779B97F4A7C15, np.uint64))
    hl = np.cumsum(mix[table[:, reach - 2 :: -1] if reach > 1 else table[:, :0]] * powers[: reach - 1], axis=1)
    hr = np.cumsum(mix[table[:, reach - 1 + core :]] * powers[: reach - 1], axis=1)
    base = _mix(keys.view(np.uint64))
    out = np.zeros((n, reach), bool)
    for a in range(reach):
        code = base.copy()
        if a:
            code += hl[:, a - 1] * np.uint64(0xD6E8FEB86659FD93)
        if a < reach - 1:
            code += hr[:, reach - 2 - a] * np.uint64(0xA0761D6478BD642F)
        rows = np.flatnonzero((left >= a) & (right >= width - a))
        if len(rows) < 2:
            continue
        order = rows[np.argsort(code[rows], kind="stable")]
        same = code[order][1:] == code[order][:-1]
        out[order[1:][same], a] = True
        out[order[:-1][same], a] = True
    return out


def _runs(flags: np.ndarray, pos: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first byte and end of the bytes that each run of repeated windows covers."""
    edge = np.diff(np.pad(flags.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, first = np.nonzero(edge == 1)
    _, stop = np.nonzero(edge == -1)
    return row, pos[row] - (stop - 1), pos[row] - first + width


INTERVALS = "doc long, start long, stop long"


def _local(width: int):
    def settle(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        reaches = batch.column("reach").to_numpy()
        for reach in np.unique(reaches).tolist():
            part = batch.filter(pa.array(reaches == reach))
            keys, left, pos = (part.column(c).to_numpy() for c in ("key", "left", "pos"))
            flags = _repeats(keys, part.column("around").to_pylist(), left.astype(np.int64), width, reach)
            flags[~part.column("subject").to_numpy(zero_copy_only=False)] = False
            row, start, stop = _runs(flags, pos, width)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([part.column("doc").take(at), pa.array(start), pa.array(stop)], ["doc", "start", "stop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            rows += len(batch)
            key = batch.column("key").to_numpy()
            last = int(np.searchsorted(key, key[-1]))  # the last group may go on in the next batch
            if rows >= 4000 and last:
                for table in pa.Table.from_batches([*held[:-1], batch.slice(0, last)]).combine_chunks().to_batches():
                    yield from settle(table)
                held = [batch.slice(last)]
                rows = len(held[0])
        if held:
            for table in pa.Table.from_batches(held).combine_chunks().to_batches():
                yield from settle(table)

    return run


def repeated_spans(docs: DataFrame, width: int = WIDTH, core: int = CORE, group: int = GROUP) -> DataFrame:
    """doc, parts: byte ranges (start, stop), which may overlap, that strings occurring elsewhere cover.

    `docs` has doc (long, different in all rows) and text, without nulls.
    """
    reach = width - core + 1
    pos = F.col("pos").cast("long")
    ranks = save(docs.mapInArrow(_ranks(width, core), "key long, span long, doc long, pos int"), "ranks")
    shared = save(ranks.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "shared")
    live = save(ranks.join(shared, "key"), "live")
    drop_table(ranks)
    drop_table(shared)

    spans = save(live.groupBy("key", "span").agg(F.count("*").alias("n"), F.min(F.struct("doc", "pos")).alias("first")), "spans")
    settled = live.join(spans.filter("n > 1").select("key", "span"), ["key", "span"]).select("doc", F.greatest(pos - reach + 1, F.lit(0)).alias("start"), (pos + width).alias("stop"))
    settled = save(settled.groupBy("doc").agg(F.collect_list(F.struct("start", "stop")).alias("parts")), "settled")
    drop_table(live)
    # Each different span has one position left, in the groups in which some span is not settled; that one is a subject.
    sizes = spans.groupBy("key").agg(F.count("*").alias("size"), F.count_if(F.col("n") == 1).alias("subjects")).filter("size > 1 and subjects > 0")
    sizes = save(sizes.select("key", "size"), "sizes")
    speakers = spans.join(sizes, "key").select("key", "first.*", (F.col("n") == 1).alias("subject"), (F.col("size") > group).alias("large"))
    places = speakers.select("doc", F.struct("key", pos.alias("pos"), "subject", "large").alias("place")).groupBy("doc").agg(F.collect_list("place").alias("places"))
    fields = "key long, subject boolean, large boolean, doc long, pos long, left int, around binary"
    now = save(docs.join(places, "doc").mapInArrow(_contexts(width, core), fields), "around")
    drop_table(spans)
    drop_table(sizes)

    where, columns = F.struct("doc", "pos"), ["key", "doc", "pos", "subject", "left", "around"]
    small, found, tables = [now.filter("not large").select(*columns, F.lit(reach).alias("reach"))], [], [now]
    while reach > 1 and not now.filter("large").isEmpty():
        halved = now.filter("large").mapInArrow(_halves(width, reach), "key long, span long, doc long, pos long, subject boolean, left int, around binary")
        reach = (reach + 1) // 2
        halved = save(halved, "halved")
        by_span = save(halved.groupBy("key", "span").agg(F.count("*").alias("n"), F.min(where).alias("first"), F.bool_or("subject").alias("subject")), "by_span")
        equal = halved.filter("subject").join(by_span.filter("n > 1").select("key", "span"), ["key", "span"])
        found.append(save(equal.select("doc", F.greatest(F.col("pos") - reach + 1, F.lit(0)).alias("start"), (F.col("pos") + width).alias("stop")), "found"))
        sizes = by_span.groupBy("key").agg(F.count("*").alias("size"), F.count_if(F.col("subject") & (F.col("n") == 1)).alias("subjects"))
        sizes = save(sizes.filter("size > 1 and subjects > 0").select("key", "size"), "sizes")
        stay = by_span.join(sizes, "key").select("key", "span", "first", (F.col("n") == 1).alias("lone"), (F.col("size") > group).alias("large"))
        now = halved.join(stay, ["key", "span"]).filter(where == F.col("first")).withColumn("subject", F.col("subject") & F.col("lone"))
        now = save(now.select(*columns, "large"), "around")
        for table in (halved, by_span, sizes):
            drop_table(table)
        small.append(now.filter("not large").select(*columns, F.lit(reach).alias("reach")))
        tables.append(now)

    cool = reduce(DataFrame.unionByName, small).repartition("key").sortWithinPartitions("key")
    found.append(save(cool.mapInArrow(_local(width), INTERVALS), "found"))
    for table in tables:
        drop_table(table)
    one = reduce(DataFrame.unionByName, found).groupBy("doc").agg(F.collect_list(F.struct("start", "stop")).alias("parts"))
    return settled.unionByName(one)


def _merge(parts, n: int) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((max(p["start"], 0), min(p["stop"], n)) for p in parts):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


NEW = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept": pa.binary()}


def without_repeats(docs: DataFrame, width: int = WIDTH, core: int = CORE, group: int = GROUP) -> DataFrame:
    """Add n_bytes, n_removed, n_spans (maximal removed runs) and kept (binary, the remaining bytes) to every row.

    `docs` needs doc_id and text; of its further columns those of the names above are replaced and all others kept.  A
    null text counts as empty.  Repeated rows, with or without an id, count as occurrences of each other, so a text of
    at least `width` bytes that occurs twice goes whole; shorter ones stay.
    """
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    names = [c for c in docs.columns if c.lower() not in NEW]
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.xxhash64("doc_id", text).alias("doc"), text.alias("text"))
    size = F.octet_length("text").cast("long")
    # Rows equal in id and text are one text, which goes whole; it is looked up once, so copies are no work.
    copies = save(keyed.groupBy("doc").agg(F.count("*").alias("n"), F.max(size).alias("stop")).filter("n > 1").select("doc", "stop"), "copies")
    once = keyed.select("doc", "text")
    if not copies.isEmpty():
        once = once.join(copies, "doc", "left_anti").unionByName(once.join(copies, "doc", "left_semi").dropDuplicates(["doc"]))
    whole = copies.filter(F.col("stop") >= width).select("doc", F.array(F.struct(F.lit(0).cast("long").alias("start"), "stop")).alias("parts"))
    spans = repeated_spans(once, width, core, group).unionByName(whole).groupBy("doc").agg(F.flatten(F.collect_list("parts")).alias("parts"))
    joined = keyed.join(spans, "doc", "left").select("row", F.when(F.col("parts").isNotNull(), F.col("text")).alias("text"), size.alias("n"), "parts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data, n, parts in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("n").to_pylist(), batch.column("parts").to_pylist()):
                runs = _merge(parts or (), n)
                edges = [0, *(x for r in runs for x in r), n]
                out.append((n, sum(b - a for a, b in runs), len(runs), None if data is None else b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))))
            new = [pa.array([r[i] for r in out], t) for i, t in enumerate(NEW.values())]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *new], ["row", *NEW])

    new = [StructField(c, BinaryType() if c == "kept" else LongType()) for c in NEW]
    done = joined.mapInArrow(cut, StructType([joined.schema["row"], *new]))
    whole = F.coalesce(F.col("row.text"), F.lit("")).cast("binary")
    return done.select(*[F.col(f"row.`{c}`").alias(c) for c in names], "n_bytes", "n_removed", "n_spans", F.coalesce("kept", whole).alias("kept"))


def repeat_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the SHA-256 of the kept bytes."""
    out = without_repeats(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
