"""Periodic runs of words by the branching-tandem test on an enhanced suffix array.

A run is a stretch of words with smallest period q, at least max(least, 2 q) long, that no neighbouring word extends.
The words of a batch of texts become numbers that differ between texts, so one suffix array serves the whole batch and no
two texts share a prefix:

1. Suffixes are ordered by prefix doubling; after a round only the groups that are still tied are sorted again.
2. LCP values are compared word by word only where the word before differs (their sum is small); the others follow from
   the place before them.
3. A run starts at a suffix whose neighbour in the order shares least / 2 words, so only the places near such suffixes
   are kept, and the LCP intervals are those of the kept suffixes.
4. In each interval of depth d the suffixes of the smaller side of a split look up ISA[i + d] and ISA[i - d].  If that is
   on the other side, a square of period d ends where its run ends.
5. A square is rotated to the left as far as the words agree, which gives the run.  Squares of one end are taken by
   growing period, and a run removes the squares whose period is a multiple of its own.

The work on one text is O(n log n), and it has to fit in one task: about 100 bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .bpe import text_slices

LEAST = 12
SLAB = 1 << 21  # elements of one vector step

RUN = StructType([StructField(c, LongType()) for c in ("start", "length", "period")])
NEW = {"n_words": LongType(), "runs": ArrayType(RUN), "collapsed": StringType()}


def _ragged(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row number and place within its row for rows of these sizes."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _slabs(sizes: np.ndarray) -> Iterator[slice]:
    """Consecutive slices whose sizes add up to about SLAB."""
    group = (np.cumsum(sizes) - sizes) // SLAB
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
    return (slice(a, b) for a, b in zip(edges, edges[1:]) if b > a)


def _common(words: np.ndarray, a: np.ndarray, b: np.ndarray, room: np.ndarray, step: int) -> np.ndarray:
    """How many words from `a` on (to the left for step -1) equal those from `b` on, at most `room`."""
    out, size = np.zeros(len(a), np.int64), 8
    alive = np.flatnonzero(room > 0)
    while len(alive):
        going = []
        take = np.minimum(size, room[alive] - out[alive])
        for part in _slabs(take):
            rows, sizes = alive[part], take[part]
            row, at = _ragged(sizes)
            at = step * (at + out[rows][row])
            differs = words[a[rows][row] + at] != words[b[rows][row] + at]
            first = np.minimum.reduceat(np.where(differs, np.arange(len(row)), len(row)), np.cumsum(sizes) - sizes) - (np.cumsum(sizes) - sizes)
            got = np.minimum(first, sizes)
            out[rows] += got
            going.append(rows[(got == sizes) & (out[rows] < room[rows])])
        alive, size = np.concatenate(going), min(size * 2, 1 << 16)
    return out


def suffix_array(codes: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and its inverse; the suffix at i ends at stop[i], and no code occurs in two texts."""
    n = len(codes)
    sa = np.argsort(codes, kind="stable")
    fresh = np.concatenate([[True], codes[sa][1:] != codes[sa][:-1]])
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    tied = np.flatnonzero(~(fresh & np.concatenate([fresh[1:], [True]])))
    width = 1
    while len(tied):
        at = sa[tied]
        further = at + width
        second = np.where(further < stop[at], rank[np.minimum(further, n - 1)] + 1, 0)
        pair = rank[at] * (n + 1) + second
        order = np.argsort(pair, kind="stable")
        at, pair = at[order], pair[order]
        sa[tied] = at
        fresh = np.concatenate([[True], pair[1:] != pair[:-1]])
        rank[at] = np.maximum.accumulate(np.where(fresh, tied, 0))
        tied = tied[~(fresh & np.concatenate([fresh[1:], [True]]))]
        width *= 2
    return sa, rank


def _lcp(codes: np.ndarray, first: np.ndarray, stop: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """LCP with the suffix before in the order: by place in the text, and by place in the order."""
    n = len(codes)
    before = np.full(n, -1)
    before[sa[1:]] = sa[:-1]
    before[(before >= 0) & (first[before] != first)] = -1
    i = np.arange(n)
    follows = (i > first) & (before > first)
    follows[follows] = codes[i[follows] - 1] == codes[before[follows] - 1]
    follows[1:] &= before[:-1] >= 0
    alone = np.flatnonzero(~follows)
    other = before[alone]
    known = np.zeros(n, np.int64)
    known[alone] = _common(codes, alone, np.maximum(other, 0), np.where(other >= 0, np.minimum(stop[alone] - alone, stop[other] - other), 0), 1)
    source = np.maximum.accumulate(np.where(follows, 0, i))
    by_text = known[source] - (i - source)
    return by_text, by_text[sa]


def _smaller(values: list[int]) -> tuple[list[int], list[int]]:
    """For each place the last place before with a value no larger, and the next one with a smaller value."""
    before, after, stack = [0] * len(values), [len(values)] * len(values), []
    for i, v in enumerate(values):
        while stack and values[stack[-1]] > v:
            after[stack.pop()] = i
        before[i] = stack[-1] if stack else 0
        stack.append(i)
    return before, after


def _tandems(codes: np.ndarray, first: np.ndarray, stop: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and period of every branching square that a run of at least `least` words can hold."""
    none = np.empty(0, np.int64), np.empty(0, np.int64)
    n = len(codes)
    sa, isa = suffix_array(codes, stop)
    by_text, lcp = _lcp(codes, first, stop, sa)
    shared = np.maximum(by_text, np.append(lcp[1:], 0)[isa])
    heads = np.flatnonzero(shared >= (least + 1) // 2)
    if not len(heads):
        return none
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, heads, 1)
    np.add.at(edge, np.minimum(heads + shared[heads] + 1, stop[heads]), -1)
    held = np.cumsum(edge[:-1]) > 0
    slots = np.flatnonzero(held[sa])
    place = sa[slots]
    slot_of = np.full(n, -1)
    slot_of[place] = np.arange(len(place))
    depth = np.zeros(len(slots), np.int64)
    if len(slots) > 1:
        depth[1:] = np.minimum.reduceat(lcp[: slots[-1] + 1], slots[:-1] + 1)
    before, after = (np.array(x, np.int64) for x in _smaller(depth.tolist()))
    node = np.flatnonzero(depth > 0)
    left, right, d = before[node], after[node], depth[node]
    near = node - left <= right - node  # the smaller side is the left one
    begin, size = np.where(near, left, node), np.where(near, node - left, right - node)
    low, high = np.where(near, node, left), np.where(near, right, node)  # the other side
    starts, periods = [], []
    for part in _slabs(size):
        row, at = _ragged(size[part])
        row += part.start
        i = place[begin[row] + at]
        for sign in (1, -1):
            j = i + sign * d[row]
            inside = (j >= 0) & (j < n)
            other = np.where(inside, slot_of[np.where(inside, j, 0)], -1)
            hit = (other >= low[row]) & (other < high[row])
            starts.append(np.minimum(i, j)[hit])
            periods.append(d[row][hit])
    return (np.concatenate(starts), np.concatenate(periods)) if starts else none


def find_runs(codes: np.ndarray, first: np.ndarray, stop: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of all runs, by start and period; first and stop are the ends of each word's text."""
    at, d = _tandems(codes, first, stop, least)
    order = np.lexsort((d, at + 2 * d))
    at, d = at[order], d[order]
    found = []
    while len(at):
        end = at + 2 * d
        head = np.concatenate([[True], end[1:] != end[:-1]])
        group = np.cumsum(head) - 1
        i, q = at[head], d[head]
        back = _common(codes, i - 1, i + q - 1, i - first[i], -1)
        length = back + 2 * q
        found.append((i - back, length, q))
        rest = (d % q[group] != 0) | (2 * d > length[group])
        at, d = at[rest], d[rest]
    if not found:
        return (np.empty(0, np.int64),) * 3
    start, length, period = (np.concatenate(x) for x in zip(*found))
    long = np.flatnonzero(length >= np.maximum(least, 2 * period))
    long = long[np.lexsort((period[long], start[long]))]
    return start[long], length[long], period[long]


class _Codes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _solve(texts: list[bytes], least: int) -> tuple[list[int], np.ndarray, pa.Array, list[bytes]]:
    """Number of words, offsets of the runs, the runs and the collapsed text of each text."""
    words = [x.split() for x in texts]  # bytes.split() parts at 0x20 and 0x09 to 0x0D
    counts = [len(w) for w in words]
    offsets = np.cumsum([0, *counts])
    numbers = _Codes()
    codes = np.fromiter((numbers[w] for ws in words for w in ws), np.int64, offsets[-1])
    text = np.repeat(np.arange(len(texts)), counts)
    first, stop = offsets[:-1][text], offsets[1:][text]
    _, codes = np.unique(text * max(len(numbers), 1) + codes, return_inverse=True)
    start, length, period = find_runs(codes, first, stop, least)
    edge = np.zeros(len(codes) + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + length, -1)
    dropped = np.cumsum(edge[:-1]) > 0
    some = np.zeros(len(texts), bool)
    some[text[dropped]] = True
    collapsed = [b" ".join(w) if not s else b" ".join([x for x, gone in zip(w, dropped[a : a + n].tolist()) if not gone]) for w, s, a, n in zip(words, some.tolist(), offsets.tolist(), counts)]
    ends = np.searchsorted(start, offsets)
    owner = np.searchsorted(offsets, start, side="right") - 1
    runs = pa.StructArray.from_arrays([pa.array(x) for x in (start - offsets[owner], length, period)], RUN.names)
    return counts, ends, runs, collapsed


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Add n_words, runs (array of start, length, period in words, by start and period) and collapsed to every row.

    Words are the longest stretches without 0x20 and 0x09 to 0x0D.  `collapsed` joins by one blank the words that no run
    holds after its first period.  A null, empty or blank text has no words, no runs and an empty collapsed text.  Rows
    are judged one by one, so repeated rows give equal results.  `docs` needs text; of its further columns those of the
    new names are replaced and all others kept.  A text is worked on in one task, whatever its length.
    """
    names = [c for c in docs.columns if c.lower() not in NEW]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names if c.lower() != "text"]).alias("row"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, most=4_000_000):
                counts, ends, runs, collapsed = _solve([x or b"" for x in part.column("text").cast(pa.binary()).to_pylist()], least)
                listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), runs)
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("text"), pa.array(counts, pa.int64()), listed, pa.array(collapsed, pa.binary()).cast(pa.string())], ["row", "text", *NEW])

    out = rows.mapInArrow(run, StructType([*rows.schema, *[StructField(c, t) for c, t in NEW.items()]]))
    return out.select(*[F.col("text").alias(c) if c.lower() == "text" else F.col(f"row.`{c}`").alias(c) for c in names], *NEW)


def with_repetition(doc_id: Column, text: Column) -> Column:
    """The text in which, for each tenth of the checksums h of doc_id, the words from h / 10 on repeat their first ones.

    With n words and g = h div 10 each word i >= a becomes word a + (i - a) % p, where a = g % n and
    p = 1 + (n - a) div (3 + g % 8).  A row without an id and a text without words stay as they are.
    """
    h = F.crc32(doc_id.cast("string"))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def repeated(x: Column) -> Column:
        g, n = x["g"], F.size(x["words"])
        a = F.pmod(g, n)
        p = F.floor((n - a) / (3 + g % 8)) + 1
        return F.transform(x["words"], lambda w, i: F.when(i < a, w).otherwise(F.get(x["words"], (a + F.pmod(i - a, p)).cast("int"))))

    # An array of one struct names the words, so that they are split once for a row.
    made = F.transform(F.array(F.struct(words.alias("words"), F.floor(h / 10).alias("g"))), lambda x: F.array_join(repeated(x), " "))
    return F.when((h % 10 == 0) & F.rlike(text, F.lit(r"[^\x20\x09-\x0D]")), made[0]).otherwise(text)


def run_digests(docs: DataFrame) -> DataFrame:
    """doc_id, the number of runs, the longest run and the SHA-256 of the runs and of the collapsed text."""
    out = periodic_runs(docs.select("doc_id", with_repetition(F.col("doc_id"), F.coalesce("text", F.lit(""))).alias("text")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in RUN.names]))
    listed = F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "")
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    out = out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("x"), listed.alias("listed"), "collapsed")
    return out.select(
        "doc_id", "n_runs", F.col("x.start").alias("start"), (-F.col("x.less")).alias("length"), F.col("x.period").alias("period"),
        F.floor(-1000 * F.col("x.less") / F.col("x.period")).cast("long").alias("exponent_milli"), F.sha2("listed", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
