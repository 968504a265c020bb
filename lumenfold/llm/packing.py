"""Best-fit packing of documents into sequences by minimum bin slack.

Lengths are at most the capacity, so their histogram has a bounded number of rows however large the corpus is.  The
driver plans on that histogram only: for each bin a bitset subset-sum finds the fullest combination of the available
lengths, and the same combination is taken as often as the counts allow.  Spark then numbers the pieces of each length
(salted, so that a frequent length is spread over many tasks) and every piece looks up its place in the plan.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import ByteBpe, encode_documents
from .common import save, small_batches

CAPACITY = 2048
SALTS = 256
ROWS_PER_SALT = 100_000
_TAG = np.int64(1 << 44)


def token_pieces(docs: DataFrame, vocab: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's ids followed by `end_id`.

    Longer documents are cut into pieces of `capacity`; the first may be shorter.  Null and empty texts give one piece
    that holds `end_id` alone.
    """

    def finish(bpe: ByteBpe, doc_ids: pa.Array, ids: list[np.ndarray], texts: list[str]) -> pa.RecordBatch:
        rows: list[tuple[int, int, int, int, int]] = []
        for i, x in enumerate(ids):
            whole = np.append(x, end_id).astype("<u4")
            n = len(whole)
            head = n % capacity or capacity
            edges = [0, *range(min(head, n), n + 1, capacity)]
            for k, (a, b) in enumerate(zip(edges, edges[1:])):
                rows.append((i, k, a, b - a, zlib.crc32(whole[a:b].tobytes())))
        at, piece, start, length, crc = np.array(rows, np.int64).reshape(-1, 5).T
        return pa.RecordBatch.from_arrays(
            [doc_ids.take(pa.array(at)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)],
            ["doc_id", "piece", "start", "length", "ids_crc32"],
        )

    return encode_documents(docs, vocab, finish, "doc_id long, piece int, start long, length long, ids_crc32 long")


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The combination of available lengths, with the longest among them, that fills a bin best."""
    longest = max(counts)
    room = capacity - longest
    bits, keep = 1, (1 << (room + 1)) - 1
    steps: list[tuple[int, int, int]] = []
    for length in sorted(counts, reverse=True):
        left = min(counts[length] - (length == longest), room // length)
        copies = 1
        while left > 0 and not bits >> room & 1:
            take = min(copies, left)
            steps.append((length, take, bits))
            bits |= bits << length * take & keep
            left -= take
            copies *= 2
        if bits >> room & 1:
            break
    rest, used = bits.bit_length() - 1, {longest: 1}
    for length, take, before in reversed(steps):
        if not before >> rest & 1:
            used[length] = used.get(length, 0) + take
            rest -= length * take
    return used


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """Segments of ranks, sorted by (length, first rank): which sequences the pieces of a length go to, and where."""
    left = {k: v for k, v in counts.items() if v}
    taken = dict.fromkeys(left, 0)
    rows, sequence = [], 0
    while left:
        used = fullest(left, capacity)
        times = min(left[k] // n for k, n in used.items())
        offset = 0
        for length, n in used.items():
            rows.append((length, taken[length], sequence, n, offset))
            taken[length] += n * times
            left[length] -= n * times
            offset += n * length
            if not left[length]:
                del left[length]
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return {"key": table[:, 0] * _TAG + table[:, 1], "first": table[:, 1], "sequence": table[:, 2], "copies": table[:, 3], "offset": table[:, 4]}


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to a table with columns doc_id, piece and length (1 to `capacity`).

    `pieces` is read twice, so it should be a stored table.  Sequences have no gaps; equal lengths are interchangeable,
    so repeated rows only change which of them goes where.  An empty table gives no rows.  Other columns stay, but for
    sequence_id and offset, which are replaced, and the working names _salt, _rank, _n and _before, which go.
    """
    spark = pieces.sparkSession
    pieces = pieces.select(*[F.col(f"`{c}`") for c in pieces.columns if c.lower() not in ("sequence_id", "offset", "_salt", "_rank", "_n", "_before")])
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    segments = spark.sparkContext.broadcast(plan(counts, capacity))  # bounded by the number of combinations of lengths
    salts = max(SALTS, sum(counts.values()) // ROWS_PER_SALT)
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    held = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = held.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n")).drop("_n")
    ranked = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece")))
    ranked = ranked.join(before, ["length", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_before") - 1).select(*pieces.columns, "_rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = segments.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_rank"))
            at = np.searchsorted(s["key"], length * _TAG + rank, side="right") - 1
            local = rank - s["first"][at]
            kept = [batch.column(c) for c in batch.schema.names if c != "_rank"]
            where = [pa.array(s["sequence"][at] + local // s["copies"][at]), pa.array(s["offset"][at] + local % s["copies"][at] * length)]
            yield pa.RecordBatch.from_arrays([*kept, *where], [*(c for c in batch.schema.names if c != "_rank"), "sequence_id", "offset"])

    schema = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes) + ", sequence_id long, offset long"
    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, vocab: str, capacity: int = CAPACITY) -> DataFrame:
    """Tokenise, cut and pack every document; one row per piece."""
    small_batches(docs.sparkSession)
    return pack(save(token_pieces(docs, vocab, capacity), "pieces"), capacity)
