"""Exact top-k search by a bit-sliced index.

Components are quantised to integers and stored by blocks of rows: for every dimension a few slices, each a bitmap
(a Python integer) with one bit a row.  The scores of a query are added up for all rows of a block at once by bitmap
arithmetic (full adders on whole slices), and the best rows are taken from the most significant slice of the sums
downward.  Rows that tie at the boundary are settled by their id.  The sums are exact, so nothing has to be scored again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import save, small_batches

SCALE = 256
BLOCK_ROWS = 8192
QUERY_ROWS = 256
LEAST, MOST = -(2**63), 2**63 - 1


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id and q, the components as floor(256 * x); vectors that are null, empty or hold null or non-finite values go."""
    x = F.col("embedding")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    rows = vectors.filter(F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0)).filter(~bad)
    return rows.select("vec_id", F.transform(x, lambda v: F.floor(v.cast("double") * SCALE).cast("long")).alias("q"))


def build(ids: np.ndarray, rows: np.ndarray) -> dict:
    """The slices of one block: rows in order of id, each dimension shifted to start at 0."""
    order = np.argsort(ids, kind="stable")
    ids, rows = ids[order], rows[order]
    low = rows.min(axis=0)
    shifted = rows.view(np.uint64) - low.view(np.uint64)
    width = max(1, int(shifted.max()).bit_length())
    slices = np.stack([np.packbits((shifted >> np.uint64(b)) & np.uint64(1), axis=0, bitorder="little").T for b in range(width)])
    return {"ids": ids.astype("<i8").tobytes(), "low": low.astype("<i8").tobytes(), "width": width, "slices": np.ascontiguousarray(slices.transpose(1, 0, 2)).tobytes()}


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, tuple[list, list]] = {}

    def out(dim: int) -> pa.RecordBatch:
        ids, rows = held.pop(dim)
        x = build(np.concatenate(ids), np.concatenate(rows))
        return pa.RecordBatch.from_pylist([{"dim": dim, "n": sum(map(len, ids))} | x], schema=pa.schema([("dim", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("low", pa.binary()), ("width", pa.int32()), ("slices", pa.binary())]))

    for batch in batches:
        sizes = np.diff(batch.column("q").offsets.to_numpy())
        ids = batch.column("vec_id").to_numpy()
        for dim in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == dim)
            rows = batch.column("q").take(pa.array(at)).flatten().to_numpy().reshape(-1, dim)
            kept = held.setdefault(dim, ([], []))
            kept[0].append(ids[at])
            kept[1].append(rows)
            if sum(map(len, kept[0])) >= BLOCK_ROWS:
                yield out(dim)
    for dim in list(held):
        yield out(dim)


def sums(planes: list[list[int]], weights: list[int], full: int) -> list[int]:
    """Slices of the sum of |w| * x, x taken from its slices, or from their complement where w is negative."""
    columns: list[list[int]] = [[]]
    for w, x in zip(weights, planes):
        size, place = abs(w), 0
        bits = x if w > 0 else [full ^ s for s in x]
        while size:
            if size & 1:
                while len(columns) < place + len(bits):
                    columns.append([])
                for i, s in enumerate(bits):
                    columns[place + i].append(s)
            size >>= 1
            place += 1
    out, i = [], 0
    while i < len(columns):
        column = columns[i]
        if i + 1 == len(columns) and len(column) > 1:
            columns.append([])
        while len(column) > 1:
            if len(column) == 2:
                a, b = column.pop(), column.pop()
                column.append(a ^ b)
                columns[i + 1].append(a & b)
            else:
                a, b, c = column.pop(), column.pop(), column.pop()
                half = a ^ b
                column.insert(0, half ^ c)
                columns[i + 1].append(a & b | half & c)
        out.append(column[0] if column else 0)
        i += 1
    return out


def best_rows(total: list[int], candidates: int, k: int) -> list[int]:
    """The k rows of `candidates` with the largest sums, ties to the lower row, in no order."""
    sure, maybe = 0, candidates
    for plane in reversed(total):
        found = sure | (maybe & plane)
        n = found.bit_count()
        if n > k:
            maybe &= plane
        else:
            sure, maybe = found, maybe & ~plane
            if n == k:
                maybe = 0
                break
    rows = []
    while sure:
        rows.append((sure & -sure).bit_length() - 1)
        sure &= sure - 1
    while maybe and len(rows) < k:
        rows.append((maybe & -maybe).bit_length() - 1)
        maybe &= maybe - 1
    return rows


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n, dim, width = row["n"], row["dim"], row["width"]
                ids, low = np.frombuffer(row["ids"], "<i8"), [int(v) for v in np.frombuffer(row["low"], "<i8")]
                size = (n + 7) // 8
                raw = row["slices"]
                planes = [[int.from_bytes(raw[(d * width + b) * size : (d * width + b + 1) * size], "little") for b in range(width)] for d in range(dim)]
                full, top = (1 << n) - 1, (1 << width) - 1
                out = []
                for query_id, weights in ((q["vec_id"], q["q"]) for q in row["queries"]):
                    total = sums(planes, weights, full)
                    # What the shift to 0 and the complements added.
                    base = sum(w * v for w, v in zip(weights, low)) - sum(-w * top for w in weights if w < 0)
                    a, b = np.searchsorted(ids, query_id), np.searchsorted(ids, query_id, side="right")
                    for r in best_rows(total, full & ~(((1 << int(b - a)) - 1) << int(a)), k):
                        exact = base + sum((s >> r & 1) << i for i, s in enumerate(total))
                        out.append((query_id, int(ids[r]), min(max(exact, LEAST), MOST)))
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(3)], ["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer inner products of each query with all other vectors.

    Both tables have vec_id and embedding; ties go to the smaller vec_id.  Vectors of another length than the query's
    are no candidates, and neither are rows with the query's own vec_id.  Vectors that are null, empty or hold null or
    non-finite components take no part, nor do rows without a vec_id; empty tables give no rows; other columns are
    ignored.  Rows that repeat a vec_id are candidates each; of query rows with one vec_id the least vector asks, once.
    Components may be of any size: sums are exact, and a score outside a long becomes the nearest long.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    spread = spark.sparkContext.defaultParallelism
    index = save(quantised(vectors).mapInArrow(_blocks, "dim int, n int, ids binary, low binary, width int, slices binary"), "slices")
    n_blocks = index.count()
    places = max(1, min(4096, max(n_blocks, spread)))
    asked = quantised(queries).groupBy("vec_id").agg(F.min("q").alias("q")).select(F.struct("vec_id", "q").alias("query"), F.size("q").alias("dim"))
    # A query chunk goes to every place, an index block to one: blocks of queries meet blocks of rows.
    n_queries = queries.count()
    chunk = F.pmod(F.xxhash64("query.vec_id"), F.lit(max(1, -(-n_queries // QUERY_ROWS))))
    chunks = asked.groupBy("dim", chunk.alias("chunk")).agg(F.collect_list("query").alias("queries"))
    chunks = chunks.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(places - 1)))).repartition(places, "place")
    blocks = index.withColumn("place", F.pmod(F.xxhash64("ids"), F.lit(places)).cast("int")).repartition(places, "place")
    pairs = blocks.hint("shuffle_merge").join(chunks, ["dim", "place"])
    found = pairs.select("dim", "n", "ids", "low", "width", "slices", "queries").mapInArrow(_search(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
