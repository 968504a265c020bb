"""Matrices in blocks: products of columns added up by partitions, transposition by exchange of blocks, kernel k-means.

A matrix is a table of rows; what leaves a partition is a block of bounded size, never a cell for each number of the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

SIZE = 1024


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def gram(df: DataFrame, x: str) -> DataFrame:
    """row, col, value of X'X for the vectors `x`: each partition adds up one square of columns by columns.

    Rows whose vector is null take no part; the vectors have one length and no null numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if len(b):
                m = _matrix(b.column("x"))
                total = m.T @ m if total is None else total + m.T @ m
        if total is not None:
            rows = pa.array(range(len(total)), pa.int64())
            yield pa.RecordBatch.from_arrays([rows, pa.array(total.tolist(), pa.list_(pa.float64()))], ["row", "v"])

    parts = df.filter(F.col(x).isNotNull()).select(F.col(x).cast("array<double>").alias("x")).mapInArrow(run, "row long, v array<double>")
    return parts.select("row", F.posexplode("v").alias("col", "v")).groupBy("row", F.col("col").cast("long").alias("col")).agg(F.sum("v").alias("value"))


def transpose(df: DataFrame, row: str, values: str, size: int = SIZE) -> DataFrame:
    """col, block and values: the columns of a matrix in pieces of the rows [block * size, (block + 1) * size), by row.

    `row` numbers the rows, with or without gaps.  Each batch of rows hands over one piece for each column and block, and
    the pieces of a block, of `size` rows at most, are put together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, m = b.column("row").to_numpy(), _matrix(b.column("x")) if len(b) else None
            for k in np.unique(at // size).tolist():
                own = at // size == k
                columns = m[own].T.tolist()
                n = len(columns)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(n), pa.int64()), pa.array([k] * n, pa.int64()), pa.array([at[own].tolist()] * n, pa.list_(pa.int64())), pa.array(columns, pa.list_(pa.float64()))], ["col", "block", "at", "v"]
                )

    pieces = df.select(F.col(row).cast("long").alias("row"), F.col(values).cast("array<double>").alias("x")).mapInArrow(run, "col long, block long, at array<long>, v array<double>")
    pairs = F.array_sort(F.flatten(F.collect_list(F.arrays_zip("at", "v"))))
    return pieces.groupBy("col", "block").agg(F.transform(pairs, lambda p: p["v"]).alias(values))


def transpose_whole(df: DataFrame, row: str, values: str) -> DataFrame:
    """col and values: each column of a matrix whole, by row (nulls last; rows of equal number by a hash of their vector).

    Rows are dealt out by ranges of `row`.  Each batch of a range hands over one piece for each column, and a column's
    pieces follow each other by range and batch; no number is sorted or shuffled with its row's number.  A null vector has
    no numbers, a shorter one none for the last columns; null numbers stay, and numbers keep their type.  A column must
    fit in one row of Spark, which is 2 GB.
    """
    order = [F.asc_nulls_last("row"), F.xxhash64("x")]
    rows = df.select(F.col(row).alias("row"), F.col(values).alias("x")).repartitionByRange(*order).sortWithinPartitions(*order)
    kind = df.schema[values].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for number, b in enumerate(batches):
            lengths = b.column("x").value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.arange(lengths.sum()) - np.repeat(lengths.cumsum() - lengths, lengths)
            if len(at):
                by_column = np.argsort(at.astype(np.min_scalar_type(at.max())), kind="stable")
                ends = np.concatenate([[0], np.bincount(at).cumsum()])
                n = len(ends) - 1
                pieces = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), b.column("x").flatten().take(pa.array(by_column)))
                yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array([part] * n, pa.int64()), pa.array([number] * n, pa.int64()), pieces], ["col", "part", "batch", "v"])

    def joined(pieces: pa.Table) -> pa.Table:
        v = pieces.sort_by([("part", "ascending"), ("batch", "ascending")]).column("v").combine_chunks().flatten()
        return pa.table([pieces.column("col")[:1].combine_chunks(), pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v)], ["col", values])

    return rows.mapInArrow(run, f"col long, part long, batch long, v {kind}").groupBy("col").applyInArrow(joined, f"col long, `{values}` {kind}")


def _sides(x: np.ndarray, kind: str, gamma: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows as the left and as the right factor of a product from which `_values` makes their kernel; for rbf it is -gamma times the squared distance."""
    if kind != "rbf":
        return x * (gamma if kind == "poly" else 1), x
    square, one = -gamma * (x * x).sum(1)[:, None], np.ones((len(x), 1))
    return np.hstack([2 * gamma * x, square, one]), np.hstack([x, one, square])


def _values(product: np.ndarray, kind: str, gamma: float, degree: int) -> np.ndarray:
    if kind == "rbf":
        # Rounding must not give a squared distance under 0.
        return np.exp((np.minimum if gamma >= 0 else np.maximum)(product, 0, out=product), out=product)
    return (product + 1) ** degree if kind == "poly" else product


def kernel_blocks(df: DataFrame, place: str, x: str, kind: str = "rbf", gamma: float = 1.0, degree: int = 3, size: int = SIZE) -> DataFrame:
    """The kernel of all rows with all rows, (row, block, values): values are those with rows [block * size, ...).

    `place` numbers the rows from 0 without gaps.  A kernel has as many values as pairs of rows; each block of columns is
    one group, which the rows meet as they stream by.
    """
    rows = df.select(F.col(place).cast("long").alias("row"), F.col(x).cast("array<double>").alias("x"))
    columns = rows.groupBy(F.floor(F.col("row") / size).alias("block")).agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "x"))), lambda s: s["x"]).alias("against"))
    n = rows.count()
    each = rows.groupBy(F.floor(F.col("row") / size).alias("part")).agg(F.collect_list(F.struct("row", "x")).alias("own"))
    pairs = each.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(0, (n - 1) // size)).cast("long")))).join(columns, "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, own, against in zip(b.column("block").to_pylist(), b.column("own").to_pylist(), b.column("against").to_pylist()):
                dot = _values(_sides(np.array([o["x"] for o in own]), kind, gamma)[0] @ _sides(np.array(against), kind, gamma)[1].T, kind, gamma, degree)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([o["row"] for o in own], pa.int64()), pa.array([block] * len(own), pa.int64()), pa.array(dot.tolist(), pa.list_(pa.float64()))], ["row", "block", "values"]
                )

    return pairs.select("block", "own", "against").mapInArrow(run, "row long, block long, values array<double>")


def precomputed_kernel_kmeans(kernel: DataFrame, labels: DataFrame, k: int, rounds: int = 50, tolerance: float = 1e-5, size: int = SIZE) -> DataFrame:
    """row, weight and label: kernel k-means from given first labels, over all rows.

    `kernel` has (row, block, values) as `kernel_blocks` gives them, `labels` has row, weight and label (0 to k - 1).  A
    round adds up, for each row and cluster, the weighted kernel values; the distance to a cluster is the cluster's mean
    inner kernel less twice the row's mean with it, ties go to the smaller label.  It ends when a share of less than
    `tolerance` changes.  A cluster without rows is an error, as its mean is not defined.
    """
    kernel = cut(kernel)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.column("row")
            out = np.zeros((len(b), k))
            for i, (v, w) in enumerate(zip(b.column("values").to_pylist(), b.column("w").to_pylist())):
                w = np.array([(x["weight"], x["label"]) for x in w])
                out[i] = np.bincount(w[:, 1].astype(int), w[:, 0] * np.array(v), k)
            yield pa.RecordBatch.from_arrays([rows, pa.array(out.tolist(), pa.list_(pa.float64()))], ["row", "s"])

    def parts(now: DataFrame) -> DataFrame:
        held = now.groupBy(F.floor(F.col("row") / size).alias("block")).agg(F.array_sort(F.collect_list(F.struct("row", "weight", "label"))).alias("w"))
        return kernel.join(held, "block").select("row", "values", "w").mapInArrow(sums, "row long, s array<double>")

    return _rounds(parts, labels, k, rounds, tolerance)


def vector_kernel_kmeans(
    df: DataFrame, place: str, x: str, labels: DataFrame, k: int, kind: str = "rbf", gamma: float = 1.0, degree: int = 3, rounds: int = 50, tolerance: float = 1e-5, size: int = 8 * SIZE
) -> DataFrame:
    """`precomputed_kernel_kmeans` over the kernel of all rows with all rows, which a round computes anew and nobody stores.

    A task meets one pair of blocks of `size` rows after the other and holds a small piece of their kernel; each pair serves both
    of its blocks.  So memory does not grow with the rows; the work of a round grows with their square, and what is
    shuffled with that square over `size`.  `place` numbers the rows, each of which has a label.
    """
    of = lambda rows: F.floor(rows / size).alias("part")
    sorted_ = lambda *c: F.array_sort(F.collect_list(F.struct("row", *c)))
    vectors = df.select(F.col(place).cast("long").alias("row"), F.col(x).alias("x")).groupBy(of(F.col("row"))).agg(sorted_("x").alias("s"))
    vectors = cut(vectors.select("part", F.col("s.row").alias("rows"), F.flatten("s.x").alias("x")))
    last = vectors.agg(F.max("part")).first()[0] or 0
    names = ["rows", "x", "weights", "labels"]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                own, met = ([b.column(f"{side}_{c}")[i].values.to_numpy(zero_copy_only=False) for c in names] for side in ("own", "met"))
                a, c = (_sides(v[1].astype(np.float64).reshape(len(v[0]), -1), kind, gamma)[side] for side, v in enumerate((own, met)))
                mine, theirs = (v[2][:, None] * (v[3][:, None] == np.arange(k)) for v in (own, met))
                out, back = np.zeros((len(a), k)), np.zeros((len(c), k))
                for t in range(0, len(c), 1024):  # pieces that stay in a core's cache
                    right = np.ascontiguousarray(c[t : t + 1024].T)
                    for s in range(0, len(a), 64):
                        piece = _values(a[s : s + 64] @ right, kind, gamma, degree)
                        out[s : s + 64] += piece @ theirs[t : t + 1024]
                        back[t : t + 1024] += piece.T @ mine[s : s + 64]
                for rows, found in ((own[0], out), (met[0], back))[: 1 if own[0][0] == met[0][0] else 2]:
                    yield pa.RecordBatch.from_arrays([pa.array(rows), pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * k, pa.int32()), pa.array(found.ravel()))], ["row", "s"])

    def parts(now: DataFrame) -> DataFrame:
        held = now.groupBy(of(F.col("row"))).agg(sorted_("weight", "label").alias("w")).select("part", F.col("w.weight").alias("weights"), F.col("w.label").alias("labels"))
        blocks = vectors.join(held, "part")
        own = blocks.select("part", F.explode(F.sequence("part", F.lit(last))).alias("met"), *[F.col(c).alias(f"own_{c}") for c in names])
        met = blocks.select(F.explode(F.sequence(F.lit(0).cast("long"), "part")).alias("part"), F.col("part").alias("met"), *[F.col(c).alias(f"met_{c}") for c in names])
        return own.join(met, ["part", "met"]).drop("part", "met").mapInArrow(sums, "row long, s array<double>")

    return _rounds(parts, labels, k, rounds, tolerance)


def _rounds(parts: Callable[[DataFrame], DataFrame], labels: DataFrame, k: int, rounds: int, tolerance: float) -> DataFrame:
    """The rounds of kernel k-means; `parts` gives, for rows with weight and label, (row, s): sums of weighted kernel values by cluster, to be added up."""
    now = cut(labels.select(F.col("row").cast("long").alias("row"), F.col("weight").cast("double").alias("weight"), F.col("label").cast("int").alias("label")))
    n = now.count()
    for _ in range(rounds):
        added = parts(now).groupBy("row").agg(*[F.sum(F.col("s")[j]).alias(f"s{j}") for j in range(k)]).select("row", F.array(*[f"s{j}" for j in range(k)]).alias("s"))
        added = cut(added.join(now, "row"))
        inner = F.sum(F.col("weight") * F.get("s", F.col("label")))
        clusters = {r["label"]: (r["all"], r["inner"]) for r in added.groupBy("label").agg(F.sum("weight").alias("all"), inner.alias("inner")).collect()}  # k rows
        if len(clusters) < k:
            raise ValueError("a cluster is empty; take fewer clusters")
        distances = [F.lit(clusters[j][1] / clusters[j][0] ** 2) - F.lit(2 / clusters[j][0]) * F.col("s")[j] for j in range(k)]
        best = F.array_min(F.array(*[F.struct(d.alias("d"), F.lit(j).alias("j")) for j, d in enumerate(distances)]))
        new = added.select("row", "weight", best["j"].alias("label"), F.col("label").alias("old"))
        changed = new.filter("label <> old").count()
        now = new.drop("old")
        if changed < tolerance * n:
            break
    return now
