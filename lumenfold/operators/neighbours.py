"""A graph of nearest neighbours by descent, and spectral clusters on it.

Rows first meet in buckets of random hyperplanes; then, round by round, the neighbours of one row meet each other, as a
neighbour of a neighbour is likely to be one.  Distances are taken inside a task; what leaves it are the nearest of each
row there, and lists are merged by partial aggregation, so no task sees all rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

BUCKET = 256
TABLES = 6
LISTS = "row long, found array<struct<d:double,other:long>>"


def _nearest(ids: np.ndarray, x: np.ndarray, keep: int) -> pa.RecordBatch:
    """For each row of one group the `keep` nearest others, by squared distance and id."""
    sq = (x * x).sum(axis=1)
    d = np.maximum(sq[:, None] + sq[None, :] - 2 * x @ x.T, 0)
    d[ids[:, None] == ids[None, :]] = np.inf
    k = min(keep, len(ids) - 1)
    best = np.argpartition(d, k - 1, axis=1)[:, :k] if 0 < k < len(ids) else np.argsort(d, axis=1)[:, :k]
    near = [[{"d": float(d[i, j]), "other": int(ids[j])} for j in row if np.isfinite(d[i, j])] for i, row in enumerate(best.tolist())]
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(near, pa.list_(pa.struct([("d", pa.float64()), ("other", pa.int64())])))], ["row", "found"])


def _groups(keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for held in b.column("held").to_pylist():
                if len(held) > 1:
                    yield _nearest(np.array([h["row"] for h in held]), np.array([h["x"] for h in held], np.float64), keep)

    return run


def _merge(lists: DataFrame, keep: int) -> DataFrame:
    """Lists of one row put together: its `keep` nearest, each once."""
    return lists.groupBy("row").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("found")))), 1, keep).alias("found"))


def neighbour_graph(df: DataFrame, key: str, x: str, k: int = 10, keep: int = 20, tables: int = TABLES, bucket: int = BUCKET, rounds: int = 4, seed: int = 5) -> DataFrame:
    """key, other, distance and rank (from 1): about the `k` nearest other rows of each by Euclidean distance.

    `key` is a number that differs in all rows; vectors have one length and no null or non-finite numbers.  Rows of equal
    vectors are neighbours at distance 0; buckets are split at random where they hold too many, so a third of all rows may
    be equal.  With as few rows as one bucket holds the graph is exact.
    """
    rows = cut(df.select(F.col(key).cast("long").alias("row"), F.col(x).cast("array<double>").alias("x")))
    n = rows.count()
    if not n:
        return df.sparkSession.createDataFrame([], "row long, other long, distance double, rank int").withColumnRenamed("row", key)
    size = len(rows.first()["x"])
    bits = max(0, math.ceil(math.log2(n / bucket)) + (n > bucket))
    mean = np.array(rows.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m")).orderBy("i").toPandas()["m"])  # one row a component
    planes = np.random.default_rng(seed).normal(size=(size, tables * max(bits, 1)))
    used = tables if bits else 1

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1) - mean
            sign = (m @ planes > 0).astype(np.int64)
            for t in range(used):
                code = sign[:, t * bits : (t + 1) * bits] @ (1 << np.arange(bits)) if bits else np.zeros(len(b), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), t)), pa.array(code.astype(np.int64)), b.column("row"), b.column("x")], ["t", "code", "row", "x"])

    dealt = rows.mapInArrow(codes, "t long, code long, row long, x array<double>")
    sizes = dealt.groupBy("t", "code").agg(F.ceil(F.count("*") / (2 * bucket)).cast("long").alias("parts"))
    parted = dealt.join(sizes, ["t", "code"]).withColumn("part", F.pmod(F.xxhash64("row", "t"), "parts"))
    held = parted.groupBy("t", "code", "part").agg(F.collect_list(F.struct("row", "x")).alias("held"))
    graph = cut(_merge(held.select("held").mapInArrow(_groups(keep), LISTS), keep))
    for _ in range(rounds if n > bucket else 0):
        # The neighbours of a row, those it is a neighbour of, and the row itself meet, in parts of bounded size.
        one = graph.select("row", F.explode(F.concat(F.transform("found", lambda f: f["other"]), F.array("row"))).alias("other"))
        members = one.select(F.col("row").alias("at"), F.col("other").alias("row")).unionByName(one.select(F.col("other").alias("at"), "row")).distinct()
        parts = members.groupBy("at").agg(F.ceil(F.count("*") / bucket).cast("long").alias("parts"))
        members = members.join(parts, "at").select("at", "row", F.pmod(F.xxhash64("row", "at"), "parts").alias("part"))
        met = members.join(rows, "row").groupBy("at", "part").agg(F.collect_list(F.struct("row", "x")).alias("held"))
        graph = cut(_merge(graph.unionByName(met.select("held").mapInArrow(_groups(k), LISTS)), keep))
    out = graph.select(F.col("row").alias(key), F.posexplode(F.slice("found", 1, k)).alias("p", "f"))
    return out.select(key, F.col("f.other").alias("other"), F.sqrt("f.d").alias("distance"), (F.col("p") + 1).cast("int").alias("rank"))


def nearest_exactly(df: DataFrame, queries: DataFrame, key: str, x: str, k: int = 10) -> DataFrame:
    """key, other: the k nearest rows of a stated set of queries among all rows, ties to the smaller key.

    The queries are one block of at most 10,000 rows that every task holds; each task hands on its own nearest.
    """
    q = queries.select(F.col(key).cast("long"), F.col(x).cast("array<double>")).limit(10_001).collect()
    if len(q) > 10_000:
        raise ValueError("take at most 10,000 queries")
    ids, m = np.array([r[0] for r in q], np.int64), np.array([r[1] for r in q], np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b) or not len(ids):
                continue
            other, v = b.column("row").to_numpy(), b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1)
            d = ((m * m).sum(1)[:, None] + (v * v).sum(1)[None, :] - 2 * m @ v.T).clip(0)
            d[ids[:, None] == other[None, :]] = np.inf
            order = np.argsort(d, axis=1, kind="stable")[:, :k]
            at = np.repeat(ids, order.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(other[order].ravel()), pa.array(np.take_along_axis(d, order, 1).ravel())], ["q", "other", "d"])

    near = df.select(F.col(key).cast("long").alias("row"), F.col(x).cast("array<double>").alias("x")).mapInArrow(run, "q long, other long, d double").filter("d < double('inf')")
    best = near.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "other"))), 1, k).alias("best"))
    return best.select(F.col("q").alias(key), F.explode("best.other").alias("other"))


def recall(graph: DataFrame, df: DataFrame, queries: DataFrame, key: str, x: str, k: int = 10) -> float:
    """The share of the true neighbours of the queries that the graph has."""
    true = nearest_exactly(df, queries, key, x, k)
    got = true.join(graph.select(key, "other").withColumn("hit", F.lit(1)), [key, "other"], "left")
    return got.agg(F.avg(F.coalesce("hit", F.lit(0)))).first()[0]


def spectral_embedding(links: DataFrame, size: int, rounds: int = 24, seed: int = 3) -> DataFrame:
    """node and y0 ... : the `size` leading eigenvectors of the normalised graph of `links` (src, dst, weight), each link once.

    Subspace iteration on 2 * size + 8 columns: a round is one join and one aggregation of that many sums, and every
    fourth round the columns are made orthonormal again from their products, which are all that the driver sees.  The
    last round picks the leading ones among what the columns span.
    """
    both = links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    degree = cut(both.groupBy("src").agg(F.sum("weight").alias("d")))
    other = degree.withColumnsRenamed({"src": "dst", "d": "e"})
    steps = cut(both.join(degree, "src").join(other, "dst").select("src", "dst", (F.col("weight") / F.sqrt(F.col("d") * F.col("e"))).alias("w")))
    width = 2 * size + 8
    names, moved = [f"y{j}" for j in range(width)], [f"m{j}" for j in range(width)]

    def products(y: DataFrame, a: list[str], b: list[str]) -> np.ndarray:
        sums = y.agg(*[F.sum(F.col(p) * F.col(q)).alias(f"{i}_{j}") for i, p in enumerate(a) for j, q in enumerate(b)]).first()
        return np.array(list(sums), np.float64).reshape(len(a), len(b))

    def mixed(y: DataFrame, mix: np.ndarray) -> DataFrame:
        return y.select("node", *[sum(F.col(c) * float(mix[i, j]) for i, c in enumerate(names)).alias(f"y{j}") for j in range(mix.shape[1])])

    y = degree.select(F.col("src").alias("node"), *[(F.pmod(F.xxhash64("src", F.lit(seed + j)), F.lit(2_000_003)) / 1_000_001 - 1).alias(c) for j, c in enumerate(names)])
    for i in range(rounds):
        sums = steps.join(y.withColumnRenamed("node", "dst"), "dst").groupBy("src").agg(*[F.sum(F.col("w") * F.col(c)).alias(m) for c, m in zip(names, moved)])
        y = y.join(sums, F.col("node") == F.col("src")).drop("src")
        if i == rounds - 1:
            _, vectors = np.linalg.eigh(products(y := cut(y), names, moved))
            return cut(mixed(y, vectors[:, ::-1][:, :size]))
        y = y.select("node", *[((F.col(c) + F.col(m)) / 2).alias(c) for c, m in zip(names, moved)])
        if i % 4 == 2:
            values, vectors = np.linalg.eigh(products(y := cut(y), names, names))
            y = mixed(y, vectors / np.sqrt(np.maximum(values, values.max() * 1e-12)))
    return y


def spectral_clusters(df: DataFrame, key: str, x: str, clusters: int, k: int = 10, **options) -> DataFrame:
    """key and cluster: k-means of the spectral embedding of the graph of nearest neighbours, which links a row with
    weight 1 to a row that is among its `k` nearest and has it among its own, else 1/2."""
    from .models import kmeans

    graph = neighbour_graph(df, key, x, k, **options)
    links = cut(graph.groupBy(F.least(key, "other").alias("src"), F.greatest(key, "other").alias("dst")).agg((F.count("*") / 2).alias("weight")))
    y = spectral_embedding(links, clusters)
    names = y.columns[1:]
    length = F.sqrt(sum(F.col(c) * F.col(c) for c in names))
    rows = y.select(F.col("node").alias(key), F.array(*[F.col(c) / length for c in names]).alias("_y"))
    return kmeans(rows, "_y", clusters, attempts=3)[0].select(key, "cluster")
