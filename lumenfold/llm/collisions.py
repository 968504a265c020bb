"""Near copies of vectors by counting collisions in windows of one-dimensional projections.

Unit vectors whose cosine is c differ by sqrt(2 - 2 c), so their projections on a Gaussian direction differ by a normal
number of that deviation, and those of unrelated vectors by one of deviation 1.4.  Two vectors collide on a direction if
one lies in the window of `WINDOW` deviations around the other.

1. `plan` draws `tables` sorted projections.  The vectors of a table are sorted by its projection inside cells of `cells`
   further projections, and a vector meets those in the window around it.  The number of cells grows with the logarithm
   of the number of vectors, so a window holds about `MEETS` unrelated vectors at every size; the number of tables follows
   from `RECALL`, the chance that a pair at exactly the threshold meets at least once.
2. Of a pair that meets, collisions are counted on `COUNTED` directions.  It goes on if it has at least `need`, the
   count that all but one in ten thousand pairs at the threshold reach.
3. What is left is verified by its cosine in double precision and belongs to the first table in which it meets.

Pairs never leave their task: a block returns for each vector the number of its links there and a representative of its
component in the block.  A cell of over `BLOCK` vectors is split by hash into parts, and each two parts are a block.
Equal vectors are one vector with a number of copies.  Components are joined by contraction.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_tables, save
from .components import components
from .shingles import scramble

WINDOW = 2.0
CELL = 3.0
MEETS = 128
RECALL = 0.999
COUNTED = 48
BLOCK = 2048
SLAB = 1 << 18
UNIT, STEEP = 1 << 15, 1 << 8  # components and directions are integers, so projections are exact in any order of addition


def _within(width: float) -> float:
    return math.erf(width / math.sqrt(2))


def _same_cell(width: float) -> float:
    """Chance that two numbers whose difference has deviation 1 fall into one cell of this width at a random offset."""
    return _within(width) - 2 / (math.sqrt(2 * math.pi) * width) * (1 - math.exp(-(width**2) / 2))


@dataclass(frozen=True)
class Plan:
    cosine: float
    cells: int
    tables: int
    need: int
    window: int
    cell: int

    @property
    def projections(self) -> int:
        return max(COUNTED, self.tables * (self.cells + 1))


def plan(vectors: int, cosine: float) -> Plan:
    """How many cells, tables and collisions a table of so many different vectors takes."""
    apart = math.sqrt(2 - 2 * cosine)
    near, far = _same_cell(CELL), _same_cell(CELL * apart / math.sqrt(2))
    meet, stray = _within(WINDOW), _within(WINDOW * apart / math.sqrt(2))
    cells = max(0, math.ceil(math.log(max(vectors, 1) * stray / MEETS) / -math.log(far)))
    tables = math.ceil(math.log(1 - RECALL) / math.log(1 - meet * near**cells))
    need, chance = COUNTED + 1, 0.0
    while chance < 0.9999:
        need -= 1
        chance += math.comb(COUNTED, need) * meet**need * (1 - meet) ** (COUNTED - need)
    scale = UNIT * STEEP * apart
    return Plan(cosine, cells, tables, need, int(WINDOW * scale), int(CELL * scale))


def projections(vectors: np.ndarray, p: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Projections for counting, cell key of each table, sorted projection of each table."""
    size = vectors.shape[1]
    rng = np.random.default_rng([17, size])
    directions = np.rint(rng.normal(size=(p.projections, size)) * STEEP).T
    offsets = np.random.default_rng([18, size]).integers(0, 1 << 40, p.projections)
    units = np.rint(vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None] * UNIT)
    all_ = (units @ directions).astype(np.int64)
    key = np.tile((np.arange(p.tables) * 1_000_003 + size).astype(np.uint64), (len(vectors), 1))
    base = np.arange(p.tables) * (p.cells + 1)
    for k in range(p.cells):
        cell = (all_[:, base + k] + offsets[base + k]) // p.cell
        key = scramble(key * np.uint64(0x9E3779B97F4A7C15) + cell.view(np.uint64))
    return all_[:, :COUNTED].astype(np.int32), scramble(key).view(np.int64), all_[:, base + p.cells]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _by_size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches whose vectors have one number of components each."""
    for batch in batches:
        sizes = batch.column("vector").value_lengths().to_numpy()
        for size in np.unique(sizes).tolist():
            yield batch.filter(pa.array(sizes == size))


def _keys(p: Plan, whole: bool):
    """One row for each vector and table: its cell and, if `whole`, all that a block needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _by_size(batches):
            for a in range(0, len(batch), 1000):
                part = batch.slice(a, 1000)
                _, cells, at = projections(_matrix(part.column("vector")), p)
                for t in range(p.tables):
                    cell = pa.array(cells[:, t])
                    if whole:
                        table = pa.array(np.full(len(part), t, np.int32))
                        yield pa.RecordBatch.from_arrays([cell, table, pa.array(at[:, t]), *part.columns], ["cell", "nth", "at", *part.schema.names])
                    else:
                        yield pa.RecordBatch.from_arrays([cell], ["cell"])

    return run


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number in the component of each of n numbers."""
    label = np.arange(n)
    while len(a):
        to = np.arange(n)
        np.minimum.at(to, a, b)
        np.minimum.at(to, b, a)
        while (to[to] != to).any():
            to = to[to]
        label, a, b = to[label], to[a], to[b]
        a, b = a[a != b], b[a != b]
    return label


def _links(batch: pa.RecordBatch, p: Plan) -> pa.RecordBatch:
    """Whole blocks, sorted by (cell, x, y, at), to rows (node, links, other)."""
    vectors = _matrix(batch.column("vector"))
    counted, cells, sorted_ = projections(vectors, p)
    lengths = np.sqrt((vectors * vectors).sum(axis=1))
    cell, x, y, part, nth, at, copies = (batch.column(c).to_numpy() for c in ("cell", "x", "y", "part", "nth", "at", "copies"))
    n = len(batch)
    fresh = np.concatenate([[True], (cell[1:] != cell[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
    line = np.cumsum(fresh) * (1 << 40) + at
    first = np.searchsorted(line, line - p.window)
    size = np.arange(n) - first
    links, label = np.zeros(n, np.int64), np.arange(n)
    upto = np.cumsum(size)
    edges = np.searchsorted(upto, np.arange(0, upto[-1] + SLAB, SLAB), side="left") if n else []
    for lo, hi in zip(edges, [*edges[1:], n]):
        sizes = size[lo:hi]
        i = np.repeat(np.arange(lo, hi), sizes)
        j = np.arange(len(i)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + first[i]
        cross = (x[i] == y[i]) | (part[i] != part[j])
        i, j = i[cross], j[cross]
        misses = np.zeros(len(i), np.int16)
        for c in range(0, COUNTED, 8):
            misses += (np.abs(counted[i, c : c + 8] - counted[j, c : c + 8]) > p.window).sum(axis=1, dtype=np.int16)
            good = misses <= COUNTED - p.need
            i, j, misses = i[good], j[good], misses[good]
        cosine = np.einsum("ij,ij->i", vectors[i], vectors[j]) / (lengths[i] * lengths[j])
        i, j = i[cosine >= p.cosine], j[cosine >= p.cosine]
        before = (cells[i] == cells[j]) & (np.abs(sorted_[i] - sorted_[j]) <= p.window) & (np.arange(p.tables) < nth[i][:, None])
        own = ~before.any(axis=1)
        i, j = i[own], j[own]
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])
        label = _labels(n, np.concatenate([np.arange(n), i]), np.concatenate([label, j]))
    some = np.flatnonzero(links)
    node = batch.column("node")
    return pa.RecordBatch.from_arrays([node.take(pa.array(some)), pa.array(links[some]), node.take(pa.array(label[some]))], ["node", "links", "other"])


def _blocks(p: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            rows += len(batch)
            key = np.stack([batch.column(c).to_numpy() for c in ("cell", "x", "y")], axis=1)
            other = np.flatnonzero((key != key[-1]).any(axis=1))
            if rows >= 2 * BLOCK and len(other):  # the last block may go on in the next batch
                last = int(other[-1]) + 1
                yield from solve([*held[:-1], batch.slice(0, last)])
                held = [batch.slice(last)]
                rows = len(held[0])
        if held:
            yield from solve(held)

    def solve(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _by_size(iter(pa.Table.from_batches(parts).combine_chunks().to_batches())):
            yield _links(batch, p)

    return run


def near_vectors(vectors: DataFrame, cosine: float = 0.95, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Add n_links, component_id and kept to the id and vector of every row.

    Two rows link if the cosine of their vectors is at least `cosine`; vectors with different numbers of components never
    do.  n_links counts the other rows linked with a row, component_id is the smallest id that links lead to, kept says
    that it is the row's own.  Null and empty vectors, zero vectors and those that hold null, NaN or infinite components
    link with nothing and are kept.  Repeated rows are vectors of their own that link with each other, and rows that
    repeat an id share its name.  A row without an id takes part; it is kept only if it links with nothing.  Further
    columns are ignored.  Pairs at exactly the threshold are missed with a chance of 1 - RECALL, nearer ones with less.
    """
    v = F.col(f"`{vector}`")
    rows = vectors.select(F.col(f"`{id_}`").alias("id"), v.alias("vector"))
    finite = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    sound = F.coalesce((F.size("vector") > 0) & finite & F.exists("vector", lambda c: c != 0), F.lit(False))
    rows = rows.withColumn("node", F.when(sound, F.xxhash64("vector")))
    classes = rows.filter("node is not null").groupBy("node").agg(F.first("vector").alias("vector"), F.count("*").alias("copies"), F.min("id").alias("least"))
    classes = save(classes, "classes")
    p = plan(classes.count(), cosine)

    source = classes.select("node", "copies", "vector")
    split = source.mapInArrow(_keys(p, False), "cell long").groupBy("cell").agg(F.count("*").alias("m")).filter(F.col("m") > BLOCK)
    split = save(split.select("cell", F.ceil(F.col("m") / BLOCK).cast("int").alias("parts")), "split")
    kind = classes.schema["vector"].dataType.simpleString()
    met = source.mapInArrow(_keys(p, True), f"cell long, nth int, at long, node long, copies long, vector {kind}").join(split, "cell", "left")
    met = met.withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.pmod(F.xxhash64("node", F.lit(1)), "parts").cast("int"))
    met = met.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.withColumn("x", F.least("part", "with")).withColumn("y", F.greatest("part", "with")).drop("parts", "with")
    met = met.repartition("cell", "x", "y").sortWithinPartitions("cell", "x", "y", "at")
    links = save(met.mapInArrow(_blocks(p), "node long, links long, other long"), "links")

    groups = components(links.filter("node <> other").select(F.col("node").alias("a"), F.col("other").alias("b")))
    named = classes.select("node", "copies", "least").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = named.join(links.groupBy("node").agg(F.sum("links").alias("links")), "node", "left")
    named = save(named, "named")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of_node = save(named.join(least, "component").select("node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"), "of_node")
    drop_tables(classes, split, links, named)
    out = rows.join(of_node, "node", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)))
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    kept = F.when(F.col("id").isNull(), F.col("n_links") == 0).otherwise(F.coalesce(F.col("id") == component, F.lit(False)))
    return out.select(F.col("id").alias(id_), F.col("vector").alias(vector), "n_links", component.alias("component_id"), kept.alias("kept"))


def link_counts(vectors: DataFrame, cosine: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    return near_vectors(vectors, cosine).select("vec_id", "n_links", "component_id", "kept")
