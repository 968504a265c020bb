"""Projection, joins, ordering, sets and reshaping."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scans

BROADCAST_ROWS = 100_000


def take_positions(df: DataFrame, places: Sequence[int]) -> DataFrame:
    return df.select(*[df.columns[i] for i in places])


def drop_positions(df: DataFrame, places: Sequence[int]) -> DataFrame:
    gone = {df.columns[i] for i in places}
    return df.select(*[c for c in df.columns if c not in gone])


def numbered(df: DataFrame, by: Sequence[str], name: str = "position", within: Sequence[str] = ()) -> DataFrame:
    """Position from 0 in an explicit order, of all rows or of those of each key: ranges are numbered, so no task sees all rows."""
    return scans.placed(df, list(within), list(by), name)


def any_of(tests: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def all_of(tests: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests)


def cap(x: Column, limit: float) -> Column:
    """Values beyond +-limit become +-limit."""
    return F.when(F.abs(x) > limit, F.signum(x) * limit).otherwise(x)


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]], how: str = "inner", pairs: int = 4_000_000) -> DataFrame:
    """Equi-join in which a missing key meets a missing key; full and right joins coalesce the keys under the left names.

    All rows without a key are one group, whose pairs grow with the square of its rows.  If they are over `pairs`, the group
    is dealt out over a grid, whose cells of about so many pairs are tasks of their own.  A full join is a left one and
    the right rows that meet nothing, as Spark's own holds all pairs of a key in memory.
    """
    kind = how.lower().replace("_", "").removesuffix("outer") or "full"
    names = [f"_r_{b}" for _, b in keys]
    other = right.withColumnsRenamed({b: f"_r_{b}" for _, b in keys})

    def meet(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
        return a.join(b, all_of([a[x].eqNullSafe(b[y]) for (x, _), y in zip(keys, names)]), how)

    if kind in ("semi", "leftsemi", "anti", "leftanti"):
        return meet(left, other, kind)
    parts = []
    missing = [all_of([F.col(f"`{c}`").isNull() for c in side]) for side in ([a for a, _ in keys], names)]
    n = [side.filter(m).count() for side, m in zip((left, other), missing)]
    if n[0] * n[1] > pairs:
        parts.append(_grid(left.filter(missing[0]), other.filter(missing[1]), min(100, math.ceil(math.sqrt(n[0] * n[1] / pairs)))))
        left, other = left.filter(~missing[0]), other.filter(~missing[1])
    parts.append(meet(left, other, "left" if kind == "full" else kind))
    if kind == "full":
        seen = left.select(*[F.col(f"`{a}`").alias(f"_seen{b}") for (a, _), b in zip(keys, names)]).distinct()
        alone = other.join(seen, all_of([seen[f"_seen{b}"].eqNullSafe(other[b]) for b in names]), "left_anti")
        parts.append(alone.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in left.schema.fields], *[alone[c] for c in alone.columns]))
    out = reduce(lambda a, b: a.union(b), parts)
    if kind in ("full", "right"):
        out = out.withColumns({a: F.coalesce(F.col(f"`{a}`"), F.col(f"`{b}`")) for (a, _), b in zip(keys, names)})
    return out.drop(*names)


def _grid(left: DataFrame, right: DataFrame, n: int) -> DataFrame:
    """All pairs of the rows of two sides, in n * n cells: a row is dealt to one of n parts by its hash and copied to the n parts of the other side."""
    part = lambda df: F.pmod(F.xxhash64(F.lit(0), *[F.col(f"`{c}`") for c, t in df.dtypes if not re.search("map<|variant", t)]), F.lit(n)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = left.select("*", part(left).alias("_own_left")).select("*", every.alias("_met_left")).repartition(n * n, "_own_left", "_met_left")
    b = right.select("*", part(right).alias("_own_right")).select("*", every.alias("_met_right")).repartition(n * n, "_met_right", "_own_right")
    cells = (F.col("_own_left") == F.col("_met_right")) & (F.col("_met_left") == F.col("_own_right"))
    return a.join(b, cells).drop("_own_left", "_met_left", "_own_right", "_met_right")


def not_in(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key has not been seen."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after counting that the side has at most `rows` rows; else Catalyst picks the join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def lookup(df: DataFrame, table: DataFrame, key: str) -> DataFrame:
    return df.join(small_side(table), key)


def nearest_centroid(points: DataFrame, centroids: DataFrame, point: str = "embedding", centroid: str = "centroid", label: str = "label") -> DataFrame:
    """Add label and distance of the nearest centroid; ties to the smaller label.

    The centroids of a codebook are few; they travel as one array, so the points are neither joined nor shuffled.
    """
    rows = centroids.select(label, centroid).limit(BROADCAST_ROWS + 1).collect()
    if len(rows) > BROADCAST_ROWS:
        raise ValueError(f"more than {BROADCAST_ROWS} centroids")
    from ..functions.arrays import euclidean

    table = centroids.sparkSession.createDataFrame(rows, centroids.select(label, centroid).schema).agg(F.collect_list(F.struct(F.col(label).alias("label"), F.col(centroid).alias("c"))).alias("_table"))
    near = F.array_min(F.transform("_table", lambda t: F.struct(euclidean(F.col(point), t["c"]).alias("distance"), t["label"].alias("label"))))
    return points.join(F.broadcast(table)).withColumn("_near", near).withColumns({"nearest": F.col("_near.label"), "distance": F.col("_near.distance")}).drop("_near", "_table")


def prefix_join(left: DataFrame, right: DataFrame, left_name: str, right_name: str, separator: str = "-") -> DataFrame:
    """Names that share the part before the separator; an equi-join on the derived key."""
    a = left.withColumn("_key", F.substring_index(left_name, separator, 1))
    b = right.withColumn("_key", F.substring_index(right_name, separator, 1))
    return a.join(b, "_key").withColumnRenamed("_key", "prefix")


def starts_with_join(words: DataFrame, prefixes: DataFrame, word: str, prefix: str) -> DataFrame:
    """Rows whose text begins with a prefix, for prefixes of any lengths: an equi-join on the beginnings of those lengths.

    A text gives one row for each length that occurs, so nothing is compared with all prefixes.  An empty prefix begins
    every text; null texts and prefixes match nothing.
    """
    size = F.length(prefix)
    lengths = [r[0] for r in prefixes.select(size.alias("n")).filter("n is not null").distinct().limit(10_001).collect()]  # as many as there are lengths
    if len(lengths) > 10_000:
        raise ValueError("prefixes have over 10,000 different lengths")
    starts = F.array(*[F.when(F.length(word) >= n, F.substring(word, 1, n)) for n in sorted(lengths)]) if lengths else F.array().cast("array<string>")
    return words.withColumn("_start", F.explode(starts)).join(prefixes.withColumn("_start", F.col(prefix)), "_start").drop("_start")


def info(df: DataFrame) -> DataFrame:
    """place, column, dtype, non_null and rows of every column, in one pass."""
    counts = df.agg(F.count("*").alias("_rows"), *[F.count(F.col(f"`{c}`")).alias(f"_{i}") for i, c in enumerate(df.columns)])
    parts = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(c).alias("column"), F.lit(t).alias("dtype"), F.col(f"_{i}").alias("non_null"), F.col("_rows").alias("rows")) for i, (c, t) in enumerate(df.dtypes)])
    return counts.select(F.inline(parts))


def interval_join(points: DataFrame, spans: DataFrame, at: str, start: str, stop: str, width: float, by: Sequence[str] = ()) -> DataFrame:
    """Points with the spans [start, stop) that hold them.

    An equi-join on cells of `width`: a span stands once in every cell it touches, a point in one, so no pair is tried
    outside its cell.  `width` should be about the usual length of a span.
    """
    cell = lambda x: F.floor(F.col(x) / width)
    last = F.ceil(F.col(stop) / width) - 1
    spread = spans.filter(F.col(start) < F.col(stop)).withColumn("_cell", F.explode(F.sequence(cell(start), F.greatest(last, cell(start)))))
    return points.withColumn("_cell", cell(at)).join(spread, [*by, "_cell"]).filter((F.col(at) >= F.col(start)) & (F.col(at) < F.col(stop))).drop("_cell")


def insert_positions(values: DataFrame, into: DataFrame, value: str, within: Sequence[str]) -> DataFrame:
    """Add `position`: how many values of `into` in the same group are smaller, where a sorted insert would put the row."""
    rows = values.withColumn("_own", F.lit(True)).unionByName(into.select(*within, value).withColumn("_own", F.lit(False)), allowMissingColumns=True)
    before = Window.partitionBy(*within).orderBy(value).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    equal = Window.partitionBy(*within, value)
    below = F.sum((~F.col("_own")).cast("long")).over(before) - F.sum((~F.col("_own")).cast("long")).over(equal)
    return rows.withColumn("position", below).filter("_own").drop("_own")


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b).unionByName(b.subtract(a))


def is_subset(a: DataFrame, b: DataFrame) -> bool:
    return a.subtract(b).limit(1).count() == 0


def transpose_long(df: DataFrame, row: str, values: str) -> DataFrame:
    """Rows of arrays (row, values) to columns as rows (col, values), in order of row."""
    cells = df.select(row, F.posexplode(values).alias("col", "value"))
    ordered = F.array_sort(F.collect_list(F.struct(F.col(row).alias("r"), F.col("value").alias("v"))))
    return cells.groupBy("col").agg(F.transform(ordered, lambda s: s["v"]).alias(values))


def matrix_multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """Long form (row, col, value) on both sides; cells that are missing count as 0."""
    left, right = a.withColumnsRenamed({"col": "k", "value": "x"}), b.withColumnsRenamed({"row": "k", "value": "y"})
    return left.join(right, "k").groupBy("row", "col").agg(F.sum(F.col("x") * F.col("y")).alias("value"))


def select_rows(df: DataFrame, index: str, wanted: DataFrame, invert: bool = False, weight: str | None = None) -> DataFrame:
    """Rows whose index is (not) listed; a weight column is renormalised to sum to 1."""
    out = df.join(wanted.select(index).distinct(), index, "left_anti" if invert else "left_semi")
    if weight:
        whole = out.agg(F.sum(weight).alias("_all"))
        out = out.join(F.broadcast(whole)).withColumn(weight, F.col(weight) / F.col("_all")).drop("_all")
    return out


def pivot_sum(df: DataFrame, rows: str, columns: str, values: Sequence, measure: str, how: str = "sum", fill: float | None = None) -> DataFrame:
    """Pivot with a fixed list of columns, so no job has to look them up."""
    out = df.groupBy(rows).pivot(columns, list(values)).agg(getattr(F, how)(measure))
    return out if fill is None else out.na.fill(fill)


def unpivot(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "name", value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(values), name, value)
