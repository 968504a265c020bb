"""Operators that depend on an explicit order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FRAME, STRIDE = 512, 256
DELTA = (-0.2, -0.1, 0.0, 0.1, 0.2)  # oldest to newest


def _over(by: Sequence[str], within: Sequence[str] = ()):
    return (Window.partitionBy(*within) if within else Window.partitionBy(F.lit(1))).orderBy(*by)


def difference(x: Column, by: Sequence[str], within: Sequence[str] = ()) -> Column:
    return x - F.lag(x).over(_over(by, within))


def rolling(x: Column, rows: int, by: Sequence[str], within: Sequence[str] = (), how: str = "avg") -> Column:
    """Over the last `rows` rows, NULL until there are so many values; `how` is avg, sum, min, max or stddev_samp."""
    w = _over(by, within).rowsBetween(1 - rows, 0)
    return F.when(F.count(x).over(w) >= rows, getattr(F, how)(x).over(w))


def duplicate_flag(df: DataFrame, keys: Sequence[str], by: Sequence[str], name: str = "duplicated") -> DataFrame:
    """True from the second occurrence of the keys in the given order."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*by)) > 1)


def drop_duplicates(df: DataFrame, keys: Sequence[str], by: Sequence[str], keep: str = "first") -> DataFrame:
    """One row for each set of keys: the first or last in the given order (partial aggregation, no window).

    `by` must be columns; the row's other columns travel with them as one struct.
    """
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[F.col(c) for c in by], *[F.col(c) for c in rest if c not in by])
    pick = F.min(rank) if keep == "first" else F.max(rank)
    return df.groupBy(*keys).agg(pick.alias("_row")).select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def islands(df: DataFrame, value: str, by: Sequence[str], within: Sequence[str]) -> DataFrame:
    """Runs of equal neighbours: within, run (from 1), value, and the number of rows."""
    w = _over(by, within)
    changed = F.coalesce((~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int"), F.lit(1))
    first = F.when(F.row_number().over(w) == 1, 1).otherwise(changed)
    runs = df.withColumn("_new", first).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*within, "run").agg(F.first(value).alias(value), F.count("*").alias("rows"))


def latest_and_nth(df: DataFrame, n: int, time: str, within: Sequence[str], tie: str) -> DataFrame:
    """Latest time and n-th latest time of each group; NULL where there are fewer."""
    at = F.row_number().over(Window.partitionBy(*within).orderBy(F.desc(time), F.desc(tie)))
    ranked = df.withColumn("_at", at).filter(F.col("_at") <= n)
    return ranked.groupBy(*within).agg(F.max(F.when(F.col("_at") == 1, F.col(time))).alias("latest"), F.max(F.when(F.col("_at") == n, F.col(time))).alias("nth"))


def frames(samples: Column, size: int = FRAME, stride: int = STRIDE) -> Column:
    """Overlapping frames of an array; a tail shorter than a frame is left out."""
    n = F.floor((F.size(samples) - size) / stride)
    return F.when(F.size(samples) >= size, F.transform(F.sequence(F.lit(0), n.cast("int")), lambda i: F.slice(samples, i * stride + 1, F.lit(size)))).otherwise(F.array().cast("array<array<double>>"))


def delta(x: Column, by: Sequence[str], within: Sequence[str], weights: Sequence[float] = DELTA) -> Column:
    """Weighted sum of the last rows; NULL until there are enough."""
    w, n = _over(by, within), len(weights)
    out = F.lit(0.0)
    for i, weight in enumerate(weights):
        out = out + weight * (x if i == n - 1 else F.lag(x, n - 1 - i).over(w))
    return out


def running_until(x: Column, limit: Column, by: Sequence[str], within: Sequence[str]) -> tuple[Column, Column]:
    """Running sum that skips NULL, and whether the row comes before the first value that equals `limit`."""
    w = _over(by, within).rowsBetween(Window.unboundedPreceding, 0)
    return F.sum(F.coalesce(x, F.lit(0))).over(w), F.coalesce(F.max((x == limit).cast("int")).over(w), F.lit(0)) == 0
