"""Batches of texts of near length, padded to their longest, and sketches that are kept and merged."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scans


def padded_batches(df: DataFrame, ids: str, key: Sequence[str], budget: int, most: int, step: int = 8, side: str = "right") -> DataFrame:
    """Add bucket, batch, padded, truncated and mask-ready lengths: columns bucket, batch, n_ids, padded.

    Ids beyond `most` are cut (on the right, or on the left for side "left").  A row's length is rounded up to `step`,
    which is its bucket; the rows of a bucket, in order of length and key, fill batches of as many rows as `budget` ids
    hold.  A batch is padded to its longest row, so fewer than `step` ids of a row are padding, and a hot bucket is many
    tasks.  Null ids count as none; rows without ids are a bucket of their own.
    """
    rows = df.withColumn(ids, _cut(F.coalesce(F.col(ids), F.array().cast(df.schema[ids].dataType)), most, side)).withColumn("n_ids", F.size(ids).cast("long"))
    rows = rows.withColumn("bucket", (F.ceil(F.col("n_ids") / step) * step).cast("long"))
    rows = scans.placed(rows, ["bucket"], ["n_ids", *key], "_place")
    held = F.greatest(F.floor(F.lit(budget) / F.greatest("bucket", F.lit(step))), F.lit(1))
    rows = rows.withColumn("batch", F.floor(F.col("_place") / held).cast("long")).drop("_place")
    longest = rows.groupBy("bucket", "batch").agg(F.max("n_ids").alias("padded"))
    return rows.join(longest, ["bucket", "batch"])


def _cut(ids: Column, most: int, side: str) -> Column:
    return F.slice(ids, 1, most) if side == "right" else F.slice(ids, F.greatest(F.size(ids) - most + 1, F.lit(1)), F.lit(most))


def pad(ids: Column, padded: Column, with_: int = 0, side: str = "right") -> Column:
    """The ids filled up to `padded`."""
    fill = F.array_repeat(F.lit(with_), (padded - F.size(ids)).cast("int"))
    return F.concat(ids, fill) if side == "right" else F.concat(fill, ids)


def mask(ids: Column, padded: Column, side: str = "right") -> Column:
    """1 for an id, 0 for padding."""
    one, zero = F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), (padded - F.size(ids)).cast("int"))
    return F.concat(one, zero) if side == "right" else F.concat(zero, one)


def pad_share(batched: DataFrame) -> DataFrame:
    """One row: ids, padding and the share of padding."""
    out = batched.agg(F.sum("n_ids").alias("ids"), F.sum(F.col("padded") - F.col("n_ids")).alias("padding"))
    return out.withColumn("share", F.col("padding") / (F.col("ids") + F.col("padding")))


def sketches(df: DataFrame, by: Sequence[str], distinct: str, value: str, accuracy: int = 12) -> DataFrame:
    """One row for each key with a distinct-count sketch of one column and a quantile sketch of another, to be kept."""
    return df.groupBy(*by).agg(F.hll_sketch_agg(distinct, accuracy).alias("distinct"), F.kll_sketch_agg_double(F.col(value).cast("double")).alias("quantiles"), F.count("*").alias("rows"))


def merged(kept: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sketches of finer keys merged into those of coarser ones, with no row of the data read again."""
    return kept.groupBy(*by).agg(F.hll_union_agg("distinct").alias("distinct"), F.kll_merge_agg_double("quantiles").alias("quantiles"), F.sum("rows").alias("rows"))


def estimates(kept: DataFrame, at: Sequence[float] = (0.5,)) -> DataFrame:
    """The numbers that sketches hold: n_distinct and one quantile for each of `at`."""
    ranks = F.array(*[F.lit(q) for q in at])
    return kept.withColumn("n_distinct", F.hll_sketch_estimate("distinct")).withColumn("at", F.kll_sketch_get_quantile_double("quantiles", ranks))


def kept_values(df: DataFrame, by: Sequence[str], distinct: str) -> DataFrame:
    """What `sketches` keeps, exact: one row for each key and distinct value (`value`, also null), with its number of `rows`."""
    return df.groupBy(*by, F.col(distinct).alias("value")).agg(F.count("*").alias("rows"))


def merged_values(kept: DataFrame, by: Sequence[str]) -> DataFrame:
    """Kept values of finer keys merged into those of coarser ones."""
    return kept.groupBy(*by, "value").agg(F.sum("rows").alias("rows"))


def counts(kept: DataFrame, by: Sequence[str]) -> DataFrame:
    """n_distinct and rows of each key, from kept values that were merged by it; a null is a row but no value."""
    return kept.groupBy(*by).agg(F.count("value").alias("n_distinct"), F.sum("rows").alias("rows"))
