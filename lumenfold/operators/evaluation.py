"""Decisions on scores: votes, normalisation, cascades, imposter tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import log_sum_exp, top_indices
from ..functions.semantics import divide
from . import scans


def vote(df: DataFrame, by: str, distance: str, threshold: float, sure: float = 0.1) -> DataFrame:
    """Accepted if most distances are below the threshold, or one is below `sure`."""
    d = F.col(distance)
    return df.groupBy(by).agg(((F.count_if(d < threshold) * 2 > F.count("*")) | (F.min(d) < sure)).alias("accepted"))


def mean_llr(df: DataFrame, by: str, target: str, background: str) -> DataFrame:
    return df.groupBy(by).agg((F.avg(target) - F.avg(background)).alias("llr"))


def top_component_score(df: DataFrame, first: str, second: str, k: int = 5) -> DataFrame:
    """Add `score`: log-sum of the second model's components at the places of the first model's best ones."""
    at = top_indices(F.col(first), k)
    return df.withColumn("score", log_sum_exp(F.transform(at, lambda i: F.element_at(F.col(second), i + 1))))


def t_norm(scores: DataFrame, by: str, score: str, imposters: DataFrame, imposter_score: str) -> DataFrame:
    """(score - mean of the imposters) / population deviation; NULL without spread."""
    stats = imposters.groupBy(by).agg(F.avg(imposter_score).alias("_m"), F.stddev_pop(imposter_score).alias("_s"))
    return scores.join(stats, by).withColumn("t_norm", divide(F.col(score) - F.col("_m"), F.col("_s"))).drop("_m", "_s")


def z_norm(df: DataFrame, by: str, score: str) -> DataFrame:
    """Normalise by the group's own mean and population deviation; partial aggregation and a join."""
    stats = df.groupBy(by).agg(F.avg(score).alias("_m"), F.stddev_pop(score).alias("_s"))
    return df.join(stats, by).withColumn("z_norm", divide(F.col(score) - F.col("_m"), F.col("_s"))).drop("_m", "_s")


def accept_after(df: DataFrame, by: str, order: str, norm: str, own: str, frames: int = 64, norm_above: float = 2.0, own_above: float = 0.5) -> DataFrame:
    """Decide for each block of `frames` rows on the mean scores; an incomplete block has no decision."""
    blocks = scans.placed(df, [by], [order], "_place").withColumn("block", F.floor(F.col("_place") / frames).cast("int"))
    out = blocks.groupBy(by, "block").agg(F.count("*").alias("n"), F.avg(norm).alias("norm"), F.avg(own).alias("own")).filter(F.col("n") == frames)
    return out.withColumn("accepted", (F.col("norm") > norm_above) & (F.col("own") > own_above))


def choose_imposters(scores: DataFrame, k: int = 10) -> DataFrame:
    """Rows (row, col, score) with `chosen`: the k best other columns of each row, ties to the smaller column."""
    w = Window.partitionBy("row", F.col("row") == F.col("col")).orderBy(F.desc("score"), "col")
    return scores.withColumn("chosen", (F.col("row") != F.col("col")) & (F.row_number().over(w) <= k))


def update_imposters(scores: DataFrame, new: DataFrame, removed: DataFrame, k: int = 10) -> DataFrame:
    """Delete users, replace or add score rows, and choose again."""
    gone = removed.select("user").distinct()
    kept = scores.join(gone.withColumnRenamed("user", "row"), "row", "left_anti").join(gone.withColumnRenamed("user", "col"), "col", "left_anti")
    kept = kept.join(new.select("row", "col"), ["row", "col"], "left_anti").select("row", "col", "score")
    return choose_imposters(kept.unionByName(new.select("row", "col", "score")), k)


def confused_users(scores: DataFrame) -> DataFrame:
    """Users whose own score does not exceed that of the best imposter."""
    s = scores.groupBy("row").agg(F.max(F.when(F.col("row") == F.col("col"), F.col("score"))).alias("own"), F.max(F.when(F.col("row") != F.col("col"), F.col("score"))).alias("other"))
    return s.filter(F.col("own") <= F.col("other"))


def cascade(df: DataFrame, pitch: str, template_pitch: str, within: float = 2.0) -> DataFrame:
    """Pairs near in pitch: the cheap test before a costly match."""
    return df.filter(F.abs(F.col(pitch) - F.col(template_pitch)) <= within)


def components_by_share(df: DataFrame, by: str, weight: str, order: str, percent: float) -> DataFrame:
    """The fewest largest components that hold a share of at least 1 - percent."""
    w = Window.partitionBy(by).orderBy(F.desc(weight), order)
    share = F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col(weight)
    return df.withColumn("_b", share / F.sum(weight).over(Window.partitionBy(by))).filter(F.col("_b") < 1 - percent).drop("_b")


def components_by_ratio(df: DataFrame, by: str, weight: str, order: str, log_ratio: float = 7.0, least: int = 5) -> DataFrame:
    """Components within a log ratio of the total, and the `least` best in any case."""
    w = Window.partitionBy(by)
    near = F.ln(F.sum(weight).over(w)) - F.ln(weight) <= log_ratio
    rank = F.row_number().over(w.orderBy(F.desc(weight), order))
    return df.withColumns({"_near": near, "_rank": rank}).filter(F.col("_near") | (F.col("_rank") <= least)).drop("_near", "_rank")


def threshold_sweep(scores: DataFrame, template: str, spoken: str, score: str, thresholds: Sequence[float]) -> DataFrame:
    """One row for each template and threshold: tp, tn, fp, fn, far (share of other words accepted), frr (share of own ones refused).

    `scores` has one row for each template and utterance; a distance up to the threshold accepts.  Each score is read once
    and counts for all thresholds; a template without other words, or without own ones, has a null rate.
    """
    own = F.col(template).eqNullSafe(F.col(spoken))
    count = lambda test: F.count_if(test)
    sums = []
    for i, t in enumerate(thresholds):
        taken = F.coalesce(F.col(score) <= t, F.lit(False))
        sums += [F.struct(F.lit(float(t)).alias("threshold"), count(taken & own).alias("tp"), count(~taken & ~own).alias("tn"), count(taken & ~own).alias("fp"), count(~taken & own).alias("fn")).alias(f"s{i}")]
    rows = scores.groupBy(template).agg(*sums).select(template, F.explode(F.array(*[f"s{i}" for i in range(len(thresholds))])).alias("s")).select(template, "s.*")
    share = lambda a, b: F.try_divide(F.col(a), F.col(a) + F.col(b))
    return rows.withColumns({"far": share("fp", "tn"), "frr": share("fn", "tp")})
