"""Aggregations: frequencies, moments, correlation, information, detection measures, social measures."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import whole_days
from ..functions.semantics import divide, log10, sample_kurtosis, sample_skewness


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Values that are not NULL and their number."""
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))


def relative_frequency(df: DataFrame, column: str, count_nulls: bool = True) -> DataFrame:
    """Share of each value; the whole includes the rows with NULL or not."""
    rows = df if count_nulls else df.filter(F.col(column).isNotNull())
    whole = rows.agg(F.count("*").alias("_all"))
    return value_counts(df, column).join(F.broadcast(whole)).withColumn("share", divide(F.col("n"), F.col("_all"))).drop("_all")


def most_common(df: DataFrame, column: str, n: int) -> DataFrame:
    return value_counts(df, column).orderBy(F.desc("n"), column).limit(n)


def describe(df: DataFrame, column: str, percentiles: Sequence[float] = (0.25, 0.5, 0.75, 0.997)) -> DataFrame:
    """Exact statistics of a number column."""
    x = F.col(column)
    names = [f"p{str(p * 100).rstrip('0').rstrip('.').replace('.', '_')}" for p in percentiles]
    one = df.agg(F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))
    ranks = exact_percentiles(df, column, percentiles)
    return one.join(F.broadcast(ranks)).select("count", "mean", "std", "min", *[F.col("percentiles")[i].alias(n) for i, n in enumerate(names)], "max")


def exact_percentiles(df: DataFrame, column: str, percentiles: Sequence[float], ranges: int = 64) -> DataFrame:
    """One row with `percentiles`, interpolated between the two nearest values; NULLs do not count.

    Values are counted first.  Fixed bounds, from an approximate quantile, cut them into ranges of about equal size; the
    ranges' totals (a few rows) give every range the rank of its first value, so each is summed up on its own and no
    task or buffer holds all values.
    """
    x = F.col(column).cast("double")
    counted = df.filter(x.isNotNull()).groupBy(x.alias("x")).agg(F.count("*").alias("n"))
    bounds = sorted(set(counted.approxQuantile("x", [i / ranges for i in range(1, ranges)], 0.01)))
    placed = counted.withColumn("part", F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("x"))) if bounds else F.lit(0))
    totals = {r[0]: r[1] for r in placed.groupBy("part").agg(F.sum("n")).collect()}  # one row per range
    before, rows = 0, {}
    for part in sorted(totals):
        rows[part] = before
        before += totals[part]
    if not before:
        return df.agg(F.array(*[F.lit(None).cast("double")] * len(percentiles)).alias("percentiles"))
    first = F.element_at(F.create_map(*[F.lit(v) for kv in rows.items() for v in kv]), F.col("part"))
    upto = first + F.sum("n").over(Window.partitionBy("part").orderBy("x"))
    at = lambda rank: F.max(F.when((F.col("upto") - F.col("n") <= rank) & (rank < F.col("upto")), F.col("x")))
    values = []
    for p in percentiles:
        place = p * (before - 1)
        low, part = int(place), place - int(place)
        values.append(at(low) + part * (at(min(low + 1, before - 1)) - at(low)))
    return placed.withColumn("upto", upto).agg(F.array(*values).alias("percentiles"))


def describe_text(df: DataFrame, column: str) -> DataFrame:
    """count, unique, top (most frequent, ties to the smaller) and its freq."""
    counts = value_counts(df, column)
    return counts.agg(F.sum("n").alias("count"), F.count("*").alias("unique"), F.min(F.struct(-F.col("n"), F.col(column).alias("v"))).alias("_top")).select(
        "count", "unique", F.col("_top.v").alias("top"), (-F.col("_top.col1")).alias("freq")
    )


def mode(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Most frequent value; ties to the smaller."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("n"))
    return counts.groupBy(*by).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(column).alias("v"))).alias("_m")).select(*by, F.col("_m.v").alias("mode"))


def moments(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Bias-corrected skewness and excess kurtosis."""
    x = F.col(column).cast("double")
    return df.groupBy(*by).agg(sample_skewness(x).alias("skew"), sample_kurtosis(x).alias("kurt"))


def missing_ratio(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of missing values of each column, long form; one pass."""
    one = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in columns])
    return one.unpivot([], list(columns), "column", "ratio")


def correlation(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair in one pass, long form."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    one = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}|{b}") for a, b in pairs])
    long = one.unpivot([], [f"{a}|{b}" for a, b in pairs], "pair", "r")
    return long.select(F.substring_index("pair", "|", 1).alias("x"), F.substring_index("pair", "|", -1).alias("y"), "r")


def bucket(x: Column, low: Column, high: Column, bins: int) -> Column:
    """Equal-width bin from 0; the last one includes the upper edge."""
    return F.least(F.floor((x - low) / F.nullif(high - low, F.lit(0.0)) * bins), F.lit(bins - 1)).cast("int")


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """bin, lower edge and count; empty bins are left out."""
    x = F.col(column).cast("double")
    edges = df.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    return df.filter(x.isNotNull()).join(F.broadcast(edges)).groupBy(bucket(x, F.col("_lo"), F.col("_hi"), bins).alias("bin"), (F.col("_lo")).alias("_lo"), F.col("_hi")).agg(F.count("*").alias("n")).select(
        "bin", (F.col("_lo") + F.col("bin") * (F.col("_hi") - F.col("_lo")) / bins).alias("lower"), "n"
    )


def mutual_information(df: DataFrame, x: str, y: str, bins: int = 10, smooth: bool = True) -> DataFrame:
    """Mutual information over the sum of the entropies, natural logarithm; every cell gets 1 more if `smooth`."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    edges = both.agg(*[f(F.col(c).cast("double")).alias(f"_{c}_{n}") for c in (x, y) for n, f in (("lo", F.min), ("hi", F.max))])
    binned = both.join(F.broadcast(edges)).select(*[bucket(F.col(c).cast("double"), F.col(f"_{c}_lo"), F.col(f"_{c}_hi"), bins).alias(n) for c, n in ((x, "i"), (y, "j"))])
    cells = binned.groupBy("i", "j").agg(F.count("*").alias("n"))
    if smooth:
        spark = df.sparkSession
        grid = spark.range(bins * bins).select((F.col("id") % bins).cast("int").alias("i"), F.floor(F.col("id") / bins).cast("int").alias("j"))
        cells = grid.join(cells, ["i", "j"], "left").select("i", "j", (F.coalesce("n", F.lit(0)) + 1).alias("n"))
    p = cells.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))  # at most bins * bins rows
    p = p.withColumn("pi", F.sum("p").over(Window.partitionBy("i"))).withColumn("pj", F.sum("p").over(Window.partitionBy("j")))
    info = p.agg(F.sum(F.col("p") * F.ln(F.col("p") / (F.col("pi") * F.col("pj")))).alias("mi"), (-F.sum(F.col("p") * F.ln("pi"))).alias("hx"), (-F.sum(F.col("p") * F.ln("pj"))).alias("hy"))
    return info.select(divide(F.col("mi"), F.col("hx") + F.col("hy")).alias("mi"))


def detection_counts(df: DataFrame, score: str, truth: str, thresholds: Sequence[float], by: Sequence[str] = (), strict: bool = False) -> DataFrame:
    """tp, fp, tn, fn, FAR and FRR for every threshold; a row is accepted at or below it (below it if `strict`).

    All thresholds are counted in one pass over the scores.
    """
    accepted = lambda t: (F.col(score) < t) if strict else (F.col(score) <= t)
    cells = lambda t: F.struct(
        F.lit(float(t)).alias("threshold"), F.count_if(accepted(t) & F.col(truth)).alias("tp"), F.count_if(accepted(t) & ~F.col(truth)).alias("fp"),
        F.count_if(~accepted(t) & ~F.col(truth)).alias("tn"), F.count_if(~accepted(t) & F.col(truth)).alias("fn"),
    )
    rows = df.groupBy(*by).agg(F.array(*[cells(t) for t in thresholds]).alias("_c")).select(*by, F.inline("_c"))
    return rows.withColumns({"far": divide(F.col("fp"), F.col("fp") + F.col("tn")), "frr": divide(F.col("fn"), F.col("fn") + F.col("tp"))})


def confusion_matrix(df: DataFrame, truth: str, predicted: str, labels: Sequence) -> DataFrame:
    return df.groupBy(truth).pivot(predicted, list(labels)).agg(F.count(F.lit(1))).na.fill(0)


def classification_measures(df: DataFrame, truth: str, predicted: str, positive=1) -> DataFrame:
    """accuracy, precision, recall and F1 of one class."""
    t, p = F.col(truth) == positive, F.col(predicted) == positive
    c = df.agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(F.col(truth) == F.col(predicted)).alias("right"), F.count("*").alias("n"))
    c = c.withColumns({"precision": divide(F.col("tp"), F.col("tp") + F.col("fp")), "recall": divide(F.col("tp"), F.col("tp") + F.col("fn")), "accuracy": divide(F.col("right"), F.col("n"))})
    return c.select("accuracy", "precision", "recall", divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"))


def argmax_error(df: DataFrame, scores: str, label: str) -> DataFrame:
    """Error rate in percent of the place of the largest score."""
    from ..functions.arrays import argmax

    return df.agg((100 - 100 * F.avg((argmax(F.col(scores)) == F.col(label)).cast("double"))).alias("error_rate"))


def h_index(df: DataFrame, by: str, cited: str) -> DataFrame:
    """Largest h such that h items have at least h: the best of min(value, items with at least it) over the values.

    Items are counted by value first, so a key's window holds its different values and not its items.
    """
    values = df.groupBy(by, cited).agg(F.count("*").alias("_n"))
    at_least = F.sum("_n").over(Window.partitionBy(by).orderBy(F.desc(cited)).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return values.withColumn("_h", F.least(F.floor(cited), at_least)).groupBy(by).agg(F.greatest(F.max(F.when(F.col(cited).isNotNull(), F.col("_h"))), F.lit(0)).cast("long").alias("h_index"))


def influence(df: DataFrame, fans: str, follows: str, latest: str, hundredth: str, posts: int = 100) -> DataFrame:
    """Posts a day, log10 of fans, log10(fans / follows + 1) and their product; NULL where one is undefined."""
    days = whole_days(F.col(latest), F.col(hundredth))
    rate, size = divide(F.lit(posts), days), log10(F.col(fans))
    cover = log10(divide(F.col(fans), F.col(follows)) + 1)
    return df.withColumns({"rate": rate, "magnitude": size, "coverage": cover, "influence": rate * size * cover})


def log_sum_exp(df: DataFrame, by: Sequence[str], x: str) -> DataFrame:
    """ln of the sum of exponentials of each group: sums about whole numbers first, so a hot group is added up where its rows are."""
    whole = F.floor(F.col(x))
    parts = df.groupBy(*by, whole.alias("_b")).agg(F.sum(F.exp(F.col(x) - whole)).alias("_s"))
    held = parts.groupBy(*by).agg(F.max("_b").alias("_m"), F.collect_list(F.struct("_b", "_s")).alias("_p"))
    total = F.aggregate("_p", F.lit(0.0), lambda a, v: a + F.coalesce(v["_s"] * F.exp(v["_b"] - F.col("_m")), F.lit(0.0)))
    return held.select(*by, (F.col("_m") + F.ln(total)).alias("log_sum_exp"))


def psnr(df: DataFrame, a: str, b: str, peak: float = 255.0) -> DataFrame:
    mse = F.avg((F.col(a) - F.col(b)) * (F.col(a) - F.col(b)))
    return df.agg(mse.alias("mse")).select("mse", F.when(F.col("mse") > 0, 10 * F.log10(F.lit(peak * peak) / F.col("mse"))).alias("psnr"))


def group_lists(df: DataFrame, by: str, value: str) -> DataFrame:
    return df.groupBy(by).agg(F.array_sort(F.collect_list(value)).alias("items"))


def chunked_counts(chunks: Sequence[DataFrame], column: str) -> DataFrame:
    """Counts of pieces that are read on their own, added up; a value missing from a piece counts 0 there."""
    parts = [value_counts(c, column) for c in chunks]
    return reduce(lambda a, b: a.unionByName(b), parts).groupBy(column).agg(F.sum("n").alias("n"))
