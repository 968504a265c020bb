"""Missing values, outliers, sampling, binning, scaling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as V
from .aggregates import exact_percentiles, mode
from .relational import any_of, cap, numbered, small_side


def drop_missing(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.dropna("any", subset=list(columns) if columns else None)


def fill_with(df: DataFrame, how: str, columns: Sequence[str]) -> DataFrame:
    """Fill NULL with the column's mean, median or mode (ties to the smaller value)."""
    if how == "mode":
        out = df
        for c in columns:
            out = out.join(F.broadcast(mode(df, c).withColumnRenamed("mode", "_fill")), how="left").withColumn(c, F.coalesce(c, "_fill")).drop("_fill")
        return out
    f = {"mean": F.avg, "median": F.median}[how]
    stats = df.agg(*[f(c).alias(f"_{c}") for c in columns])
    return df.join(F.broadcast(stats)).withColumns({c: F.coalesce(c, f"_{c}") for c in columns}).drop(*[f"_{c}" for c in columns])


def outlier_rows(df: DataFrame, columns: Sequence[str], limit: float = 3.0) -> DataFrame:
    return df.filter(any_of([F.abs(F.col(c)) > limit for c in columns]))


def cap_outliers(df: DataFrame, columns: Sequence[str], limit: float = 3.0) -> DataFrame:
    return df.withColumns({c: cap(F.col(c), limit) for c in columns})


def every_nth(df: DataFrame, n: int, by: Sequence[str]) -> DataFrame:
    return numbered(df, by, "_p").filter(F.col("_p") % n == 0).drop("_p")


def draw(keys: Sequence[str], seed: int) -> Column:
    """A hexadecimal number that depends on the keys and the seed only; sorted as text."""
    return F.md5(F.concat_ws("|", *keys, F.lit(str(seed))).cast("binary"))


def bound(share: float) -> str:
    """Draws below this text are a share of all."""
    return "g" if share >= 1 else f"{int(share * 2**32):08x}"


def simple_sample(df: DataFrame, n: int, keys: Sequence[str], seed: int = 0) -> DataFrame:
    """Exactly n rows (or all) without replacement: the n least hashes, a top-n without a full sort."""
    return df.withColumn("_h", draw(keys, seed)).orderBy("_h", *keys).limit(n).drop("_h")


def _strata(df: DataFrame, stratum: str, share: Mapping, by: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows numbered within their stratum in order of `by` (column _at, from 0), and one row a stratum: its size, how many are wanted.

    A stratum is not put into one task: all rows are numbered by ranges, and a stratum's first number is taken off.
    """
    rows = numbered(df, [stratum, *by], "_p")
    wanted = F.try_element_at(F.create_map(*[F.lit(x) for kv in share.items() for x in kv]), F.col(stratum))
    sizes = rows.groupBy(stratum).agg(F.min("_p").alias("_first"), F.count("*").alias("_n"))
    sizes = sizes.withColumn("_wanted", F.floor(F.col("_n") * wanted)).filter("_wanted > 0")
    return rows.join(small_side(sizes), stratum).withColumn("_at", F.col("_p") - F.col("_first")).drop("_p", "_first"), sizes


def stratified_sample(df: DataFrame, stratum: str, share: Mapping, keys: Sequence[str], seed: int = 0) -> DataFrame:
    """Exactly floor(share * size) rows of each stratum, those with the least hashes; strata without a share give none."""
    rows, _ = _strata(df.withColumn("_h", draw(keys, seed)), stratum, share, ["_h", *keys])
    return rows.filter("_at < _wanted").select(*df.columns)


def stratified_draws(df: DataFrame, stratum: str, share: Mapping, keys: Sequence[str], seed: int = 0, chunk: int = 1_000_000) -> DataFrame:
    """Exactly floor(share * size) draws of each stratum with replacement: column draw, from 0, and the row drawn."""
    rows, sizes = _strata(df, stratum, share, keys)
    chunks = sizes.select(stratum, "_n", "_wanted", F.explode(F.sequence(F.lit(0), F.floor((F.col("_wanted") - 1) / chunk))).alias("_c")).repartition(stratum, "_c")
    last = F.least((F.col("_c") + 1) * chunk, F.col("_wanted")) - 1
    draws = chunks.select(stratum, "_n", F.explode(F.sequence(F.col("_c") * chunk, last)).alias("draw"))
    place = F.conv(F.substring(draw([stratum, "draw"], seed), 1, 15), 16, 10).cast("long") % F.col("_n")
    return draws.select(stratum, "draw", place.alias("_at")).join(rows, [stratum, "_at"]).select("draw", *df.columns)


def sample_with_replacement(df: DataFrame, n: int, by: Sequence[str], seed: int = 0) -> DataFrame:
    """n draws: random positions joined to the numbered rows."""
    rows = numbered(df, by, "_p")
    size = df.count()
    if not size:
        return df
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw"), (F.conv(F.substring(draw(["id"], seed), 1, 8), 16, 10).cast("long") % size).alias("_p"))
    return draws.join(rows, "_p").drop("_p")


def bernoulli_by_class(df: DataFrame, column: str, share: Mapping, keys: Sequence[str], seed: int = 0) -> DataFrame:
    """Each row on its own, by its class: suits streams too."""
    p = F.try_element_at(F.create_map(*[F.lit(x) for k, v in share.items() for x in (k, bound(v))]), F.col(column))
    return df.filter(draw(keys, seed) < p)


def permutation(df: DataFrame, keys: Sequence[str], seed: int = 0) -> DataFrame:
    return df.orderBy(draw(keys, seed), *keys)


def hash_split(df: DataFrame, keys: Sequence[str], shares: Sequence[float], seed: int = 0) -> list[DataFrame]:
    """Disjoint parts that do not depend on order or partitions."""
    edges, out = [0.0], []
    for s in shares:
        edges.append(edges[-1] + s)
    for a, b in zip(edges, edges[1:]):
        out.append(df.filter((draw(keys, seed) >= bound(a)) & (draw(keys, seed) < bound(b if b < 0.999999 else 1.0))))
    return out


def cut(x: Column, edges: Sequence[float], labels: Sequence[str] | None = None, right: bool = True) -> Column:
    """Label of the interval a value lies in, closed on the right (or left); NULL outside."""
    out = F.lit(None).cast("string")
    for i, (a, b) in reversed(list(enumerate(zip(edges, edges[1:])))):
        inside = ((x > a) & (x <= b)) if right else ((x >= a) & (x < b))
        name = labels[i] if labels else f"({a}, {b}]" if right else f"[{a}, {b})"
        out = F.when(inside, F.lit(name)).otherwise(out)
    return out


def cut_code(x: Column, edges: Sequence[float], right: bool = True) -> Column:
    """Place of the interval, -1 outside."""
    return F.coalesce(cut(x, edges, [str(i) for i in range(len(edges) - 1)], right).cast("int"), F.lit(-1))


def cut_equal(df: DataFrame, column: str, bins: int, name: str = "bin") -> DataFrame:
    """Right-closed bins of equal width; the lowest value belongs to the first."""
    x = F.col(column).cast("double")
    edges = df.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    code = F.greatest(F.ceil((x - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)) * bins) - 1, F.lit(0)).cast("int")
    return df.join(F.broadcast(edges)).withColumn(name, code).drop("_lo", "_hi")


def quantile_cut(df: DataFrame, column: str, quantiles: Sequence[float], name: str = "bin") -> DataFrame:
    """Bins between exact quantiles, right-closed; the lowest value belongs to the first."""
    x = F.col(column).cast("double")
    inner = list(quantiles[1:-1])
    edges = exact_percentiles(df, column, inner).withColumnRenamed("percentiles", "_edges")
    code = F.when(x.isNotNull(), F.size(F.filter("_edges", lambda e: x > e)))
    return df.join(F.broadcast(edges)).withColumn(name, code).drop("_edges")


def scale(df: DataFrame, columns: Sequence[str], how: str, fitted_on: DataFrame | None = None) -> DataFrame:
    """minmax: (x - min) / (max - min); zscore: (x - mean) / population deviation.  Statistics come from `fitted_on`."""
    fit = fitted_on if fitted_on is not None else df
    f = {"minmax": lambda c: (F.min(c), F.max(c) - F.min(c)), "zscore": lambda c: (F.avg(c), F.stddev_pop(c))}[how]
    stats = fit.agg(*[e.cast("double").alias(f"_{c}_{i}") for c in columns for i, e in enumerate(f(c))])
    out = df.join(F.broadcast(stats))
    out = out.withColumns({c: (F.col(c) - F.col(f"_{c}_0")) / F.nullif(F.col(f"_{c}_1"), F.lit(0.0)) for c in columns})
    return out.drop(*[f"_{c}_{i}" for c in columns for i in (0, 1)])


def one_hot(df: DataFrame, column: str, values: Sequence, check: bool = True) -> DataFrame:
    """A 0/1 column for each known value; an unknown one raises an error if `check`."""
    x = F.col(column)
    known = F.when(x.isin(*values) | x.isNull(), x)
    safe = F.coalesce(known, F.raise_error(F.concat(F.lit("unknown category: "), x.cast("string"))).cast(dict(df.dtypes)[column])) if check else x
    flag = lambda v: F.when(x.isNull(), 0).otherwise((safe == F.lit(v)).cast("int"))
    return df.withColumns({f"{column}_{v}": flag(v) for v in values})


def cube_root(x: Column) -> Column:
    """Also of negative numbers."""
    return F.cbrt(x)


def normalise_signal(x: Column, low_power: float = 1024.0, gain: float = 256.0) -> Column:
    """Remove the mean, raise quiet frames, saturate to 16 bits."""
    mean = F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / F.size(x)
    saturated = lambda v: F.greatest(F.least(v, F.lit(32767.0)), F.lit(-32768.0))

    def levelled(c: Column) -> Column:
        power = F.aggregate(c, F.lit(0.0), lambda a, v: a + v * v) / F.size(c)
        return V.bound(F.when(power < low_power, gain).otherwise(1.0), lambda g: F.transform(c, lambda v: saturated(v * g)))

    return V.bound(V.bound(mean, lambda m: F.transform(x, lambda v: v - m)), levelled)