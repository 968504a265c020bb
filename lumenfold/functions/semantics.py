"""Decisions on nulls, NaN, rounding and moments, in one place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing numbers have one form, NULL; without this an average over NaN is NaN and a count counts it."""
    return df.withColumns({n: F.nanvl(F.col(f"`{n}`"), F.lit(None).cast(t)) for n, t in df.dtypes if t in ("double", "float")})


def sample_skewness(x: Column) -> Column:
    """Bias-corrected skewness; NULL below three values or without spread."""
    n = F.count(x).cast("double")
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))


def sample_kurtosis(x: Column) -> Column:
    """Bias-corrected excess kurtosis; NULL below four values."""
    n = F.count(x).cast("double")
    return F.when(n > 3, ((n + 1) * F.kurtosis(x) + 6) * (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0)))


def divide(a: Column, b: Column) -> Column:
    """Quotient as double; NULL where the divisor is 0 or NULL."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def log10(x: Column) -> Column:
    """NULL outside the positive numbers."""
    return F.when(x > 0, F.log10(x))


def key(x: Column) -> Column:
    """A join key of mixed origin as text."""
    return x.cast("string")
