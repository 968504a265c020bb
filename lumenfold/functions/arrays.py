"""Kernels over array columns: dot product, distances, top components, transposition."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO = 0.0


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(ZERO), lambda a, v: a + v)


def bound(x: Column, f) -> Column:
    """f(x) with x computed once; a value used inside a lambda is else computed again for every element."""
    return F.transform(F.array(x), f)[0]


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x.cast("array<double>"), y.cast("array<double>"), lambda a, b: a * b))


def norm(x: Column) -> Column:
    return F.sqrt(dot(x, x))


def l2_squared(x: Column, y: Column) -> Column:
    return total(F.zip_with(x.cast("array<double>"), y.cast("array<double>"), lambda a, b: (a - b) * (a - b)))


def euclidean(x: Column, y: Column) -> Column:
    return F.sqrt(l2_squared(x, y))


def unit(x: Column) -> Column:
    """Divided by the norm; NULL for a zero vector."""
    return bound(norm(x), lambda n: F.when(n > 0, F.transform(x.cast("array<double>"), lambda v: v / n)))


def cosine_distance(x: Column, y: Column) -> Column:
    return 1 - dot(x, y) / F.nullif(norm(x) * norm(y), F.lit(ZERO))


def unit_euclidean(x: Column, y: Column) -> Column:
    return euclidean(unit(x), unit(y))


def unit_manhattan(x: Column, y: Column) -> Column:
    return total(F.zip_with(unit(x), unit(y), lambda a, b: F.abs(a - b)))


def bhattacharyya(mean_a: Column, var_a: Column, mean_b: Column, var_b: Column) -> Column:
    """Distance of two Gaussians with diagonal covariance; logarithms are summed, so products cannot overflow."""
    var = F.zip_with(var_a, var_b, lambda a, b: (a + b) / 2)
    diff = F.zip_with(mean_a, mean_b, lambda a, b: (a - b) * (a - b))
    spread = F.zip_with(var, F.zip_with(var_a, var_b, lambda a, b: F.ln(a) + F.ln(b)), lambda v, logs: F.ln(v) - logs / 2)
    return total(F.zip_with(diff, var, lambda d, v: d / v)) / 8 + total(spread) / 2


def top_indices(x: Column, k: int) -> Column:
    """Places, from 0, of the k largest values; ties to the earlier place."""
    ranked = F.array_sort(F.transform(x, lambda v, i: F.struct((-v).alias("v"), i.alias("i"))))
    return F.transform(F.slice(ranked, 1, k), lambda s: s["i"])


def argmax(x: Column) -> Column:
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


def argmin(x: Column) -> Column:
    return (F.array_position(x, F.array_min(x)) - 1).cast("int")


def second_difference(x: Column) -> Column:
    """x[i+1] - 2 x[i] + x[i-1], without the ends."""
    n = F.size(x)
    inner = F.slice(x, 2, F.greatest(n - 2, F.lit(0)))
    return F.transform(inner, lambda v, i: F.element_at(x, i + 3) - 2 * v + F.element_at(x, i + 1))


def log_sum_exp(x: Column) -> Column:
    """ln of the sum of exponentials, about the largest value."""
    return bound(x, lambda y: bound(F.array_max(y), lambda m: m + F.ln(F.aggregate(y, F.lit(ZERO), lambda a, v: a + F.exp(v - m)))))


def log_gauss(x: Column, mean: Column, var: Column, weight: Column) -> Column:
    """Weighted log density of a Gaussian with diagonal covariance."""
    import math

    logs = F.aggregate(var, F.lit(ZERO), lambda a, v: a + F.ln(v) + math.log(2 * math.pi))
    far = total(F.zip_with(F.zip_with(x, mean, lambda a, b: (a - b) * (a - b)), var, lambda d, v: d / v))
    return F.ln(weight) - logs / 2 - far / 2


def zero_crossings(x: Column) -> Column:
    """Sign changes between neighbours (0 counts as positive), by length."""
    changes = F.filter(F.transform(F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0))), lambda v, i: ((v >= 0) != (F.element_at(x, i + 1) >= 0))), lambda b: b)
    return F.size(changes) / F.nullif(F.size(x), F.lit(0))


def mean_abs(x: Column) -> Column:
    return F.aggregate(x, F.lit(ZERO), lambda a, v: a + F.abs(v)) / F.nullif(F.size(x), F.lit(0))
