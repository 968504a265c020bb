"""Seeded random columns that depend on a row's keys alone, so they are the same in any order, partition and retry."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(keys: Sequence[str], seed: int) -> Column:
    """A number from 0 to below 1 with 52 random bits."""
    digest = F.md5(F.concat_ws("|", *keys, F.lit(str(seed))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(2.0**52)


def normal(keys: Sequence[str], seed: int, mean: float = 0.0, deviation: float = 1.0) -> Column:
    """A normal number, from two uniform ones of the seeds 2 * seed and 2 * seed + 1."""
    radius = F.sqrt(-2 * F.ln(1 - uniform(keys, 2 * seed)))
    return mean + deviation * radius * F.cos(2 * math.pi * uniform(keys, 2 * seed + 1))


def integers(keys: Sequence[str], seed: int, low: int, high: int) -> Column:
    """A whole number from low to below high."""
    return (low + F.floor(uniform(keys, seed) * (high - low))).cast("long")


def choice(keys: Sequence[str], seed: int, values: Sequence, weights: Sequence[float] | None = None) -> Column:
    """One of the values, each as likely as its weight."""
    weights = list(weights or [1] * len(values))
    u, total, below, out = uniform(keys, seed), sum(weights), 0.0, None
    for v, w in zip(values[:-1], weights):
        below += w / total
        out = F.when(u < below, F.lit(v)) if out is None else out.when(u < below, F.lit(v))
    return F.lit(values[-1]) if out is None else out.otherwise(F.lit(values[-1]))
