"""Recurrences over the ordered rows of a key, in blocks, so that a hot key is many tasks.

A step such as y = factor * y + term or y = clip(y + add) is a map, and the maps of a block of rows compose to one map of
the same form.  Blocks of `SIZE` rows are composed in parallel, the maps of the blocks are scanned in the same way, and each block then runs from
the value that the one before it ends with.  With n rows of a key there are log n / log SIZE levels; no group has over
SIZE rows, and all of it is aggregation of Column expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

SIZE = 64


def placed(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "place") -> DataFrame:
    """Add each row's place, from 0, among the rows of its key in this order, without one task for a key.

    Rows are dealt out by ranges of (key, order) and numbered inside a range; only a key that goes on from one range to
    the next needs the number of its rows before, which is at most one key a range.  Rows equal in key and order get
    different places in any order.
    """
    ranges = cut(df.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()))
    inside = Window.partitionBy("_range", *by).orderBy(*order)
    rows = ranges.withColumn("_inside", F.row_number().over(inside) - 1)
    sizes = ranges.groupBy(*by, "_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.withColumn("_before", before).filter("_before > 0").withColumnsRenamed({c: f"_key_{c}" for c in by}).withColumnRenamed("_range", "_from").drop("_n")
    same = F.col("_range") == F.col("_from")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_key_{c}"))
    out = rows.join(F.broadcast(sizes), same, "left").withColumn(name, (F.col("_inside") + F.coalesce("_before", F.lit(0))).cast("long"))
    return out.drop("_range", "_from", "_inside", "_before", *[f"_key_{c}" for c in by])


@dataclass(frozen=True)
class Form:
    """Maps of one kind: `fields` name their numbers, `compose` is the map that applies m and then x, `apply` its value at y.

    y is null before the first row.
    """

    fields: tuple[str, ...]
    compose: Callable[[Column, Column], Column]
    apply: Callable[[Column, Column], Column]
    kind: str = "double"


def affine(kind: str = "double") -> Form:
    """y = a * y + b, for numbers or for arrays b; before the first row y is 0."""
    step = (lambda a, y, b: F.zip_with(y, b, lambda u, v: a * u + v)) if kind.startswith("array") else (lambda a, y, b: a * y + b)
    return Form(
        ("a", "b"), lambda m, x: F.struct((m["a"] * x["a"]).alias("a"), step(x["a"], m["b"], x["b"]).alias("b")), lambda x, y: F.when(y.isNull(), x["b"]).otherwise(step(x["a"], y, x["b"])), kind
    )


def _clip(v: Column, x: Column) -> Column:
    return F.least(F.greatest(v, x["low"]), x["high"])


# y = y + add, not under low and not over high; before the first row y is 0.
CLIPPED = Form(
    ("add", "low", "high"),
    lambda m, x: F.struct((m["add"] + x["add"]).alias("add"), _clip(m["low"] + x["add"], x).alias("low"), _clip(m["high"] + x["add"], x).alias("high")),
    lambda x, y: _clip(F.coalesce(y, F.lit(0.0)) + x["add"], x),
)


def _blocks(steps: DataFrame, by: Sequence[str], form: Form, extra: Sequence[str] = ()) -> DataFrame:
    """Rows (key, place, fields) to one row for each block: its steps in order."""
    return steps.groupBy(*by, F.floor(F.col("place") / SIZE).alias("block")).agg(F.array_sort(F.collect_list(F.struct("place", *form.fields, *extra))).alias("steps"))


def _composed(blocks: DataFrame, by: Sequence[str], form: Form) -> DataFrame:
    """The map of each block, as a step of the next level."""
    s = F.col("steps")
    first = F.struct(*[s[0][f].alias(f) for f in form.fields])
    total = F.aggregate(F.slice(s, 2, F.size(s)), first, form.compose)
    return blocks.select(*by, F.col("block").alias("place"), total.alias("m")).select(*by, "place", *[F.col(f"m.{f}").alias(f) for f in form.fields])


def _ends(steps: DataFrame, by: Sequence[str], form: Form, most: int) -> DataFrame:
    """(key, place, y): the value after each step; `most` is the largest place."""
    blocks = _started(_blocks(steps, by, form), by, form, most)
    return blocks.select(*by, F.explode(_values(form)).alias("x")).select(*by, F.col("x.place").alias("place"), F.col("x.y").alias("y"))


def _started(blocks: DataFrame, by: Sequence[str], form: Form, most: int) -> DataFrame:
    """Add `carry`, the value with which the block before ends."""
    if most < SIZE:
        return blocks.withColumn("carry", F.lit(None).cast(form.kind))
    ends = _ends(_composed(blocks, by, form), by, form, most // SIZE)
    before = ends.select(*[F.col(c).alias(f"_key_{c}") for c in by], (F.col("place") + 1).alias("_next"), F.col("y").alias("carry"))
    same = F.col("block") == F.col("_next")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_key_{c}"))
    return blocks.join(before, same, "left").drop("_next", *[f"_key_{c}" for c in by])


def _values(form: Form) -> Column:
    """The steps of a block with the value y after each and the value before it."""
    start = F.struct(F.col("carry").alias("y"), F.array().cast(f"array<struct<y:{form.kind},before:{form.kind}>>").alias("ys"))

    def step(acc: Column, x: Column) -> Column:
        y = form.apply(x, acc["y"])
        return F.struct(y.alias("y"), F.array_append(acc["ys"], F.struct(y.alias("y"), acc["y"].alias("before"))).alias("ys"))

    return F.zip_with("steps", F.aggregate("steps", start, step, lambda acc: acc["ys"]), lambda s, v: s.withField("y", v["y"]).withField("before", v["before"]))


def _largest(df: DataFrame, place: str) -> int:
    return df.agg(F.max(place)).first()[0] or 0


def scan(df: DataFrame, by: Sequence[str], place: str, maps: Mapping[str, Column], form: Form, name: str, before: str | None = None) -> DataFrame:
    """Add the value after each row's map, over the rows of each key in order of `place`, and the value before it if named.

    `place` numbers the rows of a key from 0 without gaps or repeats, as `placed` does.  The keys may be null, which is
    one key.
    """
    new = [c for c in (name, before) if c]
    rows = df.select(
        *by, F.col(place).cast("long").alias("place"), *[maps[f].alias(f) for f in form.fields], F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in by and c not in new]).alias("row")
    )
    blocks = _started(_blocks(rows, by, form, ["row"]), by, form, _largest(df, place))
    out = blocks.select(*by, F.explode(_values(form)).alias("x"))
    kept = [F.col(c) if c in by else F.col(f"x.row.`{c}`").alias(c) for c in df.columns if c not in new]
    return out.select(*kept, F.col("x.y").alias(name), *([F.col("x.before").alias(before)] if before else []))


def _affine_maps(factor: Column, term: Column) -> dict[str, Column]:
    skip = factor.isNull() | term.isNull()
    return {"a": F.when(skip, 1.0).otherwise(factor).cast("double"), "b": F.when(skip, 0.0).otherwise(term).cast("double")}


def affine_scan(df: DataFrame, by: Sequence[str], place: str, factor: Column, term: Column, name: str) -> DataFrame:
    """Add y[t] = factor[t] * y[t - 1] + term[t] over the rows of each key, from 0, in order of `place`.

    `term` is a number or an array of numbers, all of one length; a null factor or number leaves y as it is.
    """
    if df.select(term.alias("t")).schema["t"].dataType.simpleString().startswith("array"):
        return scan(df, by, place, {"a": factor.cast("double"), "b": term.cast("array<double>")}, affine("array<double>"), name)
    return scan(df, by, place, _affine_maps(factor, term), affine(), name)


def affine_total(df: DataFrame, by: Sequence[str], place: str, factor: Column, term: Column, name: str) -> DataFrame:
    """One row for each key: the last value of the recurrence of `affine_scan`."""
    steps = df.select(*by, F.col(place).cast("long").alias("place"), *[c.alias(f) for f, c in _affine_maps(factor, term).items()])
    most = _largest(df, place)
    while True:
        steps = _composed(_blocks(steps, by, affine()), by, affine())
        if most < SIZE:
            return steps.select(*by, F.col("b").alias(name))
        most //= SIZE


def clipped_scan(df: DataFrame, by: Sequence[str], place: str, add: Column, low: Column, high: Column, name: str, before: str | None = None) -> DataFrame:
    """Add a level that each row changes by `add` but not under `low` and not over `high`; it starts at 0."""
    return scan(df, by, place, {"add": add.cast("double"), "low": low.cast("double"), "high": high.cast("double")}, CLIPPED, name, before)


def moving_average(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, keep: float, name: str) -> DataFrame:
    """Add the exponential moving average that starts with the first value: y = keep * y + (1 - keep) * value."""
    rows = placed(df, by, order, "_place")
    return affine_scan(rows, by, "_place", *_average(F.col("_place"), F.col(value), keep), name).drop("_place")


def _average(place: Column, value: Column, keep: float) -> tuple[Column, Column]:
    return F.when(place == 0, 0.0).otherwise(keep), F.when(place == 0, value).otherwise(value * (1 - keep))


def last_average(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, keep: float, name: str) -> DataFrame:
    """One row for each key: its last moving average."""
    rows = placed(df.select(*by, *[c for c in order if c not in (*by, value)], value), by, order, "_place")
    return affine_total(rows, by, "_place", *_average(F.col("_place"), F.col(value), keep), name)
