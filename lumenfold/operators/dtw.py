"""Dynamic time warping of feature sequences as a fold over the input's frames, in the JVM.

Sequences are arrays of frames.  A column of the table is an array of cells (d: least sum of costs, n: length of its path,
at: first input frame matched by each template row so far); only the last column is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as V

FAR = 500.0  # stands for infinity in scores
DIAGONAL, DOUBLE = 2**0.5, 5**0.5


def _units(frames: Column) -> Column:
    return F.transform(frames, lambda f: F.coalesce(V.unit(f), F.transform(f, lambda _: F.lit(0.0))))


def _cost(a: Column, b: Column, kind: str) -> Column:
    if kind == "cosine":
        return F.greatest(1 - V.dot(a, b), F.lit(0.0))
    return V.total(F.zip_with(a, b, lambda p, q: F.abs(p - q))) if kind == "manhattan" else V.euclidean(a, b)


def _cell(d: Column, n: Column, at: Column) -> Column:
    return F.struct(d.cast("double").alias("d"), n.cast("double").alias("n"), at.cast("array<int>").alias("at"))


def _border(d: Column, row: Column, t: Column, path: bool) -> Column:
    """A cell where paths begin: rows above it have no match."""
    at = F.concat(F.array_repeat(F.lit(-1), row), F.array(t)) if path else F.array()
    return _cell(d, F.lit(0.0), at)


def warp(x: Column, template: Column, kind: str = "cosine", subsequence: bool = False, transition: str = "levenshtein", best: bool = False, path: bool = False) -> Column:
    """struct(score, at): least cost by path length, and with `path` the input frame of each template row (-1: none).

    `subsequence` lets a match begin anywhere in the input; `best` takes the least end at or after 0.6 of the template's
    length (the latest of equals), else the input's last frame counts.  An empty or null side scores 500.
    """
    levenshtein = transition == "levenshtein"
    rows = F.size(template)
    nothing = F.struct(F.lit(FAR).alias("score"), F.array_repeat(F.lit(-1), F.greatest(F.coalesce(rows, F.lit(0)), F.lit(0))).alias("at"))
    places = F.when(rows > 1, F.sequence(F.lit(1), rows - 1)).otherwise(F.array().cast("array<int>"))

    def start(c: Column) -> Column:
        """The first column: sums down the template, or nothing below its first row."""
        top = F.array(_border(F.element_at(c, 1), F.lit(0), F.lit(0), path))
        below = lambda acc, i: F.element_at(acc, -1)["d"] + F.element_at(c, i + 1) if levenshtein else F.lit(FAR)
        return F.aggregate(places, top, lambda acc, i: F.array_append(acc, _border(below(acc, i), i, F.lit(0), path)))

    def step(last: Column, c: Column, t: Column) -> Column:
        here = F.array(t)
        extend = lambda cell, more: F.concat(cell["at"], more) if path else cell["at"]

        def grow(acc: Column, i: Column) -> Column:
            match, insert = F.element_at(last, i), F.element_at(last, i + 1)
            skip = F.element_at(acc, -1) if levenshtein else F.get(last, i - 2)
            away = F.coalesce(skip["d"], F.lit(FAR))
            least = F.least(match["d"], insert["d"], away)
            skipped = _cell(away, skip["n"] + (1.0 if levenshtein else DOUBLE), extend(skip, here if levenshtein else F.concat(F.array(F.lit(-1)), here)))
            matched, inserted = _cell(match["d"], match["n"] + DIAGONAL, extend(match, here)), _cell(insert["d"], insert["n"] + 1.0, insert["at"])
            pick = F.when(match["d"] == least, matched).when(insert["d"] == least, inserted).otherwise(skipped)
            return F.array_append(acc, F.transform(F.array(pick), lambda p: _cell(p["d"] + F.element_at(c, i + 1), p["n"], p["at"]))[0])

        first = F.element_at(c, 1) if subsequence else F.element_at(last, 1)["d"] + F.element_at(c, 1)
        return F.aggregate(places, F.array(_border(first, F.lit(0), t, path)), grow)

    units = _units(template)
    costs = F.transform(_units(x), lambda f: F.transform(units, lambda g: _cost(f, g, kind)))

    def fold(c: Column) -> Column:
        begin = start(F.element_at(c, 1))
        state = F.struct(begin.alias("last"), F.array(F.element_at(begin, -1)).alias("ends"), F.lit(1).alias("t"))

        def move(s: Column, cost: Column) -> Column:
            column = F.array(step(s["last"], cost, s["t"]))  # bound once by the transform below
            return F.transform(column, lambda new: F.struct(new.alias("last"), F.array_append(s["ends"], F.element_at(new, -1)).alias("ends"), (s["t"] + 1).alias("t")))[0]

        return F.aggregate(F.slice(c, 2, F.size(c)), state, move, lambda s: s["ends"])

    def result(ends: Column) -> Column:
        if best:
            tail = F.slice(ends, F.floor(rows * 0.6).cast("int") + 1, F.size(ends))
            goal = F.aggregate(F.slice(tail, 2, F.size(tail)), F.get(tail, F.lit(0)), lambda a, b: F.when(b["d"] <= a["d"], b).otherwise(a))
        else:
            goal = F.element_at(ends, -1)
        score = lambda g: F.greatest(F.when(g["n"] > 0, g["d"] / g["n"]).otherwise(g["d"]), F.lit(0.0))
        return F.transform(F.array(goal), lambda g: F.when(g.isNotNull(), F.struct(score(g).alias("score"), g["at"].alias("at"))).otherwise(nothing))[0]

    found = F.transform(F.array(costs), lambda c: F.transform(F.array(fold(c)), result)[0])[0]
    return F.when((F.size(x) > 0) & (rows > 0), found).otherwise(nothing)


def dtw_pairs(pairs: DataFrame, **options) -> DataFrame:
    """Rows with id_x, x, id_y, y to id_x, id_y, score; pairs are independent rows, so nothing is shuffled."""
    return pairs.select("id_x", "id_y", warp(F.col("x"), F.col("y"), **options)["score"].alias("score"))


def all_pairs(templates: DataFrame, utterances: DataFrame) -> DataFrame:
    """Every template with every utterance; templates are few and broadcast after a count."""
    from .relational import small_side

    t = templates.select(F.col("id").alias("id_y"), F.col("frames").alias("y"))
    return utterances.select(F.col("id").alias("id_x"), F.col("frames").alias("x")).join(small_side(t, 10_000))


def fuse_by_key(templates: DataFrame, key: str, **options) -> DataFrame:
    """Rows (key, id, frames) to one fused template a key; enrolments of a key are a handful.

    The one nearest to all others leads (ties to the smaller id); the rest, weighted 2 less their distance, are averaged in
    along their paths, and where a path skips a row the lead's own frame counts.
    """
    a = templates.select(key, F.col("id").alias("lead"), F.col("frames").alias("y"))
    b = templates.select(key, "id", F.col("frames").alias("x"))
    same = F.col("lead") == F.col("id")
    pairs = a.join(b, key).withColumn("w", F.when(~same, warp(F.col("x"), F.col("y"), path=True, **options)))
    sums = pairs.groupBy(key, "lead").agg(F.sum(F.coalesce("w.score", F.lit(0.0))).alias("total"))
    chosen = sums.groupBy(key).agg(F.min_by("lead", F.struct("total", "lead")).alias("lead"))
    led = pairs.join(chosen, [key, "lead"]).withColumn("weight", F.when(same, 2.0).otherwise(2.0 - F.col("w.score")))
    rows = led.select(key, "weight", "x", "w", F.posexplode("y").alias("row", "own"))
    there = F.get("w.at", F.col("row"))
    used = rows.select(key, "row", "weight", F.posexplode(F.when(there >= 0, F.get("x", there)).otherwise(F.col("own"))).alias("i", "v"))
    cells = used.groupBy(key, "row", "i").agg((F.sum(F.col("weight") * F.col("v")) / F.sum("weight")).alias("v"))
    ordered = lambda *c: F.array_sort(F.collect_list(F.struct(*c)))
    lines = cells.groupBy(key, "row").agg(F.transform(ordered("i", "v"), lambda s: s["v"]).alias("f"))
    return lines.groupBy(key).agg(F.transform(ordered("row", "f"), lambda s: s["f"]).alias("frames"))
