"""Scalar helpers over strings, dates, numbers, arrays and maps, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_strings(x: Column, steps: Sequence[Callable[[Column], Column]]) -> Column:
    """Apply cleaning functions one after the other."""
    return reduce(lambda c, f: f(c), steps, x)


def strip(x: Column) -> Column:
    return F.trim(x)


def remove_punctuation(x: Column, signs: str = "[!#?]") -> Column:
    return F.regexp_replace(x, signs, "")


def title(x: Column) -> Column:
    return F.initcap(x)


def remove_chars(x: Column, chars: str) -> Column:
    return F.translate(x, chars, "")


def digits(x: Column) -> Column:
    return F.regexp_replace(x, r"[^0-9]", "")


def first_match(x: Column, pattern: str) -> Column:
    """First match or NULL."""
    found = F.regexp_extract(x, f"({pattern})", 1)
    return F.when(found != "", found)


def match_position(x: Column, pattern: str) -> Column:
    """Place of the first match from 0, or NULL."""
    at = F.regexp_instr(x, F.lit(f"({pattern})"))
    return F.when(at > 0, at - 1)


def count_of(x: Column, part: str) -> Column:
    """Occurrences of a substring that do not overlap."""
    return ((F.length(x) - F.length(F.replace(x, F.lit(part), F.lit("")))) / len(part)).cast("long")


CJK = "[一-龥]"


def cjk_count(x: Column) -> Column:
    return F.regexp_count(x, F.lit(CJK)).cast("long")


def pad_display(x: Column, width: int) -> Column:
    """Pad with blanks to a display width in which an ideograph takes two places; longer texts stay."""
    fill = F.greatest(F.lit(width) - F.length(x) - cjk_count(x), F.lit(0)).cast("int")
    return F.concat(x, F.repeat(F.lit(" "), fill))


def post_time(x: Column, today: Column) -> Column:
    """Dates such as `MM月dd日 HH:mm`, `今天 HH:mm` or a full time stamp; the first two need the day they were read."""
    clock = F.regexp_extract(x, r"(\d{1,2}:\d{2})", 1)
    month, day = F.regexp_extract(x, "(\\d{1,2})月", 1), F.regexp_extract(x, "月(\\d{1,2})日", 1)
    on_day = F.concat(F.year(today), F.lit("-"), F.lpad(month, 2, "0"), F.lit("-"), F.lpad(day, 2, "0"), F.lit(" "), F.lpad(clock, 5, "0"))
    now = F.concat(F.date_format(today, "yyyy-MM-dd"), F.lit(" "), F.lpad(clock, 5, "0"))
    form = F.lit("yyyy-MM-dd HH:mm")
    return (
        F.when(F.contains(x, F.lit("月")), F.try_to_timestamp(on_day, form))
        .when(F.contains(x, F.lit("今天")), F.try_to_timestamp(now, form))
        .otherwise(F.coalesce(F.try_to_timestamp(F.substring(x, 1, 19), F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(F.substring(x, 1, 16), form)))
    )


def whole_days(later: Column, earlier: Column) -> Column:
    """Whole 24-hour days between two time stamps, rounded down."""
    return F.floor((F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(86_400_000_000)).cast("long")


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def saturate16(x: Column) -> Column:
    return clamp(x, -32768, 32767)


def leading_zeros(x: Column, bits: int = 32) -> Column:
    """Leading zero bits of a positive integer; `bits` for 0."""
    return F.when(x <= 0, F.lit(bits)).otherwise(F.lit(bits) - F.length(F.bin(x))).cast("int")


def integer_sqrt(x: Column) -> Column:
    return F.floor(F.sqrt(x)).cast("long")


def ring_next(i: Column, n: int) -> Column:
    return F.pmod(i + 1, F.lit(n))


def ring_previous(i: Column, n: int) -> Column:
    return F.pmod(i - 1, F.lit(n))


def step_slice(x: Column, start: int, stop: int, step: int) -> Column:
    """x[start:stop:step] for positive steps, from 0."""
    return F.filter(F.slice(x, start + 1, stop - start), lambda v, i: i % step == 0)


def map_get(m: Column, k: Column, default: Column) -> Column:
    return F.coalesce(F.try_element_at(m, k), default)


def invert_map(m: Column) -> Column:
    """Values become keys; of equal values the last key stays."""
    pairs = F.transform(F.map_entries(m), lambda e: F.struct(e["value"].alias("key"), e["key"].alias("value")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def add_unrelated_tags(tags: Column) -> Column:
    """Keep a tag only if no kept one contains it or lies in it, in order."""
    related = lambda acc, t: F.exists(acc, lambda a: F.contains(a, t) | F.contains(t, a))
    return F.aggregate(tags, F.array().cast("array<string>"), lambda acc, t: F.when(related(acc, t), acc).otherwise(F.array_append(acc, t)))


def truthy(x: Column, kind: str) -> Column:
    """What counts as true: numbers other than 0, texts and arrays that are not empty; NULL is false."""
    test = F.length(x) > 0 if kind == "string" else F.size(x) > 0 if kind.startswith(("array", "map")) else x if kind == "boolean" else x != 0
    return F.coalesce(test, F.lit(False))


def recode(x: Column, table: dict) -> Column:
    """Replace values by a table; others stay."""
    out = x
    for old, new in table.items():
        out = F.when(x == F.lit(old), F.lit(new)).otherwise(out)
    return out


def round_product(x: Column, places: int) -> Column:
    """A double times 10^places, rounded half away from zero, and divided again; what is under zero stays so, as -0.0.

    Spark's `round` takes the decimal digits of the number instead: it differs where these, but not the product, end just
    under a half, and has no -0.0.  A number whose product is too large stays as it is.
    """
    y = x * F.lit(10.0**places)
    whole = F.signum(y) * F.round(F.abs(y), 0)
    return F.when(F.isnan(whole) | (F.abs(whole) == float("inf")), x).otherwise(whole / F.lit(10.0**places))
