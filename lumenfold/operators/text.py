"""Text features and record extraction."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import first_match, match_position

# Feature names and the substrings (of the lower-cased text between blanks) that switch them on.
KEYWORDS: dict[str, tuple[str, ...]] = {
    "hasAddict": (" addict",), "hasAwesome": ("awesome",), "hasBroken": ("broke",), "hasBad": (" bad",), "hasBug": (" bug",),
    "hasCant": ("cant", "can't"), "hasCrash": ("crash",), "hasCool": ("cool",), "hasDifficult": ("difficult",), "hasDisaster": ("disaster",),
    "hasDown": (" down",), "hasDont": ("dont", "don't", "do not", "does not", "doesn't"), "hasEasy": (" easy",), "hasExclaim": ("!",),
    "hasExcite": (" excite",), "hasExpense": ("expense", "expensive"), "hasFail": (" fail",), "hasFast": (" fast",), "hasFix": (" fix",),
    "hasFree": (" free",), "hasFrowny": (":(", "):"), "hasFuck": ("fuck",), "hasGood": ("good", "great"), "hasHappy": (" happy", " happi"),
    "hasHate": ("hate",), "hasHeart": ("heart", "<3"), "hasIssue": (" issue",), "hasIncredible": ("incredible",), "hasInterest": ("interest",),
    "hasLike": (" like",), "hasLol": (" lol",), "hasLove": ("love", "loving"), "hasLose": (" lose",), "hasNeat": ("neat",), "hasNever": (" never",),
    "hasNice": (" nice",), "hasPoor": ("poor",), "hasPerfect": ("perfect",), "hasPlease": ("please",), "hasSerious": ("serious",), "hasShit": ("shit",),
    "hasSlow": (" slow",), "hasSmiley": (":)", ":d", "(:"), "hasSuck": ("suck",), "hasTerrible": ("terrible",), "hasThanks": ("thank",),
    "hasTrouble": ("trouble",), "hasUnhappy": ("unhapp",), "hasWin": (" win ", "winner", "winning"), "hasWinky": (";)",), "hasWow": ("wow", "omg"),
}


def keyword_vector(text: Column, keywords: Mapping[str, Sequence[str]] = KEYWORDS) -> Column:
    """array<int> of 0/1, one for each feature in order."""
    padded = F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" "))
    hit = lambda parts: F.when(_any([F.contains(padded, F.lit(p)) for p in parts]), 1).otherwise(0)
    return F.array(*[hit(parts) for parts in keywords.values()])


def _any(tests: Sequence[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def vector_map(vector: Column, keywords: Mapping[str, Sequence[str]] = KEYWORDS) -> Column:
    return F.map_from_arrays(F.array(*[F.lit(k) for k in keywords]), vector)


def map_vector(features: Column, keywords: Mapping[str, Sequence[str]] = KEYWORDS) -> Column:
    return F.array(*[F.coalesce(F.try_element_at(features, F.lit(k)), F.lit(0)) for k in keywords])


def is_zero(vector: Column) -> Column:
    return ~F.exists(vector, lambda v: v != 0)


def naive_bayes_fit(df: DataFrame, vector: str, label: str, smooth: float = 0.5) -> DataFrame:
    """label, prior and, for each feature, ln P(1 | label) and ln P(0 | label) with expected-likelihood smoothing; one aggregation."""
    n = F.count("*").cast("double")
    k = len(KEYWORDS)
    ones = [F.sum(F.get(vector, F.lit(i))).cast("double") for i in range(k)]
    total = df.agg(F.count("*").alias("_all"))
    grouped = df.groupBy(label).agg(n.alias("n"), F.array(*ones).alias("ones")).join(F.broadcast(total))
    return grouped.select(
        F.col(label).alias("label"), F.ln(F.col("n") / F.col("_all")).alias("prior"),
        F.transform("ones", lambda o: F.ln((o + smooth) / (F.col("n") + 2 * smooth))).alias("log1"),
        F.transform("ones", lambda o: F.ln((F.col("n") - o + smooth) / (F.col("n") + 2 * smooth))).alias("log0"),
    )


def naive_bayes_predict(df: DataFrame, model: DataFrame, vector: str) -> DataFrame:
    """Add `predicted`: the label with the largest posterior, ties to the smaller label.  A model has a row a label and travels as one array."""
    table = model.agg(F.collect_list(F.struct("label", "prior", "log1", "log0")).alias("_model"))
    ll = lambda m: m["prior"] + F.aggregate(F.zip_with(F.col(vector), F.zip_with(m["log1"], m["log0"], lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda v, p: F.when(v == 1, p["a"]).otherwise(p["b"])), F.lit(0.0), lambda x, y: x + y)
    best = F.array_min(F.transform("_model", lambda m: F.struct((-F.round(ll(m), 9)).alias("cost"), m["label"].alias("label"))))
    return df.join(F.broadcast(table)).withColumn("predicted", best["label"]).drop("_model")


def word_counts(df: DataFrame, text: str, stop_words: Sequence[str] = (), pattern: str = r"[a-z']+") -> DataFrame:
    """Lower-cased words and their number, without stop words."""
    words = df.select(F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(f"({pattern})"))).alias("word"))
    if stop_words:
        words = words.filter(~F.col("word").isin(*stop_words))
    return words.groupBy("word").agg(F.count("*").alias("n"))


def tokens(text: Column, limit: int) -> Column:
    """Words by white space, at most `limit`."""
    return F.slice(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""), 1, limit)


PHONE = r"\d{11}"


def phone(text: Column) -> Column:
    """First run of 11 digits, or NULL."""
    return first_match(text, PHONE)


def phone_position(text: Column) -> Column:
    return match_position(text, PHONE)


def order_record(text: Column) -> Column:
    """Struct (layout, model, receiver, phone, address, sender) of an order line; NULL layout if neither fits.

    Layout 1 names its fields (型号, 收件人, 电话, 地址, 寄件人), in any order; layout 2 gives 收件地址 and 发件人, each a list
    of name, phone and address between full-width commas.
    """
    clean = F.translate(text, " \t\r\n", "")
    after = lambda mark: F.trim(F.regexp_extract(clean, f"{mark}[:：]?(.*?)(?=[,，;；]?(?:型号|收件人|电话|地址|寄件人|收件地址|发件人)|$)", 1))
    value = lambda mark: F.when(F.contains(clean, F.lit(mark)), F.nullif(F.regexp_replace(after(mark), "[,，;；]$", ""), F.lit("")))
    second = F.contains(clean, F.lit("收件地址"))
    first = F.contains(clean, F.lit("收件人")) & ~second
    parts = F.split(F.regexp_extract(clean, "收件地址[:：]?(.*?)(?:发件人|$)", 1), "[,，]")
    return F.when(
        first, F.struct(F.lit(1).alias("layout"), value("型号").alias("model"), value("收件人").alias("receiver"), phone(clean).alias("phone"), value("地址").alias("address"), value("寄件人").alias("sender"))
    ).when(
        second,
        F.struct(
            F.lit(2).alias("layout"), value("型号").alias("model"), F.nullif(F.get(parts, F.lit(0)), F.lit("")).alias("receiver"), phone(clean).alias("phone"),
            F.nullif(F.array_join(F.filter(parts, lambda p, i: (i > 0) & ~F.regexp_like(p, F.lit(f"^{PHONE}$"))), ""), F.lit("")).alias("address"), value("发件人").alias("sender"),
        ),
    )


def page_links(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row per link: the page's other columns, position, href, text (without tags, character references as written)."""
    rest = [c for c in pages.columns if c != html]
    anchors = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<a\b[^>]*>.*?</a>"), F.lit(0))
    links = pages.select(*rest, F.posexplode(anchors).alias("position", "_a"))
    text = F.trim(F.regexp_replace(F.regexp_replace("_a", r"<[^>]*>", ""), r"[ \t\n\r\f\x0B]+", " "))
    return links.select(*rest, "position", F.regexp_extract("_a", r'(?is)^<a\b[^>]*?\bhref\s*=\s*"([^"]*)"', 1).alias("href"), text.alias("text"))


def plain_text(markup: Column) -> Column:
    """Text of markup without tags: the five references written with a semicolon become characters, one after the other; white space stays but for spaces at both ends."""
    for name, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        markup = F.replace(markup, F.lit(name), F.lit(c))
    return F.regexp_replace(markup, r"^\p{Zs}+|\p{Zs}+\z", "")


def number_in(text: Column) -> Column:
    """First integer in a text, or NULL."""
    return F.try_to_number(first_match(text, r"\d+"), F.lit("999999999999")).cast("long")
