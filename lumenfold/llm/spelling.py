"""Spelling variants of words by a dictionary of pairs of trie nodes.

A word walks down a trie of beginnings and, from its end, one of endings.  Two words differ by one replaced code point if
the nodes before and after it are the same for both, and by one inserted one if the shorter word has these nodes at one
position: the pair (node of the beginning, node of the ending) is the key.

1. `word_counts` counts the words of all texts with Column expressions.
2. Every word gives a key for each position it skips and one for each position at which something may be inserted, two
   for each code point and one more.  A node's number is the 64-bit hash of the string that leads to it, so no pass
   numbers the nodes; a collision adds a candidate, and the exact check of step 4 removes it.
3. The words of one key differ in one code point, so there are no more than the alphabet has letters, however many words
   there are: no key is hot.
4. Pairs of one key are near words.  Each word's near words are counted and the most frequent is its form.
5. Forms of forms are found by pointer doubling: a form is several times as frequent as its word, so a chain is short.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_table, drop_tables, save

LETTERS = "[A-Za-zÀ-ÿ]"
LEAST_LENGTH = 6
LEAST_COUNT = 5
RATIO = 5
SLIP = 199
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_slips(doc_id: Column, word: Column) -> Column:
    """The word without the code point h % length where SLIP divides h, the checksum of `<doc_id>:<word>`.

    A row without an id has no checksum, and its words stay.
    """
    h = F.crc32(F.concat(doc_id.cast("string"), F.lit(":"), word).cast("binary"))
    at = (h % F.length(word)).cast("int")
    return F.when(h % SLIP == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))).otherwise(word)


def word_counts(docs: DataFrame, change: Callable[[Column, Column], Column] | None = None, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word and n: the runs of LETTERS in all texts, A-Z lower-cased, of enough code points and occurrences.

    `change(doc_id, word)` may replace a word before it is counted, by none that is longer.  Null and empty texts have no
    words; repeated rows count each time.  `docs` needs text, and doc_id if `change` reads it; other columns are ignored.
    """
    found = F.regexp_extract_all(F.col("text"), F.lit(f"{LETTERS}{{{least_length},}}"), F.lit(0))
    words = docs.select("doc_id" if change else F.lit(None).alias("doc_id"), F.explode(found).alias("word"))
    # lower() is fast, but lower-cases letters outside A-Z too.
    plain = F.length("word") == F.octet_length("word")
    words = words.select("doc_id", F.when(plain, F.lower("word")).otherwise(F.translate("word", CAPITALS, SMALL)).alias("word"))
    if change:
        words = words.select(change(F.col("doc_id"), F.col("word")).alias("word")).filter(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def pair_keys(words: DataFrame) -> DataFrame:
    """before, after (numbers of trie nodes), skips and the word: one row for each skipped and each inserted position."""
    length = F.length("word")

    def keys(skips: bool) -> Column:
        positions = F.sequence(F.lit(0), length - 1 if skips else length)
        step = 2 if skips else 1
        node = lambda i: F.struct(F.xxhash64(F.substring("word", F.lit(1), i)).alias("before"), F.xxhash64(F.substring("word", i + step, length)).alias("after"), F.lit(skips).alias("skips"))
        return F.transform(positions, node)

    return words.filter(length > 0).select("word", "n", F.explode(F.concat(keys(True), keys(False))).alias("key")).select("key.*", "word", "n")


def near_words(words: DataFrame) -> DataFrame:
    """word, other and the counts n, other_n of each two words at distance one, in both directions, each once.

    `words` has word (distinct) and n.  Null words are ignored, and an empty word is near every word of one code point.
    """
    keys = pair_keys(words.filter("word is not null")).unionByName(words.filter("word = ''").select(F.xxhash64("word").alias("before"), F.xxhash64("word").alias("after"), F.lit(False).alias("skips"), "word", "n"))
    held = keys.groupBy("before", "after").agg(F.collect_list(F.struct("skips", "word", "n")).alias("held")).filter(F.size("held") > 1)
    one = held.select("held", F.explode("held").alias("x")).select("x", F.explode("held").alias("y"))
    pairs = one.filter((F.col("x.skips") | F.col("y.skips")) & (F.levenshtein("x.word", "y.word", 1) == 1))
    return pairs.select(F.col("x.word").alias("word"), F.col("x.n").alias("n"), F.col("y.word").alias("other"), F.col("y.n").alias("other_n")).distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, form) to (word, root): forms followed to the last by doubling."""
    up = save(forms.select("word", F.col("form").alias("to")), "up")
    while True:
        further = up.select(F.col("word").alias("to"), F.col("to").alias("next"))
        longer = save(up.join(further, "to", "left").select("word", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), "up")
        drop_table(up)
        up = longer.drop("moved")
        if longer.filter("moved").isEmpty():
            return up.withColumnRenamed("to", "root")


def spelling_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near and form_n for every row of `words` (word, n), whose words are distinct.

    A word's near words differ from it by exactly one inserted, deleted or replaced code point.  Its form is the most
    frequent of them (ties: the first in code-point order) if that is at least `ratio` times as frequent as the word,
    else null; `root` follows forms to the last and is the word itself where there is none.  n_near counts near words.
    Counts must be positive and the ratio over 1, so that forms never lead in a circle.
    """
    if ratio <= 1:
        raise ValueError("ratio must be over 1")
    words = save(words.select("word", "n"), "words")
    near = near_words(words).groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    frequent = -F.col("best.less") >= ratio * F.col("n")
    near = save(near.select("word", "n_near", F.when(frequent, F.col("best.other")).alias("form"), F.when(frequent, -F.col("best.less")).alias("form_n")), "near")
    roots = _roots(near.filter("form is not null"))
    out = save(words.join(near, "word", "left").join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"), "variants")
    drop_tables(words, near, roots)
    return out
