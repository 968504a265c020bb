"""Spelling variants against all pairs of words."""

import collections
import re
import zlib

import oracle
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenfold.llm import queries, spelling


def lowered(word):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), word)


def plain_counts(rows):
    out = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = lowered(run)
            h = zlib.crc32(f"{doc_id}:{w}".encode())
            if doc_id is not None and h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            out[w] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(counts, ratio=5):
    out, form = {}, {}
    near = {w: [x for x in counts if is_near(w, x)] for w in counts}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * n else None
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (w, form[w], root, n, len(near[w]), form[w] and counts[form[w]])
    return out


def of(df):
    return {r["word"]: tuple(r) for r in df.collect()}


def test_counts_with_slips(spark, texts):
    rows = list(texts.items()) + [(i, "Straßenbahn ÀÖØÿ× naïveté WORDS words_words übermäßig x" * (1 + i % 3)) for i in range(200, 420)] + [(None, "lonely words " * 6), (1, None), (1, "")]
    frame = spark.createDataFrame([(k, v, "a") for k, v in rows], "doc_id long, text string, word string").repartition(4)
    assert {r["word"]: r["n"] for r in spelling.word_counts(frame, spelling.with_slips).collect()} == plain_counts(rows)
    assert {r["word"] for r in spelling.word_counts(frame, None, 1, 1).collect()} == {lowered(w) for _, t in rows for w in re.findall("[A-Za-zÀ-ÿ]+", t or "")}


WORDS = {"aaaaaa": 500, "aaaaab": 100, "aaaabb": 20, "aaabbb": 4, "aabbbb": 1, "aaaaaaa": 100, "aaaaa": 500, "abcdef": 7, "abcdeg": 7, "abcde": 35, "bcdef": 35, "naïve": 5, "naive": 30, "nave": 6, "naïv": 1, "": 9, "a": 50, "b": 45, "ab": 1, "ba": 3, "eeee": 1, "eee": 5}


def test_variants_equal_all_pairs(spark):
    frame = spark.createDataFrame(list(WORDS.items()), "word string, n long").repartition(3)
    assert of(spelling.spelling_variants(frame)) == plain_variants(WORDS)
    assert of(spelling.spelling_variants(frame, 2)) == plain_variants(WORDS, 2)
    assert spelling.spelling_variants(frame.limit(0)).count() == 0


@given(st.dictionaries(st.text("abcé", min_size=1, max_size=5), st.integers(1, 30), max_size=40))
@settings(max_examples=6, deadline=None)
def test_any_words(spark, counts):
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert of(spelling.spelling_variants(frame)) == plain_variants(counts)


def test_one_letter_for_another_in_one_place(spark):
    """The largest group that a key can have: one word with every letter of the alphabet in one place."""
    counts = {f"word{chr(c)}s": 5 + c for c in [*range(97, 123), *range(0xC0, 0x100)]}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert of(spelling.spelling_variants(frame)) == plain_variants(counts)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = of(queries.op11_spelling_variants(spark, sf))
    assert got == plain_variants(plain_counts(rows)) and len(got) > 100
    oracle.compare(spark, queries.op11_spelling_variants, queries.ORACLE_SQL["op11_spelling_variants"], sf)
