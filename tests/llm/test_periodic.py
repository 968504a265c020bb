"""Runs of words against a search of all periods."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenfold.llm import periodic
from lumenfold.llm.queries import op13_periodic_runs


def plain_runs(words, least=12):
    """Every period in turn: longest stretches in which words that far apart agree, without those of a smaller period."""
    out = []
    for q in range(1, len(words) // 2 + 1):
        s = 0
        for i in range(q, len(words) + 1):
            if i == len(words) or words[i] != words[i - q]:
                if i - s >= max(least, 2 * q):
                    w = words[s : s + q]
                    if not any(q % d == 0 and w == w[:d] * (q // d) for d in range(1, q)):
                        out.append((s, i - s, q))
                s = i - q + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def solve(lists, least=12):
    counts, ends, runs, collapsed = periodic._solve([" ".join(w).encode() for w in lists], least)
    runs = [(r["start"], r["length"], r["period"]) for r in runs.to_pylist()]
    assert counts == [len(w) for w in lists]
    return [runs[a:b] for a, b in zip(ends, ends[1:])], [c.decode().split() for c in collapsed]


def check(lists, least=12):
    runs, collapsed = solve(lists, least)
    for w, r, c in zip(lists, runs, collapsed):
        assert r == plain_runs(w, least)
        assert c == plain_collapsed(w, r)


@given(st.lists(st.lists(st.sampled_from("ab"), max_size=40), max_size=4), st.sampled_from([2, 4, 12]))
@settings(max_examples=150, deadline=None)
def test_two_letters(lists, least):
    check(lists, least)


def test_repetitive_texts(monkeypatch):
    rng = random.Random(3)
    thue = ["a"]
    for _ in range(8):
        thue += ["b" if x == "a" else "a" for x in thue]
    fib = [["a"], ["a", "b"]]
    while len(fib[-1]) < 400:
        fib.append(fib[-1] + fib[-2])
    planted = []
    for _ in range(30):
        w = [rng.choice("abcdefgh") for _ in range(rng.randint(5, 60))]
        w += (w[-rng.randint(1, len(w)) :]) * rng.randint(1, 6) + [rng.choice("abc") for _ in range(rng.randint(0, 9))]
        planted.append(w)
    lists = [thue, fib[-1], ["a"] * 500, ["a"] * 250 + ["b"] + ["a"] * 250, ["a", "b", "c"] * 90 + ["a"], [], ["x"], ["x"] * 11, ["x"] * 12, *planted]
    check(lists)
    monkeypatch.setattr(periodic, "SLAB", 50)
    check(lists)


def test_one_long_text_is_fast():
    codes = np.zeros(300_000, np.int64)
    ends = np.full(len(codes), len(codes))
    assert [x.tolist() for x in periodic.find_runs(codes, np.zeros_like(codes), ends)] == [[0], [300_000], [1]]
    rng = np.random.default_rng(1)
    codes = np.tile(rng.integers(0, 50, 70_000), 4)
    start, length, period = periodic.find_runs(codes, np.zeros_like(codes), np.full(len(codes), len(codes)))
    assert (0, 280_000, 70_000) in set(zip(start.tolist(), length.tolist(), period.tolist()))


def plain_row(doc_id, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(plain_collapsed(words, runs))).hexdigest())


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_digests_equal_a_plain_search(docs, texts):
    rows = list(texts.items()) + [(100 + i, " ".join(f"w{j % (5 + i)}" for j in range(80))) for i in range(40)]
    spark = docs.sparkSession
    rows += [(None, "a b " * 20), (None, None), (7, texts[7]), (7, texts[7]), (8, "\x0b\x0c\t a\x1fb \r\n" * 9), (9, "é ü " * 30)]
    frame = spark.createDataFrame([(k, v, 1, "x") for k, v in rows], "doc_id long, text string, n_runs int, Runs string")
    got = periodic.run_digests(frame)
    assert got.columns == COLUMNS
    key = lambda r: tuple(map(repr, r))
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted((plain_row(*r) for r in rows), key=key)


def test_other_columns_and_empty_tables(spark, empty):
    frame = spark.createDataFrame([(1, "a a " * 6, "k", 5), (2, None, "k", 5)], "id long, text string, collapsed string, row int")
    got = {r["id"]: r for r in periodic.periodic_runs(frame).collect()}
    assert got[1]["runs"] == [(0, 12, 1)] and got[1]["collapsed"] == "a" and got[1]["row"] == 5 and got[1]["n_words"] == 12
    assert got[2]["runs"] == [] and got[2]["collapsed"] == "" and got[2]["text"] is None
    assert periodic.run_digests(empty).count() == 0


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_query_equals_a_plain_search(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    # The plain search takes quadratic time, so it compares the texts of up to 700 words.
    short = {r["doc_id"]: r["text"] for r in docs if len((r["text"] or "").split()) <= 700}
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in op13_periodic_runs(spark, sf).collect()}
    assert len(got) == len(docs) and len(short) > 100
    for k, t in short.items():
        assert got[k] == plain_row(k, t)
