import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenfold.llm import bpe, html, license, media, neardup, order, packing, search, suffix, toxicity


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def reference_encoder(vocab):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocab)


# 1. Training order


def test_permutation_is_one_to_one_and_invertible():
    for size in (1, 2, 5, 64, 1000, 4097):
        x = np.arange(size)
        y = order.feistel(x, size, "k")
        assert sorted(y) == list(range(size))
        assert (order.feistel(y, size, "k", inverse=True) == x).all()
    assert (order.feistel(np.arange(1000), 1000, "a") != order.feistel(np.arange(1000), 1000, "b")).any()


def test_shards_hold_every_sequence_once(docs, texts, vocab):
    manifest = order.materialise(docs, vocab, key="k", seq_len=32, shard_bytes=4096)
    got = order.read_shards(manifest).collect()
    assert sorted(r["slot"] for r in got) == list(range(len(got)))
    enc = bpe.encoder(vocab)
    want = set()
    for k, t in texts.items():
        ids = np.append(enc.encode_batch([t or ""])[0], enc.special[bpe.EOT]).astype("<u2")
        want |= {(k, i // 32, len(ids[i : i + 32]), zlib.crc32(ids[i : i + 32].tobytes())) for i in range(0, len(ids), 32)}
    assert {(r["doc_id"], r["piece"], r["n_tokens"], r["ids_crc32"]) for r in got} == want
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["slot"])] != sorted(r["doc_id"] for r in got)
    late = order.read_shards(manifest, 50).collect()
    assert {r["slot"] for r in late} == set(range(50, len(got)))
    again = order.read_shards(order.materialise(docs.repartition(5), vocab, key="k", seq_len=32, shard_bytes=4096)).collect()
    assert {(r["slot"], r["doc_id"], r["piece"]) for r in again} == {(r["slot"], r["doc_id"], r["piece"]) for r in got}


def test_ids_far_apart(spark, vocab):
    ids = [-9 * 10**18, 9 * 10**18, 0, None, None, 5, 5]
    df = spark.createDataFrame([(k, f"text {i} " * 40) for i, k in enumerate(ids)], "doc_id long, text string")
    got = order.read_shards(order.materialise(df, vocab, seq_len=16, shard_bytes=2048)).collect()
    pieces = collections.Counter(r["doc_id"] for r in got)
    assert sorted(r["slot"] for r in got) == list(range(len(got))) and set(pieces) == set(ids) and pieces[5] == 2 * pieces[0]
    assert min(r["shard"] for r in got) >= 0


def test_training_order_of_nothing(empty, vocab):
    assert order.read_shards(order.materialise(empty, vocab)).count() == 0


# 2. BPE


def test_roundtrip_equals_the_library(docs, texts, vocab):
    ref = reference_encoder(vocab)
    for limit in (65_536, 100):
        got = rows(bpe.bpe_roundtrip(docs, vocab, long_chars=limit))
        assert len(got) == len(texts)
        for k, t in texts.items():
            ids = ref.encode(t or "", add_special_tokens=False).ids
            assert (got[k]["n_tokens"], got[k]["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
            assert got[k]["decoded_sha256"] == hashlib.sha256(ref.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_roundtrip_of_nothing(empty, vocab):
    assert bpe.bpe_roundtrip(empty, vocab).count() == 0


ALPHABET = st.lists(st.sampled_from([*"'strevmdlab 1.\n\té漢!", "<|endoftext|>", "  "]), max_size=80).map("".join)


@settings(max_examples=150, deadline=None)
@given(ALPHABET, st.integers(1, 40))
def test_tree_concatenation_is_exact(text, leaf):
    from lumenfold.llm.bpe import encoder, vocabulary

    path = vocabulary()
    want = _REF(path).encode(text, add_special_tokens=False).ids
    assert bpe.encode_tree(encoder(path), text, leaf).tolist() == want
    assert encoder(path).encode_batch([text])[0].tolist() == want


_CACHE = {}


def _REF(path):
    return _CACHE.setdefault(path, reference_encoder(path))


# 3. Media


def test_media_round_trip(docs, texts):
    got = rows(media.media_columns(docs))
    assert len(got) == len(texts)
    for k, t in texts.items():
        raw = (t or "").encode()
        payload = media.padded(raw)
        r = got[k]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload)) and len(payload) % 64 == 0 and payload
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
        assert r["media_sha256"] == hashlib.sha256(media.to_png(payload)).hexdigest() and r["feature"] == media.features(payload)


def test_media_of_nothing(empty):
    assert media.media_columns(empty).count() == 0


def test_members_fall_into_one_range(spark, docs, texts):
    path = media.store_payloads(docs)
    for size in (1, 777, 1 << 20):
        assert sorted(r[0] for r in media.read_archive(spark, path, size).select("member_id").collect()) == sorted(texts)


def test_damaged_media_is_refused():
    good = bytearray(media.to_png(b"a" * 64))
    good[45] ^= 1
    with pytest.raises(ValueError):
        media.from_png(bytes(good))


def test_a_member_is_read_again_after_a_failure(tmp_path):
    (tmp_path / "a").write_bytes(b"0123456789")
    from pyarrow import fs

    class Flaky:
        fails = 2

        def open_input_file(self, name):
            if Flaky.fails:
                Flaky.fails -= 1
                raise OSError("gone")
            return fs.LocalFileSystem().open_input_file(name)

    assert media.read_member(Flaky(), str(tmp_path / "a"), 3, 4, wait=0.001) == b"3456"


# 4. Search


def test_search_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(300, 6)).round(1)
    data = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(900, None), (901, [None] * 6), (902, [float("nan")] * 6), (903, [float("inf")] * 6), (904, []), (950, [1.0, 2.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(4)
    got = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in search.top_k(df, df.filter("vec_id % 25 = 0"), 5).collect()}
    q = np.floor(256 * vectors).astype(int)
    want = set()
    for i in range(0, 300, 25):
        s = q @ q[i]
        best = sorted((j for j in range(300) if j != i), key=lambda j: (-s[j], j))[:5]
        want |= {(i, n + 1, j, int(s[j])) for n, j in enumerate(best)}
    assert got == want


def test_search_takes_components_of_any_size(spark):
    big = [(0, [1.0, 2.0]), (1, [70_000.0, -3.0]), (2, [1e12, 1e9]), (3, [-1e12, 5.0]), (4, [1e15, 1e15]), (5, [0.5, 0.25])]
    df = spark.createDataFrame(big, "vec_id long, embedding array<double>").withColumns({"score": F.lit(1), "rank": F.lit(2), "q": F.lit(3)})
    df = df.unionByName(df.filter("vec_id = 5"))
    got = [tuple(r) for r in search.top_k(df, df, 3).collect()]
    q = {k: [int(np.floor(256 * x)) for x in v] for k, v in big}
    cut = lambda x: max(min(x, 2**63 - 1), -(2**63))
    want = []
    for a in q:
        rest = [b for b, _ in [*big, big[5]] if b != a]
        best = sorted(((cut(sum(x * y for x, y in zip(q[a], q[b]))), b) for b in rest), key=lambda x: (-x[0], x[1]))[:3]
        want += [(a, n + 1, b, s) for n, (s, b) in enumerate(best)]
    assert sorted(got) == sorted(want)


def test_search_with_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [-2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in search.top_k(df, df.filter("vec_id = 0")).collect()] == [(0, 1, 1, -131072)]
    assert search.top_k(df.limit(0), df).count() == 0


# 5. Licenses


def base_places(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(str.maketrans(license.UPPER, license.LOWER)))
    out = []
    for phrase, label in license.BASE.items():
        p = phrase.split()
        out += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    return len(w), out


def test_license_base_equals_brute_force(spark, docs, texts):
    rng = random.Random(3)
    parts = ["under", "the", "mit", "license", "Apache", "version", "2", "cc", "by", "nc", "x", "é", "K", "-", "\n", "licensed"]
    more = {1000 + i: " ".join(rng.choices(parts, k=60)) for i in range(150)}
    every = spark.createDataFrame(list(more.items()), "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    got = rows(license.license_labels(every))
    for k, t in (texts | more).items():
        n, at = base_places(t or "")
        starts = [a for a, _ in at]
        r = got[k]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (n, len(at), min(starts, default=None), max(starts, default=None))
        assert r["base_labels"] == ",".join(sorted({b for _, b in at})) and set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
        assert 0 <= r["score"] <= 1


def test_license_rules(spark):
    cases = {
        "Licensed under the GNU General Public License, version 3 or later": "gpl-3", "SPDX-License-Identifier: BSD-3-Clause": "bsd-3-clause",
        "released under the terms of the Mozilla Public License 2.0": "mpl-2", "This work is under CC BY-SA 4.0": "cc-by-sa", "no terms at all": "",
    }
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = rows(license.license_labels(df))
    assert [got[i]["labels"] for i in range(len(cases))] == list(cases.values())
    assert len(license.rules()) > 200


# 6. Suffix dedup


def brute_repeats(texts, width=200):
    data = {k: (t or "").encode() for k, t in texts.items()}
    seen = collections.Counter(b[i : i + width] for b in data.values() for i in range(len(b) - width + 1))
    out = {}
    for k, b in data.items():
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if seen[b[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[k] = (len(b), sum(gone), sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1])), kept)
    return out


@pytest.mark.parametrize("group", [512, 1])
def test_suffix_dedup_equals_brute_force(docs, texts, group):
    got = rows(suffix.without_repeats(docs, group=group))
    want = brute_repeats(texts)
    assert {k: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for k, r in got.items()} == want
    assert sum(w[1] for w in want.values()) > 1000


def test_a_large_group_that_shares_a_core(spark):
    """Thousands of texts with one passage of 60 to 260 bytes, of which their neighbours add some bytes by chance."""
    rng = random.Random(8)
    passage = "".join(rng.choices("abcdefgh ", k=260))
    noise = lambda n: "".join(rng.choices("ABC", k=n))
    texts = {}
    for i in range(3000):
        a, n = rng.choice([0, 0, 30, 60]), rng.choice([60, 140, 170, 198, 199, 200])
        texts[i] = noise(rng.randint(0, 120)) + passage[a : a + n] + noise(rng.randint(0, 120))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = rows(suffix.without_repeats(df, group=64))
    want = brute_repeats(texts)
    assert {k: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for k, r in got.items()} == want
    assert 0 < sum(w[1] > 0 for w in want.values()) < 3000


def test_suffix_dedup_keeps_other_columns(spark):
    """Clashing names are replaced, all others stay; rows without an id and repeated rows are judged like others."""
    line = "".join(random.Random(2).choices("abcdefgh ", k=300))
    data = [(None, line, 1, "a"), (None, line[:250], 2, "b"), (None, "short", 3, "c"), (None, None, 4, "d"), (7, line + "x", 5, "e"), (7, line + "x", 5, "e")]
    df = spark.createDataFrame(data, "doc_id long, text string, n_bytes int, `a b` string")
    df = df.withColumns({c: F.lit(1) for c in ("kept", "_doc", "_th", "_parts", "row", "span", "N_SPANS")})
    out = suffix.without_repeats(df)
    assert out.columns == ["doc_id", "text", "a b", "_doc", "_th", "_parts", "row", "span", "n_bytes", "n_removed", "n_spans", "kept"]
    got = {(r["a b"], r["n_bytes"], r["n_removed"], bytes(r["kept"])) for r in out.collect()}
    assert out.count() == 6
    assert got == {("a", 300, 300, b""), ("b", 250, 250, b""), ("c", 5, 0, b"short"), ("d", 0, 0, b""), ("e", 301, 301, b"")}


def test_suffix_dedup_of_nothing(empty):
    assert suffix.repeat_digests(empty).count() == 0


# 7. HTML


def test_main_text(spark):
    page = (
        "<html><head><title>T</title><script>var t='</p>'</script></head><body><nav><ul><li>Menu</ul></nav><div class='cookie-notice'>ok?</div>"
        "<article><h1>A &amp; B</h1><p>One  two<br>three<p><b>Four</b> five<form>x</form><div class='comments'><p>nice</p></div></article><aside>s</aside><footer>f</footer>"
    )
    plain = "<div class='top'>Site {n} page</div><div id='x'><p>Text {i}</p></div><div>All rights by us</div>"
    data = [(0, "http://a.example/1", page), (1, None, None), (2, "http://b.example/x", "")] + [(10 + i, f"http://c.example/{i}", plain.format(n="c", i=i)) for i in range(8)]
    df = spark.createDataFrame(data, "page_id long, url string, html string").repartition(3)
    for limit in (1000, 0):
        got = {r["page_id"]: r for r in html.main_text(df, broadcast_rows=limit).collect()}
        assert got[0]["text"] == "A & B\nOne two three\nFour five" and got[1]["text"] == got[2]["text"] == ""
        assert [got[10 + i]["text"] for i in range(8)] == [f"Text {i}" for i in range(8)]
        assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_broken_markup_takes_linear_time_and_leaks_nothing():
    import time

    seconds = []
    for n in (20_000, 80_000):
        began = time.time()
        for bad in ("<a ", '<a title="x ', "<!-- ", "<p title='", "< "):
            html.tree(bad * n)
        seconds.append(time.time() - began)
    assert seconds[1] < 16 * max(seconds[0], 0.05)
    text = lambda page: html.blocks(html.tree(page), frozenset())
    assert text('<p>a<a title="x>y') == ["ay"]
    assert text("<p title=it's>one</p><p>2 < 3 and <b>four</b>") == ["one", "2 < 3 and four"]
    assert text('<p title="a > b">one</p>') == ["one"]
    assert text("<article><header><h1>Title</h1></header><p><label>L</label> <math><mi>x</mi></math></p></article>") == ["Title", "L x"]
    assert text("<header>Site</header><p>one<script>var a = '<p>two'</script></p>") == ["one"]


def test_repeated_and_null_page_ids_on_both_paths(spark):
    page = "<div><p>Text {i} of {h}</p></div><div><p>Site foot of {h}</p><p>line</p></div>"
    data = [(None if i == 3 else 7, f"http://{h}.example/{i}", page.format(i=i, h=h)) for h in "ab" for i in range(8)] + [(7, None, page.format(i=99, h="c"))]
    df = spark.createDataFrame(data, "page_id long, url string, html string").repartition(3)
    both = [sorted((r["url"] or "", r["text"]) for r in html.main_text(df, broadcast_rows=n).collect()) for n in (1000, 0)]
    assert both[0] == both[1] and len(both[0]) == len(data)
    assert {t for u, t in both[0] if u} == {f"Text {i} of {h}" for h in "ab" for i in range(8)}


def test_deep_pages_do_not_overflow():
    root = html.tree("<div>" * 5000 + "x")
    html.name_subtrees(root)
    assert html.blocks(root, frozenset()) == ["x"]


# 8. Near duplicates


def brute_near(texts, size, percent=80):
    sets = {}
    for k, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[k] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    up = {k: k for k in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    up[max(x, y)] = min(x, y)
    return {k: (len(s), find(k), find(k) == k) for k, s in sets.items()}


@pytest.mark.parametrize("size", [4])
def test_near_duplicates_equal_brute_force(docs, texts, size):
    got = rows(neardup.near_duplicates(docs, size))
    assert {k: (r["n_shingles"], r["component_id"], r["kept"]) for k, r in got.items()} == brute_near(texts, size)


def test_rows_without_id_and_repeated_rows(spark):
    """A row without an id that copies another goes; of copies without any id one stays; repeated rows share a class."""
    line, other = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    data = [(5, line), (None, line), (3, line + " more"), (None, other), (None, other + " x"), (None, other), (8, ""), (None, None), (9, "a b"), (9, "a b"), (9, "c d")]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumns({"row": F.lit("r"), "kept": F.lit(1), "node": F.lit(2)})
    out = neardup.near_duplicates(df, 4).collect()
    assert len(out) == len(data)
    assert {r["doc_id"]: (r["component_id"], r["kept"]) for r in out if r["doc_id"]} == {5: (3, False), 3: (3, True), 8: (8, True), 9: (9, True)}
    none = [(r["n_shingles"], r["component_id"], r["kept"]) for r in out if r["doc_id"] is None]
    assert sorted(none, key=str)[:1] == [(0, None, True)] and [k for n, c, k in none if c == 3] == [False]
    assert len({r["row"] for r in out if r["doc_id"] is None and r["kept"] and r["n_shingles"]}) == 1


def test_families_of_texts_just_below_the_threshold(spark):
    """Many variants of one text, each similar enough to few others: only full comparison finds the links."""
    rng = random.Random(12)
    base = [f"w{i}" for i in range(150)]
    texts = {}
    for i in range(150):
        w = list(base)
        for j in rng.sample(range(150), rng.choice([3, 4, 5, 6])):
            w[j] = f"x{rng.randrange(10**6)}"
        texts[i] = " ".join(w)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = rows(neardup.near_duplicates(df, 4))
    assert {k: (r["n_shingles"], r["component_id"], r["kept"]) for k, r in got.items()} == brute_near(texts, 4)


def test_links_that_miss_the_hub_are_found(spark):
    """A chain in which neighbours are similar and the ends are not."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(2000)]
    chain = [rng.sample(words, 200)]
    for _ in range(40):
        w = list(chain[-1])
        for j in rng.sample(range(200), 4):
            w[j] = rng.choice(words)
        chain.append(w)
    texts = {i: " ".join(w) for i, w in enumerate(chain)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = rows(neardup.near_duplicates(df, 4))
    assert {k: (r["n_shingles"], r["component_id"], r["kept"]) for k, r in got.items()} == brute_near(texts, 4)


def test_signature_estimate():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    a, b = np.unique(pool[:2000]), np.unique(pool[400:2400])
    low = neardup.packed(neardup.minima([a, b]))
    assert abs(neardup.similarity(low[0], low[1]) - 1600 / 2400) < 0.2


def test_near_duplicates_of_nothing(empty):
    assert neardup.near_duplicates(empty).count() == 0


# 9. Packing


def test_packing(docs, texts, vocab):
    enc = bpe.encoder(vocab)
    got = packing.pack_documents(docs, vocab).collect()
    by_doc, by_bin = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_bin[r["sequence_id"]].append(r)
    for k, t in texts.items():
        ids = np.append(enc.encode_batch([t or ""])[0], 0).astype("<u4")
        at = 0
        for i, r in enumerate(sorted(by_doc[k], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (i, at) and (i == 0 or r["length"] == 2048) and 1 <= r["length"] <= 2048
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for group in by_bin.values():
        at = 0
        for r in sorted(group, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    total = sum(r["length"] for r in got)
    assert len(by_bin) <= -(-total // 2048) + 1


def test_fullest_combination_is_optimal():
    rng = random.Random(4)
    for _ in range(100):
        counts = dict(collections.Counter(rng.randint(1, 40) for _ in range(rng.randint(1, 9))))
        used = packing.fullest(counts, 60)
        assert all(used[k] <= counts[k] for k in used) and max(counts) in used
        items = [k for k, n in counts.items() for _ in range(n)]
        items.remove(max(counts))
        sums = {0}
        for x in items:
            sums |= {s + x for s in sums}
        assert sum(k * n for k, n in used.items()) == max(counts) + max(s for s in sums if s <= 60 - max(counts))


def test_packing_of_a_table_with_clashing_names(spark):
    rows_ = [(i, 0, 1 + i % 40) for i in range(300)]
    df = spark.createDataFrame(rows_, "doc_id long, piece int, length long").withColumns({"offset": F.lit("x"), "SEQUENCE_ID": F.lit(1), "_rank": F.lit(1), "more": F.lit(5)})
    out = packing.pack(df, 64)
    assert out.columns == ["doc_id", "piece", "length", "more", "sequence_id", "offset"] and out.count() == 300
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("m")).filter("n <> m or n > 64").isEmpty()


def test_packing_of_nothing(empty, vocab):
    assert packing.pack_documents(empty, vocab).count() == 0


# 10. Toxicity


def test_folding():
    assert toxicity.fold("Idi0t") == toxicity.fold("іdіоt") == toxicity.fold("ＩＤＩＯＴ") == "idiot"
    assert toxicity.words("tr4sh!! 2024 $cum") == ["trash", "2024", "scum"]


def test_exceptions_and_length():
    model = toxicity.Model({" trash ": 5.0, " scumb": 4.0}, [" trash can "])
    machine = toxicity.automaton(model)
    assert [v[0] for v in toxicity.hits(["trash"], machine).values()] == [5.0]
    assert toxicity.hits(["trash", "can", "scum"], machine) == {}
    assert toxicity.signals([5.0], 10)[1] > toxicity.signals([5.0], 1000)[1]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.toxicity_scores(docs, labels)
    assert got.count() == docs.count()
    r = got.join(labels, "doc_id").filter("held_out").agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int"))).first()[0]
    assert r > 0.9


def test_hits_equal_a_plain_search():
    rng = random.Random(6)
    lexicon = {" tra": 2.0, " trash ": 5.0, " trashy": 1.0, " scum ": 4.0, " sc": 0.5, " b ": 3.0}
    machine = toxicity.automaton(toxicity.Model(lexicon, [" trash can ", " b scum "]))
    for _ in range(300):
        found = rng.choices(["trash", "trashy", "can", "scum", "scout", "b", "bb", "x"], k=rng.randint(0, 12))
        joined = " " + " ".join(found) + " "
        spared = {at + j for e in (" trash can ", " b scum ") for at in range(len(joined)) if joined.startswith(e, at) for j in range(len(e) - 1)}
        want = {}
        for at in range(len(joined)):
            here = [w for e, w in lexicon.items() if joined.startswith(e, at)]
            if here and at not in spared:
                want[at] = max(here)
        assert {k: v[0] for k, v in toxicity.hits(found, machine).items()} == want


def test_exception_phrases_are_learned_and_change_scores(spark):
    bad = [(i, f"you vile person number {i} are vile and rotten", 1) for i in range(40)]
    good = [(1000 + i, f"the vile bottle number {i} stands on the table of things", 0) for i in range(8)] + [(2000 + i, f"some other words {i}", 0) for i in range(200)]
    df = spark.createDataFrame([r[:2] for r in bad + good], "doc_id long, text string").withColumn("score", F.lit("old"))
    labels = spark.createDataFrame([(r[0], r[2]) for r in bad + good], "doc_id long, toxic int")
    model = toxicity.fit(df, labels)
    assert " vile bottle " in model.exceptions
    out = toxicity.score(df, model)
    assert out.columns == ["doc_id", "text", "score"]
    got = {r["doc_id"]: r["score"] for r in out.collect()}
    without = {r["doc_id"]: r["score"] for r in toxicity.score(df, toxicity.Model(model.lexicon, [], model.beta)).collect()}
    assert got[1000] < 0.5 < got[0] and got[1000] < without[1000]


def test_held_out_toxic_rows_are_found(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows_ = toxicity.toxicity_scores(docs, labels).filter("held_out").join(labels, "doc_id").groupBy("toxic", "predicted").count().collect()
    n = collections.Counter({(r[0], r[1]): r[2] for r in rows_})
    assert n[1, 1] / (n[1, 1] + n[1, 0]) > 0.85 and n[1, 1] / (n[1, 1] + n[0, 1]) > 0.9


def test_toxicity_without_labels(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.toxicity_scores(docs, none).collect()
    assert all(0 <= r["score"] <= 1 for r in got) and len(got) == docs.count()
    assert toxicity.toxicity_scores(empty, none).count() == 0


def test_clashing_columns(spark, docs):
    more = docs.withColumns({"score": F.lit(1), "names": F.lit("x"), "n_words": F.lit(2), "kept": F.lit("k")}).select("doc_id", "text", "n_words")
    assert license.license_scan(more).columns.count("n_words") == 1
