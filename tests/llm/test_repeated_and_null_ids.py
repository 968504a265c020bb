import collections
import hashlib
import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from lumenfold.llm import bpe, order, packing

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def data():
    rng = random.Random(8)
    text = lambda n: " ".join("".join(rng.choices("abcdefgé", k=rng.randint(2, 8))) for _ in range(n))
    a, b, c, d = (text(n) for n in (150, 120, 90, 200))
    short = [text(4) for _ in range(5)]
    return [(1, a), (1, a), (1, b), (2, b), (None, c), (None, c), (None, d), (None, short[0]), (3, short[1]), (None, None), (None, short[2])]


@pytest.fixture(scope="module")
def frame(spark, data):
    return spark.createDataFrame([(k, t, "en", "s", None) for k, t in data], COLUMNS).repartition(3)


def encoded(vocab, data):
    enc = bpe.encoder(vocab)
    return [(k, t, enc.encode_batch([t or ""])[0]) for k, t in data]


@pytest.mark.parametrize("limit", [65_536, 100])
def test_roundtrip_gives_every_row(frame, data, vocab, limit):
    got = collections.Counter(tuple(r) for r in bpe.bpe_roundtrip(frame, vocab, long_chars=limit).collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == collections.Counter((k, len(x), sha(",".join(map(str, x))), sha(t or "")) for k, t, x in encoded(vocab, data))


def test_long_repeated_rows_at_the_real_limit(spark, vocab):
    long = [("word " * 14_000) + end for end in ("a", "b")]
    data = [(7, long[0]), (7, long[0]), (7, long[1]), (None, long[0]), (None, long[1])]
    df = spark.createDataFrame(data, "doc_id long, text string")
    want = collections.Counter((k, len(x)) for k, _, x in encoded(vocab, data))
    got = collections.Counter()
    for r in packing.token_pieces(df, vocab).collect():
        got[r["doc_id"]] += r["length"]
    assert got == {7: sum((n + 1) * c for (k, n), c in want.items() if k == 7), None: sum((n + 1) * c for (k, n), c in want.items() if k is None)}
    hashes = collections.Counter((r["doc_id"], r["decoded_sha256"]) for r in bpe.bpe_roundtrip(df, vocab).collect())
    assert hashes == collections.Counter((k, hashlib.sha256(t.encode()).hexdigest()) for k, t in data)


def test_shards_hold_rows_without_id(frame, data, vocab):
    end = bpe.encoder(vocab).special[bpe.EOT]
    want = collections.Counter()
    for k, _, x in encoded(vocab, data):
        ids = np.append(x, end).astype("<u2")
        want.update((k, i // 32, len(ids[i : i + 32]), zlib.crc32(ids[i : i + 32].tobytes())) for i in range(0, len(ids), 32))
    seen = []
    for parts in (3, 5):
        got = order.read_shards(order.materialise(frame.repartition(parts), vocab, key="k", seq_len=32, shard_bytes=4096)).collect()
        assert sorted(r["slot"] for r in got) == list(range(len(got)))
        assert collections.Counter((r["doc_id"], r["piece"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
        seen.append({(r["slot"], r["doc_id"], r["ids_crc32"]) for r in got})
    assert seen[0] == seen[1]
    none = order.read_shards(order.materialise(frame.filter("doc_id is null"), vocab, seq_len=32)).collect()
    assert collections.Counter((r["doc_id"], r["piece"], r["n_tokens"], r["ids_crc32"]) for r in none) == collections.Counter({k: n for k, n in want.items() if k[0] is None})


def test_near_stage_keeps_one_of_equal_rows(spark, frame, data):
    """Rows without an id are documents like others: unlike ones stay, of equal ones one stays, as of rows with an id."""
    got = corpus_pipeline.near(spark, frame, "")
    assert got.columns == frame.columns
    rows = collections.Counter((r["doc_id"], r["text"]) for r in got.collect())
    assert rows == collections.Counter({(k, t) for k, t in data} - {(2, data[3][1])})
