import collections

import pytest
from test_llm_operators import brute_near, brute_repeats

import corpus_pipeline
from lumenfold.llm import bpe

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    """The fixture's documents with toxic ones added, and labels for them and for clean ones."""
    path = str(tmp_path_factory.mktemp("sf"))
    bad = [(10_000 + i, f"some vile{'x' * (i % 3)} words vilething number {i} of many vilething here", "en", "s", 0) for i in range(60)]
    good = [(20_000 + i, f"some kind words and a thing number {i} of many things {i * 7} here", "en", "s", 0) for i in range(60)]
    more = spark.createDataFrame(bad + good, COLUMNS)
    docs.unionByName(more).write.parquet(f"{path}/documents.parquet")
    labels = [(k, 1, 1) for k, *_ in bad] + [(k, 1, 0) for k, *_ in good]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_equal_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    now = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        out.write.parquet(path := f"{folder}/{name}")
        docs = spark.read.parquet(path)
        if name == "packing":
            break
        assert docs.columns == columns
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "toxicity":
            assert not any(10_000 <= k < 20_000 for k in after) and sum(20_000 <= k for k in after) == 60
            assert set(now) - set(after) <= set(range(10_000, 20_000))
        elif name == "near_duplicates":
            assert set(after) == {k for k, (_, _, kept) in brute_near(now, 5).items() if kept}
        else:
            want = brute_repeats(now)
            keep = {k: t if want[k][1] == 0 else want[k][3].decode("utf-8", "replace") for k, t in now.items() if want[k][1] == 0 or want[k][3]}
            assert set(after) == set(keep) and all(after[k] == t for k, t in keep.items() if want[k][3].isascii())
        now = after
    total = collections.Counter()
    for r in docs.collect():
        total[r["doc_id"]] += r["length"]
    enc = bpe.encoder(bpe.vocabulary())
    assert total == {k: len(enc.encode_batch([t or ""])[0]) + 1 for k, t in now.items()}


def test_clashing_columns_null_ids_and_empty_tables(spark, folder):
    """Columns named as those that stages add, rows without an id, repeated rows, and no rows at all."""
    clash = ", times int, _row long, row long, kept string, n_shingles int, score string, n_removed string, parts int, piece int, ids string"
    text = "one two three four five six seven eight nine ten " * 4
    rows = [(1, text), (2, text + "eleven"), (None, text), (None, None), (None, "alone"), (None, "alone"), (3, ""), (4, "short"), (4, "short"), (5, None), (6, "some vile words vilething number 7 of many vilething here")]
    rows = [(k, t, "en", "s", len(t or ""), 7, 8, 9, "k", 1, "s", "r", 3, 5, "i") for k, t in rows]
    docs = spark.createDataFrame(rows, COLUMNS + clash)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert stage(spark, docs.limit(0), folder).count() == 0
        kept[name] = collections.Counter((r["doc_id"], r["text"]) if name != "packing" else r["doc_id"] for r in out.collect())
        if name != "packing":
            assert out.columns == docs.columns
    assert (6, rows[-1][1]) not in kept["toxicity"] and sum(kept["toxicity"].values()) == 10
    near = kept["near_duplicates"]
    assert near[1, text] == 1 and (2, text + "eleven") not in near and (None, text) not in near and near[None, "alone"] == 1 and near[4, "short"] == 1
    assert near[None, None] == near[5, None] == near[3, ""] == 1
    assert sum(kept["suffix_dedup"].values()) == 11
    assert sum(kept["packing"].values()) == 11
