"""The registered queries of the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, collisions, html, license, media, neardup, order, packing, periodic, search, spelling, suffix, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.read_shards(order.materialise(_table(spark, sf_dir, "documents"), bpe.vocabulary()))


def op2_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_roundtrip(_table(spark, sf_dir, "documents"), bpe.vocabulary())


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(_table(spark, sf_dir, "documents"))


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return search.top_k(vectors, vectors.filter("vec_id % 50 = 0"), k=5)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.license_labels(_table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeat_digests(_table(spark, sf_dir, "documents"))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(_table(spark, sf_dir, "pages"))


def op8_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), size=4, percent=80).drop("row")


def op9_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), bpe.vocabulary())


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(spelling.word_counts(_table(spark, sf_dir, "documents"), spelling.with_slips))


def op12_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collisions.link_counts(_table(spark, sf_dir, "embeddings"), cosine=0.95)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_digests(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_training_order,
        op2_bpe_roundtrip,
        op3_media_columns,
        op4_exact_topk,
        op5_license_scan,
        op6_suffix_dedup,
        op7_main_text,
        op8_minhash_neardup,
        op9_bestfit_packing,
        op10_toxicity,
        op11_spelling_variants,
        op12_embedding_neardup,
        op13_periodic_runs,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op4_exact_topk": """
        WITH q AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
                   FROM q a JOIN q b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
             r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    # The checksum is a fold over the bytes of a word, eight bits each.
    "op11_spelling_variants": """
        WITH RECURSIVE runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
             lowered AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM runs WHERE length(run) >= 6),
             each AS (SELECT doc_id, w, count(*) AS n, hex(encode(doc_id || ':' || w)) AS code FROM lowered GROUP BY doc_id, w),
             summed AS (SELECT w, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(code), 2), lambda i: ('0x' || code[i + 1:i + 2])::BIGINT)),
                        lambda c, x: list_reduce(list_prepend(xor(c, x), range(8)), lambda d, k: xor(d >> 1, CASE WHEN d & 1 = 1 THEN 3988292384::BIGINT ELSE 0 END))), 4294967295) AS h FROM each),
             words AS (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n AS m FROM summed),
             v AS (SELECT word, CAST(sum(m) AS BIGINT) AS n FROM words WHERE length(word) >= 6 GROUP BY word HAVING sum(m) >= 5),
             places AS (SELECT word, n, unnest(range(length(word) + 1)) AS i FROM v),
             keys AS (SELECT word, n, true AS skips, substr(word, 1, i) AS a, substr(word, i + 2) AS b FROM places WHERE i < length(word)
                      UNION ALL SELECT word, n, false, substr(word, 1, i), substr(word, i + 1) FROM places),
             near AS (SELECT DISTINCT x.word, x.n, y.word AS other, y.n AS other_n FROM keys x JOIN keys y ON x.a = y.a AND x.b = y.b AND x.word <> y.word AND (x.skips OR y.skips)),
             ranked AS (SELECT *, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS r FROM near),
             best AS (SELECT word, n_near, CASE WHEN other_n >= 5 * n THEN other END AS form, CASE WHEN other_n >= 5 * n THEN other_n END AS form_n FROM ranked WHERE r = 1),
             chain AS (SELECT word, form AS root FROM best WHERE form IS NOT NULL UNION ALL SELECT c.word, b.form FROM chain c JOIN best b ON b.word = c.root WHERE b.form IS NOT NULL),
             last AS (SELECT word, root FROM chain WHERE root NOT IN (SELECT word FROM best WHERE form IS NOT NULL))
        SELECT v.word, form, coalesce(root, v.word) AS root, n, coalesce(n_near, 0) AS n_near, form_n FROM v LEFT JOIN best ON best.word = v.word LEFT JOIN last ON last.word = v.word""",
    "op12_embedding_neardup": """
        WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
                             WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
             links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
             reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
             n AS (SELECT a, count(*) AS n FROM links GROUP BY a),
             c AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
        SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(c, vec_id)) AS component_id, vec_id <= coalesce(c, vec_id) AS kept
        FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id""",
}
