"""A corpus pipeline of four stages; each reads what its predecessor wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm import bpe, neardup, packing, suffix, toxicity
from lumenfold.llm.common import save

VOCABULARY = "byte_bpe_50k.json"


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out the documents whose toxicity score reaches the threshold.

    Null and empty texts score as texts without hits; rows are judged one by one, so repeated rows go or stay together.
    """
    model = toxicity.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).filter(F.col("score") < toxicity.THRESHOLD).select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group that shares 80 % of its five-word shingles.

    Texts that are null or without words have no shingles and stay; of rows equal in id and text one stays.  Rows without
    an id stay unless they repeat another text.  An empty table gives an empty one.
    """
    kept = neardup.near_duplicates(docs, size=5, percent=80).filter("kept")
    # The added columns have names of their own, as documents may have any.
    kept = save(kept.groupBy(F.col("row").alias("_near_row")).agg((F.count("*") * F.max((F.col("n_shingles") > 0).cast("int"))).alias("_near_times")), "kept_rows")
    keyed = docs.withColumn("_near_row", F.xxhash64("doc_id", "text")).join(kept, "_near_row")
    once = keyed.filter("_near_times <= 1").unionByName(keyed.filter("_near_times > 1").dropDuplicates(["_near_row"]))
    return once.select(*docs.columns)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut out bytes that repeated strings of 200 bytes cover; a document of which nothing is left goes.

    Null and empty texts stay as they are.  A character that a cut splits becomes U+FFFD.
    """
    out = suffix.without_repeats(docs)
    text = F.try_validate_utf8(F.col("kept").cast("string"))
    whole = F.coalesce(text, F.make_valid_utf8(F.col("kept").cast("string")))
    out = out.filter("n_removed = 0 or octet_length(kept) > 0")
    out = out.withColumn("text", F.when(F.col("n_removed") == 0, F.col("text")).otherwise(whole))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the ids of every document into sequences of 2048 tokens; null and empty texts give their end token."""
    return packing.pack_documents(docs, bpe.vocabulary(VOCABULARY))


STAGES = [("toxicity", toxic), ("near_duplicates", near), ("suffix_dedup", repeats), ("packing", packed)]

# Tokens have no SQL form; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), name)
    return docs
