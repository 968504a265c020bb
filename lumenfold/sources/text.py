"""Text sources and sinks: CSV, TSV, JSON, lines, score matrices."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import files


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None, header: bool = True, sep: str = ",", names: Sequence[str] | None = None,
             columns: Sequence[str] | None = None, na: Sequence[str] = (), na_by_column: Mapping[str, Sequence[str]] | None = None, bad_lines: str = "fail", quote: str = '"', escape: str = "\\", rows: int | None = None, order: Sequence[str] = ()) -> DataFrame:
    """Delimited text.  Types are inferred only without a schema; `bad_lines` is fail, drop or keep (column _corrupt_record).

    Values in `na`, or in `na_by_column` for one column, become NULL.  `rows` limits how many rows are read: the
    first ones by `order`, or any without it (`files.head` gives a file's first lines).
    """
    reader = spark.read.option("header", header).option("sep", sep).option("quote", quote).option("escape", escape)
    reader = reader.option("mode", {"fail": "FAILFAST", "drop": "DROPMALFORMED", "keep": "PERMISSIVE"}[bad_lines])
    if schema is None:
        reader = reader.option("inferSchema", True)
    else:
        text = schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        reader = reader.schema(text + (", _corrupt_record string" if bad_lines == "keep" else ""))
    df = reader.csv(path)
    if rows is not None:
        df = (df.orderBy(*order) if order else df).limit(rows)
    if names:
        df = df.toDF(*names)
    if columns:
        df = df.select(*columns)
    missing = {c: list(na) + list((na_by_column or {}).get(c, ())) for c in df.columns}
    return df.withColumns({c: F.when(~F.col(c).cast("string").isin(*v) | F.col(c).isNull(), F.col(c)) for c, v in missing.items() if v})


def read_chunks(spark: SparkSession, path: str, chunks: int, key: str, **options) -> list[DataFrame]:
    """A file in pieces that are read and counted on their own: the rows whose key falls into each residue class."""
    whole = read_csv(spark, path, **options)
    return [whole.filter(F.pmod(F.xxhash64(key), F.lit(chunks)) == i) for i in range(chunks)]


def read_csv_chunks(spark: SparkSession, path: str, schema: str, bytes_: int = files.CHUNK_BYTES, sep: str = ",", header: bool = True) -> DataFrame:
    """Column chunk and the columns of `schema`: one scan in which each byte is read once, in chunks of about `bytes_` bytes.

    A chunk is what one task reads, so `groupBy("chunk")` counts pieces on their own; `chunk` and `offset` are the order
    of the lines.  The first line of each file is its header.  A value may not hold a line end.
    """
    lines = files.read_line_chunks(spark, path, bytes_)
    if header:
        lines = lines.filter("offset > 0")
    parsed = F.from_csv("line", schema, {"sep": sep})
    return lines.filter("line <> ''").select("chunk", "offset", parsed.alias("r")).select("chunk", "offset", "r.*")


def read_tsv(spark: SparkSession, path: str, **options) -> DataFrame:
    return read_csv(spark, path, sep="\t", **options)


def write_csv(df: DataFrame, path: str, columns: Sequence[str] | None = None, header: bool = True, na: str = "", sep: str = ",", quote_all: bool = False, mode: str = "errorifexists") -> None:
    out = df.select(*columns) if columns else df
    out.write.mode(mode).option("header", header).option("nullValue", na).option("emptyValue", "").option("sep", sep).option("quoteAll", quote_all).csv(path)


def read_json_array(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """A document that is one array of objects; chosen fields."""
    return spark.read.option("multiLine", True).json(path).select(*columns)


def write_json_lines(df: DataFrame, path: str, by: Sequence[str], rows: int | None = None) -> None:
    """JSON lines, of the first rows in an explicit order if a number is given."""
    (df.orderBy(*by).limit(rows) if rows is not None else df).write.json(path)


def read_records(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """One JSON object a file: the good records, and the files that hold an error or cannot be read."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    parsed = whole.withColumns({"r": F.from_json("value", schema), "error": F.get_json_object("value", "$.error")})
    good = F.col("r").isNotNull() & F.col("error").isNull()
    return parsed.filter(good).select("file", "r.*"), parsed.filter(~good).select("file", "error")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "line")


def read_score_matrix(spark: SparkSession, path: str) -> DataFrame:
    """A small matrix file: names, flags (Y or N), then rows of `score/chosen` cells, a row of X for a free place.

    Returns row, col, row_name, col_name, enabled, score, chosen in long form.
    """
    lines = spark.read.text(path, wholetext=True).select(F.split(F.trim("value"), r"\r?\n").alias("l"))
    parts = lines.select(F.split(F.get("l", F.lit(0)), r"\s*,\s*").alias("names"), F.split(F.get("l", F.lit(1)), r"\s*,\s*").alias("flags"), F.posexplode(F.slice("l", 3, F.size("l"))).alias("row", "line"))
    cells = parts.select("names", "flags", "row", F.posexplode(F.split("line", r"\s*,\s*")).alias("col", "cell")).filter(F.contains("cell", F.lit("/")))
    pick = F.split("cell", "/")
    return cells.select(
        "row", "col", F.get("names", F.col("row")).alias("row_name"), F.get("names", F.col("col")).alias("col_name"), (F.get("flags", F.col("row")) == "Y").alias("enabled"),
        F.get(pick, F.lit(0)).try_cast("double").alias("score"), (F.get(pick, F.lit(1)) == "1").alias("chosen"),
    )


def write_score_matrix(scores: DataFrame, path: str) -> None:
    scores.select("row", "col", "score", "chosen").write.parquet(path)


def read_process_list(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a process listing: pid, command, port (NULL without `port=`)."""
    x = F.trim("value")
    rows = spark.read.text(path).select(F.split(x, r"\s+").alias("f"), x.alias("v"))
    return rows.select(F.get("f", F.lit(0)).try_cast("long").alias("pid"), F.get("f", F.lit(-1) + F.size("f")).alias("command"), F.nullif(F.regexp_extract("v", r"port=(\d+)", 1), F.lit("")).try_cast("int").alias("port")).filter("pid is not null")


def read_table(spark: SparkSession, url: str, table: str, **options) -> DataFrame:
    """A JDBC table; give partitionColumn, lowerBound, upperBound and numPartitions to read it in parallel."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def append_table(df: DataFrame, url: str, table: str, **options) -> None:
    """Insert rows in batches with bound parameters."""
    df.write.format("jdbc").options(url=url, dbtable=table, **options).mode("append").save()
