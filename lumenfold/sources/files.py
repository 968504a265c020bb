"""Files by byte offset as Spark data sources: chunks of lines, growing files as a stream, one file written in order.

All three work on folders that the driver and the executors share, and move only offsets through the driver.

- `read_line_chunks` plans byte ranges and snaps them to line ends, so each byte is read once, whatever the chunks.
- `stream_lines` follows files that grow; its offsets are bytes of each file, so a query that dies goes on where its
  checkpoint says, without loss or repeats.
- `write_in_order` writes one file from many tasks, each at its own offset; a failed job leaves nothing.
"""

from __future__ import annotations

import glob
import json
import os
import struct
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..session import cut

CHUNK_BYTES = 64 << 20
BUFFER = 1 << 20
LINES = "file string, offset long, line string"


def local_path(path: str) -> str:
    if "://" in path and not path.startswith("file://"):
        raise ValueError(f"{path}: these sources need a shared folder that is mounted as a path")
    return path.removeprefix("file://")


def _files(path: str) -> list[str]:
    path = local_path(path)
    found = glob.glob(f"{path}/*") if os.path.isdir(path) else glob.glob(path)
    return sorted(f for f in found if os.path.isfile(f) and not os.path.basename(f).startswith(("_", ".")))


class Range(InputPartition):
    """Bytes [start, stop) of a file: the lines that begin there."""

    def __init__(self, file: str, start: int, stop: int, chunk: int = 0):
        self.file, self.start, self.stop, self.chunk = file, start, stop, chunk


def _lines(part: Range) -> Iterator[tuple[int, str]]:
    """Offset and text of each line that begins in the range; the last one may end after it."""
    with open(part.file, "rb", buffering=BUFFER) as f:
        at = part.start
        if at:
            f.seek(at - 1)
            at += len(f.readline()) - 1  # up to the end of the line that began before
        while at < part.stop and (line := f.readline()):
            yield at, line.rstrip(b"\n").removesuffix(b"\r").decode("utf-8", "replace")
            at += len(line)


class _ChunkReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.size = options["path"], int(options.get("bytes", CHUNK_BYTES))

    def partitions(self) -> Sequence[InputPartition]:
        ranges = [(f, a, min(a + self.size, n)) for f in _files(self.path) for n in [os.path.getsize(f)] for a in range(0, n, self.size)]
        return [Range(*r, chunk=i) for i, r in enumerate(ranges)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        if partition.file:
            for at, line in _lines(partition):
                yield partition.chunk, partition.file, at, line


class LineChunks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "line_chunks"

    def schema(self) -> str:
        return f"chunk int, {LINES}"

    def reader(self, schema) -> DataSourceReader:
        return _ChunkReader(self.options)


def read_line_chunks(spark: SparkSession, path: str, bytes_: int = CHUNK_BYTES) -> DataFrame:
    """chunk, file, offset and line of every line below `path`; a chunk holds the lines that begin in `bytes_` bytes.

    (chunk, offset) is the order of the lines, so the first n are a sort with a limit that reads like a file's head.
    """
    spark.dataSource.register(LineChunks)
    return spark.read.format("line_chunks").option("bytes", bytes_).load(path)


def head(spark: SparkSession, path: str, n: int, bytes_: int = CHUNK_BYTES) -> DataFrame:
    """The first n lines in the order of files and lines."""
    return read_line_chunks(spark, path, bytes_).orderBy("chunk", "offset").limit(n)


def _whole_lines(file: str, size: int) -> int:
    """How many bytes of the file hold whole lines."""
    with open(file, "rb") as f:
        while size:
            step = min(size, BUFFER)
            f.seek(size - step)
            at = f.read(step).rfind(b"\n")
            if at >= 0:
                return size - step + at + 1
            size -= step
    return 0


class _Tail(DataSourceStreamReader):
    def __init__(self, options):
        self.path, self.most, self.size = options["path"], int(options.get("maxBytes", 1 << 40)), int(options.get("bytes", CHUNK_BYTES))
        self.planned: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """All whole lines of the files, or about `maxBytes` more than planned before; a file counts from its known offset."""
        left, out = self.most, dict(self.planned)
        for f in _files(self.path):
            known = out.get(f, 0)
            size = os.path.getsize(f)
            if size > known and left > 0:
                stop = _whole_lines(f, min(size, known + left))
                if stop <= known:  # one line is longer than what is left
                    stop = _whole_lines(f, size) if size <= known + BUFFER else self._next_end(f, known)
                if stop > known:
                    left -= stop - known
                    out[f] = stop
        self.planned = out
        return out

    @staticmethod
    def _next_end(file: str, at: int) -> int:
        with open(file, "rb", buffering=BUFFER) as f:
            f.seek(at)
            line = f.readline()
        return at + len(line) if line.endswith(b"\n") else at

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        self.planned = {f: max(n, self.planned.get(f, 0)) for f, n in end.items()}
        return [Range(f, a, min(a + self.size, stop)) for f, stop in sorted(end.items()) for a in range(start.get(f, 0), stop, self.size)]

    def read(self, partition: Range) -> Iterator[tuple]:
        for at, line in _lines(partition):
            yield partition.file, at, line

    def commit(self, end: dict) -> None:
        """Files stay; what was read is named by the query's own checkpoint."""


class LineStream(DataSource):
    @classmethod
    def name(cls) -> str:
        return "line_stream"

    def schema(self) -> str:
        return LINES

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Tail(self.options)


def stream_lines(spark: SparkSession, path: str, max_bytes: int | None = None, bytes_: int = CHUNK_BYTES) -> DataFrame:
    """A stream of file, offset and line of files that only grow; a line counts once it has its end."""
    spark.dataSource.register(LineStream)
    reader = spark.readStream.format("line_stream").option("bytes", bytes_)
    return (reader.option("maxBytes", max_bytes) if max_bytes else reader).load(path)


class Written(WriterCommitMessage):
    def __init__(self, size: int):
        self.size = size


class _Placed(DataSourceWriter):
    """Each task writes its rows at its own offset of a file with another name, which the commit renames."""

    def __init__(self, options):
        self.path, self.part, self.starts = options["path"], options["part"], json.loads(options["starts"])

    def write(self, iterator) -> WriterCommitMessage:
        number, size = TaskContext.get().partitionId(), 0
        begin, end = (self.starts[min(i, len(self.starts) - 1)] for i in (number, number + 1))  # Spark runs one task for no ranges
        with open(os.open(self.part, os.O_WRONLY | os.O_CREAT, 0o666), "wb", buffering=BUFFER) as f:
            f.seek(begin)
            for row in iterator:
                size += f.write(row[0])
        if size != end - begin:
            raise ValueError("the rows are not those that were measured")
        return Written(size)

    def commit(self, messages) -> None:
        if sum(m.size for m in messages if m) != self.starts[-1]:
            raise ValueError("parts of the file are missing")
        os.replace(self.part, self.path)

    def abort(self, messages) -> None:
        if os.path.exists(self.part):
            os.remove(self.part)


class OrderedFile(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ordered_file"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Placed(self.options)


def write_in_order(rows: DataFrame, data: Column, order: Sequence[str], path: str) -> None:
    """Write the bytes `data` of all rows in this order as one file; an older one is replaced when all is written.

    Rows are dealt out by ranges of the order and kept; each range's size is summed, and its task writes at the sum of
    the sizes before it.  Null data counts as no bytes.
    """
    spark, path = rows.sparkSession, os.path.abspath(local_path(path))
    spark.dataSource.register(OrderedFile)
    named = rows.select(F.coalesce(data.cast("binary"), F.lit(b"")).alias("data"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    by = [f"_o{i}" for i in range(len(order))]
    ranges = cut(named.repartitionByRange(*by).sortWithinPartitions(*by).select("data"))
    sizes = {r[0]: r[1] for r in ranges.groupBy(F.spark_partition_id().alias("p")).agg(F.sum(F.octet_length("data"))).collect()}  # one row a range
    starts = np.cumsum([0, *(sizes.get(p, 0) for p in range(ranges.rdd.getNumPartitions()))]).tolist()
    part = f"{os.path.dirname(path)}/.{os.path.basename(path)}-{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        f.truncate(starts[-1])
    ranges.write.format("ordered_file").mode("append").options(path=path, part=part, starts=json.dumps(starts)).save()


def write_score_file(scores: DataFrame, people: DataFrame, path: str) -> None:
    """The score matrix as one text file: names, flags, then a row of `score/chosen` cells for each enabled person.

    `people` has place (from 0 without gaps), name and enabled, `scores` has row, col, score and chosen.  Rows of people
    who are not enabled hold X; a missing cell of the others is 0/0.  Scores are written so that they read back equal.
    """
    n = people.count()
    cells = people.filter("enabled").select(F.col("place").alias("row")).join(scores.select("row", "col", "score", "chosen"), "row", "left")
    cell = F.concat(F.coalesce(F.col("score"), F.lit(0.0)).cast("string"), F.lit("/"), F.when(F.coalesce("chosen", F.lit(False)), "1").otherwise("0"))
    held = cells.groupBy("row").agg(F.map_from_entries(F.collect_list(F.when(F.col("col").isNotNull(), F.struct(F.col("col").cast("int"), cell)))).alias("m"))
    columns = F.sequence(F.lit(0), F.lit(n - 1)) if n else F.array().cast("array<int>")
    filled = F.array_join(F.transform(columns, lambda c: F.coalesce(F.try_element_at("m", c), F.lit("0.0/0"))), ",")
    rows = people.join(held, people["place"] == held["row"], "left").select(F.col("place").cast("long").alias("at"), F.when(F.col("enabled"), filled).otherwise(F.array_join(F.transform(columns, lambda _: F.lit("X")), ",")).alias("line"))
    listed = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", c.alias("v")))), lambda s: s["v"]), ",")
    heads = people.agg(listed(F.col("name")).alias("a"), listed(F.when(F.col("enabled"), "Y").otherwise("N")).alias("b"))
    heads = heads.select(F.explode(F.array(F.struct(F.lit(-2).cast("long").alias("at"), F.col("a").alias("line")), F.struct(F.lit(-1).cast("long").alias("at"), F.col("b").alias("line")))).alias("x")).select("x.*")
    lines = heads.unionByName(rows)
    write_in_order(lines, F.concat("line", F.lit("\n")), ["at"], path)


# The codes of number types in the header of a matrix file.
MATRIX_TYPES = {0: "<i2", 1: "<i4", 2: "<i8", 3: "<f8"}
HEADER = struct.Struct("<iii")


def write_matrix_file(matrix: DataFrame, path: str, code: int = 3) -> None:
    """Rows (row from 0, values of one length) as one binary file: type, rows, columns, then the numbers by rows."""
    kind = np.dtype(MATRIX_TYPES[code])
    shape = matrix.agg(F.count("*"), F.max(F.size("values")), F.min(F.size("values"))).first()
    if shape[0] and shape[1] != shape[2]:
        raise ValueError("rows have different lengths")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("values").flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(b), -1)
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array([r.tobytes() for r in x], pa.binary())], ["row", "data"])

    body = matrix.select(F.col("row").cast("long").alias("row"), "values").mapInArrow(packed, "row long, data binary")
    header = matrix.sparkSession.createDataFrame([(-1, bytearray(HEADER.pack(code, shape[0], shape[1] or 0)))], "row long, data binary")
    write_in_order(header.unionByName(body), F.col("data"), ["row"], path)


class _Rows(DataSourceReader):
    def __init__(self, options):
        self.path, self.size = local_path(options["path"]), int(options.get("bytes", CHUNK_BYTES))

    def partitions(self) -> Sequence[InputPartition]:
        with open(self.path, "rb") as f:
            code, rows, columns = HEADER.unpack(f.read(HEADER.size))
        if os.path.getsize(self.path) != HEADER.size + rows * columns * np.dtype(MATRIX_TYPES[code]).itemsize:
            raise ValueError(f"{self.path} is not a whole matrix file")
        step = max(1, self.size // max(1, columns * 8))
        return [Range(json.dumps([code, columns]), a, min(a + step, rows)) for a in range(0, rows, step)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        if partition.file:
            code, columns = json.loads(partition.file)
            kind = np.dtype(MATRIX_TYPES[code])
            x = np.fromfile(self.path, kind, (partition.stop - partition.start) * columns, offset=HEADER.size + partition.start * columns * kind.itemsize)
            for i, r in enumerate(x.reshape(-1, columns).astype(np.float64).tolist()):
                yield partition.start + i, r


class MatrixFile(DataSource):
    @classmethod
    def name(cls) -> str:
        return "matrix_file"

    def schema(self) -> str:
        return "row long, values array<double>"

    def reader(self, schema) -> DataSourceReader:
        return _Rows(self.options)


def read_matrix_file(spark: SparkSession, path: str, bytes_: int = CHUNK_BYTES) -> DataFrame:
    """Rows of a binary matrix file, by ranges of rows."""
    spark.dataSource.register(MatrixFile)
    return spark.read.format("matrix_file").option("bytes", bytes_).load(path)


def copy_as(df: DataFrame, path: str, kind: str, **options) -> DataFrame:
    """Write a table in one of Spark's columnar formats and read it back with its schema."""
    df.write.format(kind).options(**options).save(path)
    return df.sparkSession.read.format(kind).schema(df.schema).load(path)
