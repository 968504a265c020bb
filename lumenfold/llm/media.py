"""Media columns: payloads in archive files, read through a Spark data source.

`store_payloads` writes each payload as an 8-bit greyscale PNG of 64 samples a row into archive files; each archive has
a sidecar with the offsets of its members.  `ArchiveSource` is a custom data source that plans byte ranges over an
archive directory, streams its members as Arrow batches and retries each member on its own, by offset.
"""

from __future__ import annotations

import struct
import time
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .common import filesystem, shared_path, small_batches

WIDTH = 64
ARCHIVE_BYTES = 64 << 20
RANGE_BYTES = 8 << 20
BATCH_BYTES = 4 << 20
RETRIES = 4
PNG_START = b"\x89PNG\r\n\x1a\n"  # fixed by the PNG format
MEMBER_SCHEMA = "member_id long, n_bytes long, media binary"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def padded(data: bytes) -> bytes:
    """Zero bytes up to a positive multiple of 64."""
    return data.ljust(max(WIDTH, -(-len(data) // WIDTH) * WIDTH), b"\0")


def to_png(payload: bytes) -> bytes:
    """A payload, a positive multiple of 64 bytes, as greyscale samples; unfiltered rows, so equal payloads give equal files."""
    rows = len(payload) // WIDTH
    lines = np.zeros((rows, WIDTH + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, WIDTH)
    return PNG_START + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    """The samples; raises ValueError if the file is damaged or of another kind."""
    if media[:8] != PNG_START:
        raise ValueError("not a PNG file")
    at, data, shape = 8, [], None
    while at < len(media):
        (n,) = struct.unpack(">I", media[at : at + 4])
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + body):
            raise ValueError("a chunk is damaged")
        if kind == b"IHDR":
            shape = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    if shape is None or shape[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not plain 8-bit greyscale")
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(shape[1], shape[0] + 1)
    if lines[:, 0].any():
        raise ValueError("filtered rows are not supported")
    return lines[:, 1:].tobytes()


def features(payload: bytes) -> str:
    """Mean, standard deviation, zero crossings about 128, entropy in bits and mean absolute step of the samples."""
    x = np.frombuffer(payload, np.uint8)
    share = np.bincount(x, minlength=256) / len(x)
    share = share[share > 0]
    step = np.abs(np.diff(x.astype(np.int16)))
    crossings = int(np.count_nonzero(np.diff(x >= 128)))
    return f"mean={x.mean():.6f};std={x.std():.6f};crossings={crossings};entropy={-(share * np.log2(share)).sum():.6f};step={step.mean():.6f}"


def store_payloads(docs: DataFrame, path: str | None = None) -> str:
    """Write every text (null: empty), padded, to archives in a shared folder; returns the folder.

    Each task attempt writes files of its own.  The manifest, which Spark commits, names those that count, so retried
    tasks and lost executors leave only files that nothing names.
    """
    spark = docs.sparkSession
    small_batches(spark)
    path = path or shared_path(spark, "media")
    store, folder = filesystem(path)
    store.create_dir(folder, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = filesystem(path)
        out, name, at, index, made = None, "", 0, [], []

        def close() -> None:
            table = pa.table({"member_id": pa.array([x[0] for x in index], pa.int64()), "n_bytes": pa.array([x[1] for x in index], pa.int64()), "offset": pa.array([x[2] for x in index], pa.int64()), "size": pa.array([x[3] for x in index], pa.int64())})
            out.close()
            with store.open_output_stream(f"{folder}/{name}.idx") as f, pa.ipc.new_file(f, table.schema) as w:
                w.write_table(table)
            made.append((name, at, len(index)))

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                raw = (text.as_py() or "").encode()
                media = to_png(padded(raw))
                if out is None:
                    name, at, index = f"{uuid.uuid4().hex}.arc", 0, []
                    out = store.open_output_stream(f"{folder}/{name}")
                out.write(media)
                index.append((doc_id, len(raw), at, len(media)))
                at += len(media)
                if at >= ARCHIVE_BYTES:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["archive", "bytes", "members"])

    docs.select("doc_id", "text").mapInArrow(write, "archive string, bytes long, members long").write.parquet(f"{path}/_manifest")
    return path


class ByteRange(InputPartition):
    def __init__(self, archive: str, start: int, stop: int):
        self.archive, self.start, self.stop = archive, start, stop


class ArchiveReader(DataSourceReader):
    """Members whose first byte lies in a partition's range belong to it."""

    def __init__(self, path: str, range_bytes: int):
        self.path, self.range_bytes = path, range_bytes

    def partitions(self) -> list[InputPartition]:
        import pyarrow.dataset as ds

        store, folder = filesystem(self.path)
        # One row per archive, not per member; hidden names are left out by default.
        rows = ds.dataset(f"{folder}/_manifest", filesystem=store, format="parquet", ignore_prefixes=[".", "_S", "_c"]).to_table().to_pylist()
        out = [ByteRange(r["archive"], a, min(a + self.range_bytes, r["bytes"])) for r in sorted(rows, key=lambda r: r["archive"]) for a in range(0, r["bytes"], self.range_bytes)]
        return out or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        store, folder = filesystem(self.path)
        with store.open_input_file(f"{folder}/{partition.archive}.idx") as f:
            index = pa.ipc.open_file(f).read_all()
        offset = index.column("offset").to_numpy()
        a, b = np.searchsorted(offset, [partition.start, partition.stop])
        rows, held = [], 0
        for member, n, at, size in zip(*(index.column(c).slice(a, b - a).to_pylist() for c in ("member_id", "n_bytes", "offset", "size"))):
            rows.append((member, n, read_member(store, f"{folder}/{partition.archive}", at, size)))
            held += size
            if held >= BATCH_BYTES:
                yield _members(rows)
                rows, held = [], 0
        if rows:
            yield _members(rows)


def _members(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], ["member_id", "n_bytes", "media"])


_OPEN: dict[str, object] = {}


def read_member(store, name: str, offset: int, size: int, wait: float = 0.05) -> bytes:
    """One member; opens the archive again and goes on at its offset if a read fails or falls short."""
    for attempt in range(RETRIES):
        try:
            if name not in _OPEN:
                for f in _OPEN.values():
                    f.close()
                _OPEN.clear()
                _OPEN[name] = store.open_input_file(name)
            data = _OPEN[name].read_at(size, offset)
            if len(data) == size:
                return data
            raise OSError(f"{name}: {len(data)} of {size} bytes at {offset}")
        except (OSError, ValueError):
            _OPEN.pop(name, None)
            if attempt == RETRIES - 1:
                raise
            time.sleep(wait * 2**attempt)
    raise AssertionError


class ArchiveSource(DataSource):
    """spark.read.format("media_archive").option("range_bytes", n).load(path)"""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return MEMBER_SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return ArchiveReader(self.options["path"], int(self.options.get("range_bytes", RANGE_BYTES)))


def read_archive(spark, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("media_archive").option("range_bytes", str(range_bytes)).load(path)


def media_features(members: DataFrame) -> DataFrame:
    """Decode members and describe them: one row each."""
    from .bpe import sha256_hex

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    names = [x.split()[0] for x in schema.split(", ")]

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for member, n, media in zip(batch.column("member_id").to_pylist(), batch.column("n_bytes").to_pylist(), batch.column("media")):
                media = media.as_py()
                payload = from_png(media)
                rows.append((member, n, len(payload), sha256_hex(payload), zlib.crc32(payload[-WIDTH:]), len(media), sha256_hex(media), features(payload)))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    return members.mapInArrow(describe, schema)


def media_columns(docs: DataFrame) -> DataFrame:
    """Store every text as media, read it back and describe it.  Repeated rows give repeated members; an empty table gives none."""
    spark = docs.sparkSession
    return media_features(read_archive(spark, store_payloads(docs)))
