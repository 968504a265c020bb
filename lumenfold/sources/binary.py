"""Binary sources: WAV, image folders, IDX arrays, matrices and model tables.

Files are read by Spark's `binaryFile` source, so any store that Spark reads will do, and decoded in Arrow batches.
"""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WAV_SCHEMA = "path string, channels int, rate int, bits int, n_samples long, samples array<double>, error string"


def parse_wav(data: bytes) -> tuple[dict, np.ndarray]:
    """Header and samples of a RIFF file with 16-bit signed PCM; raises ValueError for others."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, head, body = 12, None, None
    while at + 8 <= len(data):
        kind, n = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
        if kind == b"fmt ":
            form, channels, rate, _, _, bits = struct.unpack("<HHIIHH", data[at + 8 : at + 24])
            head = {"format": form, "channels": channels, "rate": rate, "bits": bits}
        elif kind == b"data":
            body = data[at + 8 : at + 8 + n]
        at += 8 + n + (n & 1)
    if head is None or body is None:
        raise ValueError("fmt or data chunk is missing")
    if head["format"] != 1 or head["bits"] != 16:
        raise ValueError("only 16-bit PCM is supported")
    return head, np.frombuffer(body[: len(body) // 2 * 2], "<i2")


def make_wav(samples: np.ndarray, rate: int = 16000, channels: int = 1) -> bytes:
    body = np.clip(np.round(samples), -32768, 32767).astype("<i2").tobytes()
    fmt = struct.pack("<HHIIHH", 1, channels, rate, rate * 2 * channels, 2 * channels, 16)
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<I", 16) + fmt + b"data" + struct.pack("<I", len(body)) + body


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)


def scan_folder(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, name and length of files, without their content."""
    f = _files(spark, path, pattern).select("path", "length", "modificationTime")
    return f.withColumn("name", F.element_at(F.split("path", "/"), -1))


def read_wav(spark: SparkSession, path: str) -> DataFrame:
    """One row a file; a file that is no 16-bit WAV has an error and null samples."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for name, data in zip(p["path"], p["content"]):
                try:
                    h, x = parse_wav(data)
                    out.append((name, h["channels"], h["rate"], h["bits"], len(x), x.astype(float).tolist(), None))
                except (ValueError, struct.error) as e:
                    out.append((name, None, None, None, None, None, str(e)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in WAV_SCHEMA.split(", ")]).astype({"channels": "Int32", "rate": "Int32", "bits": "Int32", "n_samples": "Int64"})

    return _files(spark, path, "*.wav").select("path", "content").mapInPandas(run, WAV_SCHEMA)


def write_wav(df: DataFrame, folder: str, name: str = "name", samples: str = "samples", rate: int = 16000) -> DataFrame:
    """Write one file a row and return name, path and bytes; runs when the result is used.  Files are replaced whole, so retries are safe."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        for p in parts:
            rows = []
            for n, x in zip(p[name], p[samples]):
                data = make_wav(np.asarray(x, float), rate)
                with store.open_output_stream(f"{base}/{n}.wav") as f:
                    f.write(data)
                rows.append((n, f"{folder}/{n}.wav", len(data)))
            yield pd.DataFrame(rows, columns=["name", "path", "bytes"])

    return df.select(name, samples).mapInPandas(run, "name string, path string, bytes long")


def parse_idx(data: bytes) -> np.ndarray:
    """An IDX array of unsigned bytes, gzipped or not."""
    raw = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
    zero, kind, dims = struct.unpack(">HBB", raw[:4])
    if zero or kind != 8:
        raise ValueError("not an IDX file of unsigned bytes")
    shape = struct.unpack(f">{dims}I", raw[4 : 4 + 4 * dims])
    return np.frombuffer(raw, np.uint8, int(np.prod(shape)), 4 + 4 * dims).reshape(shape)


def read_idx(spark: SparkSession, path: str, rescale: bool = False) -> DataFrame:
    """path, index and values, one row an entry; images rescaled to -0.5..0.5 if wanted."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for name, data in zip(p["path"], p["content"]):
                x = parse_idx(data)
                flat = x.reshape(len(x), -1).astype(float)
                flat = flat / 255 - 0.5 if rescale else flat
                for a in range(0, len(flat), 1000):
                    yield pd.DataFrame({"path": name, "index": np.arange(a, min(a + 1000, len(flat))), "values": list(flat[a : a + 1000])})

    return _files(spark, path, "*").select("path", "content").mapInPandas(run, "path string, index long, values array<double>")


def image_labels(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files of an image folder with the label N of their folder `cN`."""
    return scan_folder(spark, path, pattern).withColumn("label", F.nullif(F.regexp_extract("path", r"/c(\d+)/[^/]+$", 1), F.lit("")).try_cast("int"))


def write_matrix(df: DataFrame, path: str) -> None:
    """Rows of arrays (row, values) as Parquet."""
    df.select("row", "values").write.parquet(path)


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_model(model: DataFrame, path: str) -> None:
    """The table of a mixture or a hidden Markov model; models are added side by side and told apart by `model`."""
    model.write.mode("append").parquet(path)


def load_model(spark: SparkSession, path: str, model: str) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("model") == model)
