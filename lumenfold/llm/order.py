"""Training-order materialisation.

Every document's ids (and an end token) are cut into sequences of `seq_len`.  A keyed Feistel network with cycle
walking permutes the numbers (document, piece); the top of the permuted number names the shard, and the order inside a
shard is the order of the permuted numbers.  A sequence's global slot is the number of sequences in the shards before
its own plus its place there, so the slots are 0 to N-1 without a pass that only counts.  Each shard is one file of
records of a fixed stride, so a reader seeks to any slot and goes on from there.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import EOT, ByteBpe, encode_documents, encoder
from .common import filesystem, save, shared_path, small_batches

SEQ_LEN = 256
HEAD = np.dtype([("doc_id", "<i8"), ("piece", "<i4"), ("n", "<u2"), ("no_id", "<u2")])
ROUNDS = 4
LONG_CHARS = 65_536  # shards and their shuffle take most of the disk, so fewer texts than elsewhere are dealt out in pieces
WIDE = 1 << 62  # numbers up to here fit a long
TASKS = 20_000  # a task writes one shard after the other, so there need not be as many tasks as shards


def round_keys(key: str) -> np.ndarray:
    return np.frombuffer(hashlib.sha256(key.encode()).digest(), "<u8")[:ROUNDS]


def _round(x: np.ndarray, key: np.uint64) -> np.ndarray:
    x = (x ^ key) * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(29))


def feistel(x: np.ndarray, size: int, key: str, inverse: bool = False) -> np.ndarray:
    """A permutation of 0..size-1: a balanced Feistel network on the next even number of bits, walked until inside."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    h, mask = np.uint64(half), np.uint64((1 << half) - 1)
    keys = round_keys(key)
    out = x.astype(np.uint64).copy()
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> h, out[todo] & mask
        for k in keys[::-1] if inverse else keys:
            if inverse:
                left, right = right ^ (_round(left, k) & mask), left
            else:
                left, right = right, left ^ (_round(right, k) & mask)
        y = (left << h) | right
        out[todo] = y
        todo = todo[y >= size]
    return out.astype(np.int64)


def sequences(docs: DataFrame, vocab: str, key: str, size: int, per_doc: int, first_id: int, shards: int, seq_len: int, nulls: int = 0) -> DataFrame:
    """The permuted pieces.  Documents without an id share the last `nulls` document numbers, dealt by the hash of their ids."""
    end = encoder(vocab).special.get(EOT, 0)

    def finish(bpe: ByteBpe, doc_ids: pa.Array, ids: list[np.ndarray], texts: list[str]) -> pa.RecordBatch:
        no_id = doc_ids.is_null().to_numpy(zero_copy_only=False)
        number = doc_ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        if size <= WIDE:
            number = number - np.where(no_id, 0, first_id)
        at, piece, body = [], [], []
        for i, x in enumerate(ids):
            raw = np.append(x, end).astype("<u2").tobytes()
            if no_id[i]:
                number[i] = size // per_doc - nulls + xxhash.xxh3_64_intdigest(raw) % nulls if size <= WIDE else xxhash.xxh3_64_intdigest(raw) - 2**63
            for k in range(0, len(raw), 2 * seq_len):
                at.append(i)
                piece.append(k // (2 * seq_len))
                body.append(raw[k : k + 2 * seq_len])
        at = np.array(at, np.int64)
        part = np.array(piece, np.int64)
        if size <= WIDE:
            order = feistel(number[at] * per_doc + part, size, key)
            shard = (order.astype(object) * shards // size).astype(np.int32) if size > 2**40 else (order * shards // size).astype(np.int32)
        else:
            # Ids too far apart for a common range: 64-bit numbers, permuted as they are.  Where two pieces get one number,
            # the id and the piece decide their order.
            mixed = number[at].view(np.uint64) + part.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            order = feistel(mixed, 1 << 64, key)
            shard = ((order.view(np.uint64) >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int32)
            order = order ^ np.int64(-(2**63))
        return pa.RecordBatch.from_arrays(
            [doc_ids.take(pa.array(at)), pa.array(part.astype(np.int32)), pa.array(order), pa.array(shard), pa.array(body, pa.binary())], ["doc_id", "piece", "order", "shard", "ids"]
        )

    return encode_documents(docs, vocab, finish, "doc_id long, piece int, order long, shard int, ids binary", long_chars=LONG_CHARS)


def materialise(docs: DataFrame, vocab: str, key: str = "epoch-0", seq_len: int = SEQ_LEN, shard_bytes: int = 32 << 20, path: str | None = None) -> DataFrame:
    """Write the shards and return their manifest: shard, file, n_records, first_slot.

    Documents with a null doc_id have numbers behind all others; a null text is one sequence with the end token.  Rows
    that repeat a doc_id repeat its sequences, side by side.  An empty table gives no shard.  A task attempt writes a file of its own,
    and only files in the committed manifest count, so lost executors leave at most files that nothing names.
    """
    spark = docs.sparkSession
    small_batches(spark)
    path = path or shared_path(spark, "shards")
    low, high, most, total, nulls = docs.agg(
        F.min("doc_id"), F.max("doc_id"), F.max(F.octet_length("text")), F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1), F.count_if(F.col("doc_id").isNull())
    ).collect()[0]
    per_doc = -(-((most or 0) + 1) // seq_len)
    size = ((high or 0) - (low or 0) + 1 + nulls) * per_doc
    stride = HEAD.itemsize + 2 * seq_len
    shards = max(1, -(-(total or 0) * stride // (2 * seq_len) // shard_bytes))
    rows = sequences(docs, vocab, key, size, per_doc, low or 0, shards, seq_len, nulls)
    filesystem(path)[0].create_dir(filesystem(path)[1], recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = filesystem(path)
        out, now, n, name = None, None, 0, ""
        done: list[tuple[int, str, int]] = []
        for batch in batches:
            shard = batch.column("shard").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if shard[a] != now:
                    if out is not None:
                        out.close()
                        done.append((now, name, n))
                    now, n, name = int(shard[a]), 0, f"shard-{shard[a]:06d}-{uuid.uuid4().hex}.bin"
                    out = store.open_output_stream(f"{folder}/{name}")
                part = batch.slice(a, b - a)
                body = part.column("ids").to_pylist()
                head = np.zeros(b - a, HEAD)
                head["doc_id"], head["piece"] = part.column("doc_id").fill_null(0).to_numpy(), part.column("piece").to_numpy()
                head["no_id"] = part.column("doc_id").is_null().to_numpy(zero_copy_only=False)
                head["n"] = [len(x) // 2 for x in body]
                out.write(b"".join(h.tobytes() + x.ljust(2 * seq_len, b"\0") for h, x in zip(head, body)))
                n += b - a
        if out is not None:
            out.close()
            done.append((now, name, n))
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.int32(), pa.string(), pa.int64()))], ["shard", "file", "n_records"])

    each = -(-shards // TASKS)
    ordered = rows.repartitionById(-(-shards // each), F.floor(F.col("shard") / each).cast("int")).sortWithinPartitions("shard", "order", "doc_id", "piece", "ids")
    manifest = save(ordered.mapInArrow(write, "shard int, file string, n_records long"), "manifest")
    # One row per shard: a running total over it is small.
    first = F.coalesce(F.sum("n_records").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return manifest.withColumn("first_slot", first).withColumn("path", F.concat(F.lit(path + "/"), "file")).withColumn("stride", F.lit(stride))


def read_shards(manifest: DataFrame, from_slot: int = 0) -> DataFrame:
    """Records from a slot on: slot, shard, byte_offset, doc_id, piece, n_tokens, ids_crc32 (of the little-endian uint16 ids)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                store, name = filesystem(r["path"])
                skip = max(0, from_slot - r["first_slot"])
                with store.open_input_file(name) as f:
                    f.seek(skip * r["stride"])
                    while skip < r["n_records"]:
                        m = min(8192, r["n_records"] - skip)
                        raw = f.read(m * r["stride"])
                        if len(raw) != m * r["stride"]:
                            raise OSError(f"{name} ends early")
                        table = np.frombuffer(raw, np.uint8).reshape(m, r["stride"])
                        head = table[:, : HEAD.itemsize].copy().view(HEAD)[:, 0]
                        crc = [zlib.crc32(raw[o : o + 2 * int(k)]) for o, k in zip(range(HEAD.itemsize, len(raw), r["stride"]), head["n"])]
                        place = np.arange(skip, skip + m)
                        columns = [r["first_slot"] + place, np.full(m, r["shard"], np.int32), place * r["stride"], head["piece"], head["n"].astype(np.int64), np.array(crc, np.int64)]
                        arrays = [pa.array(np.ascontiguousarray(c)) for c in columns]
                        arrays.insert(3, pa.array(np.ascontiguousarray(head["doc_id"]), mask=head["no_id"] == 1))
                        yield pa.RecordBatch.from_arrays(arrays, ["slot", "shard", "byte_offset", "doc_id", "piece", "n_tokens", "ids_crc32"])
                        skip += m

    wanted = manifest.filter(F.col("first_slot") + F.col("n_records") > from_slot).select("shard", "path", "n_records", "first_slot", "stride")
    spread = wanted.repartition(F.col("shard"))
    return spread.mapInArrow(read, "slot long, shard int, byte_offset long, doc_id long, piece int, n_tokens long, ids_crc32 long")


def resume(spark: SparkSession, manifest: DataFrame, slot: int) -> DataFrame:
    """What a reader that stopped before `slot` has still to read, in order of slot."""
    return read_shards(manifest, slot).orderBy("slot")
