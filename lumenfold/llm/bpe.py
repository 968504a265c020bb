"""Byte-level BPE encoding and decoding.

`ByteBpe` gives the ids that the `tokenizers` library gives for the same vocabulary file.  A batch of texts is cut
into the pretokens of the GPT-2 pattern with NumPy, every distinct pretoken is merged once (a bounded cache keeps
frequent ones), and the ids are gathered.  The cache is keyed by a 64-bit fingerprint, so each text is compared with
the decoded ids and encoded again without the cache if it differs.

Long unsplit text is encoded by tree concatenation: `encode_tree` (one process) and `encode_documents` (Spark rows)
encode pieces on their own and `join_ids` re-encodes a growing window around each seam until both sides agree.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

EOT = "<|endoftext|>"
LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
SLOT_BITS = 20
CACHE_IDS = 8_000_000
CHUNK_CHARS = 1_500_000

_ENCODERS: dict[str, "ByteBpe"] = {}


def encoder(path: str) -> "ByteBpe":
    """The encoder of a vocabulary file, loaded once in each Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ByteBpe(path)
    return _ENCODERS[path]


def _byte_alphabet() -> dict[str, int]:
    """Character to byte, as byte-level vocabularies write their tokens."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in printable}
    rest = [b for b in range(256) if b not in set(printable)]
    return table | {chr(256 + i): b for i, b in enumerate(rest)}


def _classes() -> np.ndarray:
    import regex

    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            table[[ord(m[0][0]), ord(m[0][-1])]] = kind
            a, b = ord(m[0][0]), ord(m[0][-1])
            table[a : b + 1] = np.where((np.arange(a, b + 1) >= 0xD800) & (np.arange(a, b + 1) < 0xE000), OTHER, kind)
    return table


def pretoken_starts(cps: np.ndarray, fresh: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Sorted starts of the pretokens of code points `cps`; `fresh` marks the first code point of each text."""
    n = len(cps)
    kind = kinds[cps]
    change = np.empty(n, bool)
    change[0] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:])
    start = change | fresh
    space = kind == SPACE
    last = np.empty(n, bool)  # a white-space character that non-space follows in the same text
    last[-1] = False
    last[:-1] = space[:-1] & ~space[1:] & ~fresh[1:]
    start |= last
    joined = last & (cps == 32)  # this blank belongs to the next run
    nxt = np.flatnonzero(joined) + 1
    start[nxt] = False
    quote = np.flatnonzero((cps == 39) & start)
    if len(quote):
        pad = np.concatenate([cps, np.zeros(3, cps.dtype)])
        stop = np.concatenate([fresh, [True, True, True]])
        a, b = pad[quote + 1], pad[quote + 2]
        one = np.isin(a, [ord(c) for c in "stmd"]) & ~stop[quote + 1]
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        two &= ~stop[quote + 1] & ~stop[quote + 2]
        for q, size in ((quote[one], 2), (quote[two], 3)):
            start[q + 1] = False
            after = q + size
            inside = after[after < n]
            start[inside[kind[inside] == LETTER]] = True
    return np.flatnonzero(start)


class ByteBpe:
    """Encoder and decoder of one byte-level BPE vocabulary in the tokenizers library's JSON form."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = _byte_alphabet()
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(alphabet[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in special}
        self.vocab = max([*ranks.values(), *special.values()]) + 1
        self.special = special
        self.table = [b""] * self.vocab
        for word, i in [*ranks.items(), *((k.encode(), v) for k, v in special.items())]:
            self.table[i] = word
        self.sizes = np.array([len(x) for x in self.table], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.flat = np.frombuffer(b"".join(self.table), np.uint8)
        self.names = [str(i) for i in range(self.vocab)]
        # The merge engine sees one pretoken at a time, so its own split pattern only has to keep a pretoken whole.
        self._merge = tiktoken.Encoding("pretokens", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.kinds = _classes()
        rng = np.random.default_rng(20240501)
        self.mix = rng.integers(1, 2**63, 0x110000, dtype=np.uint64) | np.uint64(1)
        self.base, self.unbase = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
        self._powers = self._unpowers = np.ones(1, np.uint64)
        self._forget()

    def _forget(self) -> None:
        self.slot_key = np.zeros(1 << SLOT_BITS, np.uint64)
        self.slot_row = np.zeros(1 << SLOT_BITS, np.int32)
        self.first, self.size, self.store = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, np.uint16)

    def _learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        """Merge new pretokens and put them in the cache, over whatever holds their slots."""
        merge = self._merge
        new = [merge(p.encode()) if len(p) <= 4096 else encode_tree(self, p).tolist() for p in pieces]
        size = np.fromiter(map(len, new), np.int64, len(new))
        flat = np.fromiter(chain.from_iterable(new), np.uint16, int(size.sum()))
        rows = np.arange(len(self.first), len(self.first) + len(new), dtype=np.int32)
        self.first = np.concatenate([self.first, len(self.store) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.store = np.concatenate([self.store, flat])
        slots = keys >> np.uint64(64 - SLOT_BITS)
        self.slot_key[slots], self.slot_row[slots] = keys, rows

    def _grow(self, n: int) -> None:
        if len(self._powers) <= n:
            m = 1 << int(n + 1).bit_length()
            for name, step in (("_powers", self.base), ("_unpowers", self.unbase)):
                x = np.full(m, step, np.uint64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))

    def encode_plain(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts that hold no special token."""
        out: list[np.ndarray] = []
        some: list[str] = []
        held = 0
        for t in texts:
            some.append(t)
            held += len(t)
            if held >= CHUNK_CHARS:
                out += self._encode_chunk(some)
                some, held = [], 0
        return out + (self._encode_chunk(some) if some else [])

    def _encode_chunk(self, texts: list[str]) -> list[np.ndarray]:
        lengths = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(lengths)
        n = int(ends[-1])
        if not n:
            return [np.empty(0, np.uint16)] * len(texts)
        whole = "".join(texts)
        cps = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        fresh = np.zeros(n + 1, bool)
        fresh[ends - lengths] = True
        starts = pretoken_starts(cps, fresh[:n], self.kinds)
        stops = np.append(starts[1:], n)
        self._grow(n)
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(self.mix[cps] * self._powers[:n], out=prefix[1:])
        keys = (prefix[stops] - prefix[starts]) * self._unpowers[starts] + (stops - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        if len(self.store) > CACHE_IDS:
            self._forget()
        slots = keys >> np.uint64(64 - SLOT_BITS)
        rows = self.slot_row[slots]
        missed = np.flatnonzero(self.slot_key[slots] != keys)
        if len(missed):
            uniq, at, back = np.unique(keys[missed], return_index=True, return_inverse=True)
            rows[missed] = len(self.first) + back
            at = missed[at]
            self._learn(uniq, [whole[a:b] for a, b in zip(starts[at].tolist(), stops[at].tolist())])
        per = self.size[rows]
        total = np.cumsum(per)
        ids = self.store[np.repeat(self.first[rows] - (total - per), per) + np.arange(int(total[-1]))]
        upto = np.concatenate([[0], total])
        piece_ends = np.searchsorted(starts, ends, side="left")
        bounds = np.concatenate([[0], upto[piece_ends]])
        out = [ids[bounds[i] : bounds[i + 1]] for i in range(len(texts))]
        if self.decode_bytes(ids) != whole.encode():
            out = [x if self.decode_bytes(x) == t.encode() else self._slow(t) for x, t in zip(out, texts)]
        return out

    def _slow(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint16)
        cps = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        fresh = np.zeros(len(cps), bool)
        fresh[0] = True
        starts = [*pretoken_starts(cps, fresh, self.kinds).tolist(), len(cps)]
        return np.array([i for a, b in zip(starts, starts[1:]) for i in self._merge(text[a:b].encode())], np.uint16)

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text as uint16; special tokens in a text become their id, as the tokenizers library does."""
        odd = {i for i, t in enumerate(texts) if any(s in t for s in self.special)}
        if not odd:
            return self.encode_plain(texts)
        plain = iter(self.encode_plain([t for i, t in enumerate(texts) if i not in odd]))
        return [self._with_special(t) if i in odd else next(plain) for i, t in enumerate(texts)]

    def _with_special(self, text: str) -> np.ndarray:
        import regex

        parts = regex.split("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")", text)
        return np.concatenate([np.array([self.special[p]], np.uint16) if p in self.special else self.encode_plain([p])[0] for p in parts])

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        size = self.sizes[ids]
        end = np.cumsum(size)
        return self.flat[np.repeat(self.starts[ids] - (end - size), size) + np.arange(int(end[-1]))].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def ids_text(self, ids: np.ndarray) -> str:
        return ",".join(map(self.names.__getitem__, ids.tolist()))


def join_ids(bpe: ByteBpe, left: np.ndarray, right: np.ndarray, window: int = 64, agree: int = 2) -> np.ndarray:
    """Ids of the text of `left` followed by the text of `right`.

    A window of `window` bytes on either side of the seam is encoded again.  Its first and last `agree` tokens must be
    those that the sides have there; otherwise the window doubles, at worst to both whole texts.  A sequence of tokens
    is the encoding of a pretoken exactly if every two neighbours are, so agreement at both ends makes the result exact.
    """
    if not len(left) or not len(right):
        return np.concatenate([left, right])
    lb, rb = bpe.decode_bytes(left), bpe.decode_bytes(right)
    lend, rend = np.cumsum(bpe.sizes[left]), np.cumsum(bpe.sizes[right])
    lstart = np.concatenate([[0], lend])
    while True:
        i = int(np.searchsorted(lstart, len(lb) - window, side="right")) - 1 if window < len(lb) else 0
        j = int(np.searchsorted(rend, window)) + 1 if window < len(rb) else len(right)
        while i > 0 and (lb[lstart[i]] & 0xC0) == 0x80:
            i -= 1
        j = min(j, len(right))
        while j < len(right) and (rb[rend[j - 1]] & 0xC0) == 0x80:
            j += 1
        text = (lb[lstart[i] :] + rb[: rend[j - 1]]).decode("utf-8", "replace")
        mid = bpe.encode_batch([text])[0] if len(text) <= 4096 or (i == 0 and j == len(right)) and _flat(text) else _leaf(bpe, text)
        head = i == 0 or (len(mid) >= agree and np.array_equal(mid[:agree], left[i : i + agree]) and len(left) - i > agree)
        tail = j == len(right) or (len(mid) >= agree and np.array_equal(mid[-agree:], right[j - agree : j]) and j > agree)
        if head and tail:
            return np.concatenate([left[:i], mid, right[j:]])
        window *= 2


def _flat(text: str) -> bool:
    return len(text) <= 4096


def _leaf(bpe: ByteBpe, text: str) -> np.ndarray:
    """Encode without tree concatenation."""
    import regex

    parts = regex.split("(" + "|".join(map(regex.escape, bpe.special)) + ")", text) if bpe.special else [text]
    return np.concatenate([np.array([bpe.special[p]], np.uint16) if p in bpe.special else bpe._slow(p) for p in parts])


def encode_tree(bpe: ByteBpe, text: str, leaf: int = 4096) -> np.ndarray:
    """Encode halves on their own, down to `leaf` characters, and join them pairwise."""
    if len(text) <= leaf:
        return _leaf(bpe, text)
    half = len(text) // 2
    return join_ids(bpe, encode_tree(bpe, text[:half], leaf), encode_tree(bpe, text[half:], leaf))


def join_all(bpe: ByteBpe, parts: list[np.ndarray]) -> np.ndarray:
    """Join neighbours until one sequence is left, as a balanced tree."""
    while len(parts) > 1:
        parts = [join_ids(bpe, *parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0] if parts else np.empty(0, np.uint16)


def encode_documents(docs: DataFrame, vocab: str, finish, schema: str, long_chars: int = 16_384) -> DataFrame:
    """Rows (doc_id, text) to rows of `schema`.

    `finish(bpe, doc_ids, ids, sizes)` gets lists for a batch of documents and returns an Arrow record batch.  A text of
    over `long_chars` characters is cut into pieces of that length, which Spark deals out and encodes in parallel; each
    such row's pieces then meet in one group and are joined as a tree.  A row's key is its doc_id and the hash of its
    text; rows equal in both are encoded once and repeated at the end.  A null text counts as empty.
    """
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocab)
        for batch in batches:
            for part in text_slices(batch):
                texts = part.column("text").to_pylist()
                yield finish(bpe, part.column("doc_id"), bpe.encode_batch(texts), texts)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocab)
        for batch in batches:
            ids = bpe.encode_batch(batch.column("text").to_pylist())
            same = [batch.column(c) for c in ("doc_id", "key", "n", "copies")]
            yield pa.RecordBatch.from_arrays([*same, pa.array([x.astype("<u2").tobytes() for x in ids], pa.binary())], ["doc_id", "key", "n", "copies", "ids"])

    def together(group: pa.Table) -> pa.Table:
        bpe = encoder(vocab)
        group = group.sort_by("n")
        ids = join_all(bpe, [np.frombuffer(x, "<u2") for x in group.column("ids").to_pylist()])
        out = pa.Table.from_batches([finish(bpe, group.column("doc_id").slice(0, 1).combine_chunks(), [ids], [bpe.decode(ids)])])
        return out.append_column("_copies", pa.array([group.column("copies")[0].as_py()] * len(out), pa.int64()))

    size = F.length("text")
    out = rows.filter(size <= long_chars).mapInArrow(short, schema)
    cut = rows.filter(size > long_chars).select(
        "doc_id", F.sha2("text", 256).alias("key"), F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((size - 1) / long_chars).cast("int")), lambda i: F.substring("text", i * long_chars + 1, F.lit(long_chars)))).alias("n", "text")
    )
    dealt = cut.groupBy("doc_id", "key", "n").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    encoded = dealt.mapInArrow(pieces, "doc_id long, key string, n int, copies long, ids binary")
    joined = encoded.groupBy("doc_id", "key").applyInArrow(together, f"{schema}, _copies long")
    return out.unionByName(joined.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_copies"))).drop("_copies", "_copy"))


def text_slices(batch: pa.RecordBatch, name: str = "text", most: int = 6_000_000) -> Iterator[pa.RecordBatch]:
    """Zero-copy slices of a batch whose texts hold about `most` bytes at most, one row at least."""
    size = np.diff(np.frombuffer(batch.column(name).buffers()[1], np.int32, len(batch) + 1 + batch.column(name).offset)[batch.column(name).offset :]) if batch.column(name).type in (pa.string(), pa.binary()) else None
    if size is None:
        size = np.array([len(x or "") for x in batch.column(name).to_pylist()])
    group = (np.cumsum(size) - size) // most
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(batch)]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def bpe_roundtrip(docs: DataFrame, vocab: str, long_chars: int = 16_384) -> DataFrame:
    """Encode every text and decode it again.

    Returns doc_id, n_tokens, ids_sha256 (decimal ids joined by commas) and decoded_sha256 (decoded text in UTF-8).
    Null and empty texts have no tokens.  Every row gives one row, however long, also where doc_ids repeat or are null.
    Further columns are ignored.
    """

    def finish(bpe: ByteBpe, doc_ids: pa.Array, ids: list[np.ndarray], texts: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                doc_ids,
                pa.array([len(x) for x in ids], pa.int64()),
                pa.array([sha256_hex(bpe.ids_text(x).encode()) for x in ids], pa.string()),
                pa.array([sha256_hex(bpe.decode(x).encode("utf-8")) for x in ids], pa.string()),
            ],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    return encode_documents(docs, vocab, finish, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", long_chars)


def ids_of_bytes(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u2")


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def ranks_file(path: str) -> dict[bytes, int]:
    """A vocabulary in the tiktoken form, for tests."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
