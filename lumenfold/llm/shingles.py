"""Sets of word shingles as 64-bit hashes, computed for many texts at once."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 9, 10, 11, 12, 13]] = True
_MIX = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64)
_TABLES: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_TABLES.get("up", ())) <= n:
        m = 1 << int(n + 1).bit_length()
        for name, step in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            x = np.full(m, step, np.uint64)
            x[0] = 1
            _TABLES[name] = np.multiply.accumulate(x)
    return _TABLES["up"], _TABLES["down"]


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z lower-cased, and the number of words of each text.  Words end at 0x20 and 0x09-0x0D."""
    joined = b" ".join(texts)
    buf = np.frombuffer(joined, np.uint8)
    if not len(buf):
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    blank = _BLANK[buf]
    edge = np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8))
    start, stop = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _powers(len(buf))
    prefix = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_MIX[_LOWER[buf]] * up[: len(buf)], out=prefix[1:])
    words = scramble((prefix[stop] - prefix[start]) * down[start] + (stop - start).astype(np.uint64))
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    upto = np.searchsorted(start, ends)
    return words, np.diff(np.concatenate([[0], upto]))


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text with fewer words has one shingle, without words none."""
    words, counts = word_hashes(texts)
    out, at = [], 0
    scale = [np.uint64(pow(0xD1342543DE82EF95, i + 1, 2**64)) for i in range(size)]
    for n in counts.tolist():
        w = words[at : at + n]
        at += n
        if n >= size:
            m = n - size + 1
            h = w[:m] * scale[0]
            for i in range(1, size):
                h += w[i : i + m] * scale[i]
            out.append(np.unique(scramble(h)))
        elif n:
            h = np.array([n], np.uint64)
            for i in range(n):
                h = scramble(h * scale[0] + w[i : i + 1])
            out.append(h)
        else:
            out.append(np.empty(0, np.uint64))
    return out


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))
