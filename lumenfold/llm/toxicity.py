"""Toxicity by a weighted lexicon.

Texts are folded (compatibility forms, look-alike letters, digits that stand for letters), cut into words and searched
for all lexicon entries at once by an Aho-Corasick automaton.  An entry is a word or the start of words, with a weight;
hits inside an exception phrase do not count.  The summed weights are normalised by the number of words, and a small
logistic model turns them into a score from 0 to 1.  Lexicon, exceptions and model are learned from labelled rows.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import text_slices
from .common import save, small_batches

THRESHOLD = 0.5
SAMPLE_ROWS = 12_000  # bound on the labelled rows that are learned from
LEXICON_ROWS = 3_000
EXCEPTION_ROWS = 500
PREFIXES = (4, 5, 6, 7, 8, 10)

# Letters of other scripts that look like Latin ones.
LOOK_ALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "ɡ": "g", "ո": "n", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o",
    "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ⅼ": "l",
}
# Digits and signs written for letters.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}

_TABLE = str.maketrans(LOOK_ALIKES | {c: None for c in "​‌‍­⁠﻿"})
_SIGN = re.compile(r"(?<=[^\W\d_])[@$!0134578]+(?=[^\W\d_])|(?<![^\s])[0134578@$!](?=[^\W\d_]{2})|(?<=[^\W\d_]{2})[0134578]\b")
_SWAP = str.maketrans(SUBSTITUTES)
_WORD = re.compile(r"[^\W_]+")
_RISKY = re.compile(r"[0134578@$!]")


def fold(text: str) -> str:
    """Lower case in one spelling: look-alike letters and digits inside words become the letters they stand for."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = text.lower()
    if not text.isascii():
        text = text.translate(_TABLE)
    return _SIGN.sub(lambda m: m[0].translate(_SWAP), text) if _RISKY.search(text) else text


def words(text: str) -> list[str]:
    return _WORD.findall(fold(text))


@dataclass
class Model:
    """Entries are " start" or " word " with weights, exceptions " word word "; `beta` belongs to `signals`."""

    lexicon: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    beta: list[float] = field(default_factory=lambda: [-4.0, 4.0, 1.0, 1.0, 0.0])


def automaton(model: Model):
    import ahocorasick

    a = ahocorasick.Automaton()
    for entry, weight in model.lexicon.items():
        a.add_word(entry, (entry, weight))
    for phrase in model.exceptions:
        a.add_word(phrase, (phrase, None))
    a.make_automaton()
    return a


def hits(found: list[str], machine) -> dict[int, tuple[float, int]]:
    """The best entry of each word it starts in, by place: weight and place in the joined words."""
    if not found or not len(machine):
        return {}
    joined = " " + " ".join(found) + " "
    best: dict[int, tuple[float, int]] = {}
    spared: list[tuple[int, int]] = []
    for end, (entry, weight) in machine.iter(joined):
        at = end - len(entry) + 1
        if weight is None:
            spared.append((at, end))
        elif at not in best or weight > best[at][0]:
            best[at] = (weight, at)
    if spared:
        # Exceptions that overlap become one range, so each hit is looked up once.
        starts, stops = [], []
        for a, b in sorted(spared):
            if stops and a <= stops[-1]:
                stops[-1] = max(stops[-1], b)
            else:
                starts.append(a)
                stops.append(b)
        inside = lambda k: (i := bisect_right(starts, k) - 1) >= 0 and k < stops[i]
        best = {k: v for k, v in best.items() if not inside(k)}
    return best


def signals(weights: list[float], n_words: int) -> list[float]:
    """What the score is made of: a constant, the weights' sum by length, by number, the largest, and the length."""
    total = sum(weights)
    return [1.0, total / (n_words + 20) ** 0.5, np.log1p(total), max(weights, default=0.0), np.log1p(n_words) / 10]


def _sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """Labelled rows outside the held-out fifth; above `rows` of them, those whose hash of the id is small."""
    train = labels.filter(F.col("toxic").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)).select("doc_id", "toxic")
    n = train.count()
    share = min(1.0, rows / max(n, 1))
    train = train.filter(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_000)) < share * 1_000_000)
    return save(docs.select("doc_id", "text").join(train, "doc_id"), "labelled")


def _counted(rows: DataFrame, emit) -> DataFrame:
    """Documents of either class that hold a feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yes: Counter[str] = Counter()
        no: Counter[str] = Counter()
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                (yes if toxic else no).update(emit(words(text or "")))
        names = list(yes.keys() | no.keys())
        for a in range(0, len(names), 10_000):
            some = names[a : a + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array([yes[x] for x in some], pa.int64()), pa.array([no[x] for x in some], pa.int64())], ["feature", "yes", "no"])

    return rows.select("text", "toxic").mapInArrow(run, "feature string, yes long, no long").groupBy("feature").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))


def _entries(found: list[str]) -> set[str]:
    out: set[str] = set()
    for w in set(found):
        out.add(f" {w[:40]} " if len(w) <= 40 else f" {w[:40]}")
        out.update(f" {w[:n]}" for n in PREFIXES if len(w) >= n)
    return out


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, exceptions: tuple[str, ...] = ()) -> Model:
    """Learn lexicon, exception phrases and weights from `labels` (doc_id, toxic); lang, source and doc_id are no inputs.

    At most about `rows` labelled rows are read; the lexicon has at most LEXICON_ROWS entries.  Without a toxic and a
    clean row the lexicon is empty and every score is that of a text without hits.
    """
    small_batches(docs.sparkSession)
    sample = _sample(docs, labels, rows)
    total = {r[0]: r[1] for r in sample.groupBy(F.coalesce(F.col("toxic") == 1, F.lit(False))).count().collect()}
    n_yes, n_no = total.get(True, 0), total.get(False, 0)
    if not n_yes or not n_no:
        return Model({}, list(exceptions))
    weight = F.log((F.col("yes") + 0.5) / (n_yes + 1)) - F.log((F.col("no") + 0.5) / (n_no + 1))
    counted = _counted(sample, _entries).filter("yes >= 3").withColumn("weight", weight).filter("weight > 1.5")
    table = counted.orderBy(F.desc(F.col("weight") * F.log1p("yes")), "feature").limit(2 * LEXICON_ROWS).collect()
    strength, support = {r["feature"]: r["weight"] for r in table}, {r["feature"]: r["yes"] for r in table}
    # A shorter entry that a longer one stands for almost wherever it stands goes: a word rather than its start.
    for entry in sorted(strength, key=len):
        for n in range(2, len(entry)):
            start = entry[:n]
            if start in strength and support[entry] >= 0.9 * support[start]:
                del strength[start]
    # A longer entry that says no more than a shorter one inside it goes.
    lexicon: dict[str, float] = {}
    for entry in sorted(strength, key=lambda e: (len(e), e)):
        if not any(strength[entry] <= lexicon[entry[:n]] + 1.0 for n in range(2, len(entry)) if entry[:n] in lexicon):
            lexicon[entry] = strength[entry]
    lexicon = dict(sorted(lexicon.items(), key=lambda x: -x[1])[:LEXICON_ROWS])
    model = Model(lexicon, [f" {e} " for e in exceptions])
    machine = automaton(model)

    def phrases(found: list[str]) -> set[str]:
        joined = " " + " ".join(found) + " "
        out = set()
        for _, at in hits(found, machine).values():
            rest = joined[at:].split(" ", 3)
            out.add(f" {rest[1]} {rest[2]} ") if len(rest) > 3 else None
        return out

    spare = _counted(sample, phrases).filter("no >= 3 and yes = 0").orderBy(F.desc("no"), "feature").limit(EXCEPTION_ROWS).collect()
    model.exceptions += [r["feature"] for r in spare]
    machine = automaton(model)

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [signals([v[0] for v in hits(w, machine).values()], len(w)) for w in map(words, (t or "" for t in batch.column("text").to_pylist()))]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.float64())), batch.column("toxic").cast(pa.int32())], ["x", "y"])

    data = sample.select("text", "toxic").mapInArrow(described, "x array<double>, y int").toPandas()  # five numbers for each sampled row
    model.beta = logistic(np.array(data["x"].tolist()), (data["y"].to_numpy() == 1).astype(float)).tolist()
    return model


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Newton's method with a ridge that leaves the constant free."""
    beta = np.zeros(x.shape[1])
    penalty = np.eye(x.shape[1]) * ridge
    penalty[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Add score, from 0 to 1, to every row, in place of a column of that name; the other columns stay.

    Null and empty texts get the score of a text without words.  Rows are scored one by one, so repeated rows agree.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by LEXICON_ROWS and EXCEPTION_ROWS
    names = [c for c in docs.columns if c.lower() != "score"]
    docs = docs.select(*[F.col(f"`{c}`") for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        machine, beta = automaton(model), np.array(model.beta)
        for batch in batches:
            for part in text_slices(batch):
                rows = []
                for text in part.column("text").to_pylist():
                    w = words(text or "")
                    rows.append(signals([v[0] for v in hits(w, machine).values()], len(w)))
                s = 1 / (1 + np.exp(-np.clip(np.array(rows).reshape(-1, len(beta)) @ beta, -30, 30)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(s)], [*names, "score"])

    return docs.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in docs.dtypes) + ", score double")


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out (crc32 of the id as text is divisible by 5), score and predicted for every document."""
    out = score(docs.select("doc_id", "text"), fit(docs, labels))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
