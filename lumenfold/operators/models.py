"""Mixture models, hidden Markov models, clustering, projection, stationarity: each step a Spark aggregation.

A mixture is a table (model, comp, weight, mean, var).  Its components are few and bounded by the model, not by the data,
so they go to the driver once a round and come back as one constant.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arrays as V
from ..functions.arrays import bhattacharyya, log_gauss, log_sum_exp
from ..session import cut
from .relational import numbered, small_side

LOG_ZERO = -1e10
GMM_SCHEMA = "model string, comp int, weight double, mean array<double>, var array<double>"
_COMPONENT = "struct<weight: double, mean: array<double>, var: array<double>>"


def constant(value, kind: str) -> Column:
    """Nested numbers as one literal, which Catalyst folds."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def gmm_table(spark: SparkSession, model: str, weights: Sequence[float], means, variances) -> DataFrame:
    rows = [(model, i, float(w), [float(a) for a in m], [float(a) for a in v]) for i, (w, m, v) in enumerate(zip(weights, means, variances))]
    return spark.createDataFrame(rows, GMM_SCHEMA)


def _mixture(rows: Sequence[Row]) -> Column:
    return constant([{"weight": r["weight"], "mean": list(r["mean"]), "var": list(r["var"])} for r in rows], f"array<{_COMPONENT}>")


def _components(model: DataFrame) -> list[Row]:
    return model.orderBy("comp").collect()


def _densities(x: Column, mixture: Column) -> Column:
    """Weighted log density of each component."""
    return F.transform(mixture, lambda c: log_gauss(x, c["mean"], c["var"], c["weight"]))


def _likelihood(logs: Column) -> Column:
    return F.greatest(log_sum_exp(logs), F.lit(LOG_ZERO))


def _shares(frames: DataFrame, x: str, rows: Sequence[Row]) -> DataFrame:
    """Add `ll` and one row for each component with its responsibility: comp, r."""
    scored = frames.withColumn("_logs", _densities(F.col(x), _mixture(rows))).withColumn("ll", _likelihood(F.col("_logs")))
    return scored.select("*", F.posexplode(F.transform("_logs", lambda v: F.exp(v - F.col("ll")))).alias("comp", "r")).drop("_logs")


def _sums(shares: DataFrame, x: str, dims: int, by: Sequence[str] = ("comp",), squares: bool = False) -> DataFrame:
    """Responsibilities and weighted sums of a component; combined before the shuffle."""
    r, v = F.col("r"), F.col(x)
    sums = [F.sum("r").alias("n"), F.sum("ll").alias("ll"), F.count("*").alias("rows"), F.array(*[F.sum(r * v[i]) for i in range(dims)]).alias("s")]
    if squares:
        sums.append(F.array(*[F.sum(r * v[i] * v[i]) for i in range(dims)]).alias("q"))
    return shares.groupBy(*by).agg(*sums)


def gmm_scores(frames: DataFrame, model: DataFrame, x: str = "features") -> DataFrame:
    """Add the log-likelihood of a mixture: column llr."""
    return frames.withColumn("_logs", _densities(F.col(x), _mixture(model.collect()))).withColumn("llr", _likelihood(F.col("_logs"))).drop("_logs")


def gmm_fit(frames: DataFrame, x: str, k: int, model: str = "gmm", seed: int = 0, rounds: int = 100, tol: float = 1e-4, floor: float = 1e-3) -> DataFrame:
    """Expectation maximisation from k-means centroids, one aggregation a round; components that vanish are dropped."""
    spark = frames.sparkSession
    data = frames.select(F.col(x).cast("array<double>").alias("x")).filter("x is not null").persist()
    dims = len(data.first()["x"])
    spread, mean = data.agg(*[F.array(*[f(F.col("x")[i]) for i in range(dims)]) for f in (F.var_pop, F.avg)]).first()
    centres = kmeans(data, "x", k, seed)[1] if k > 1 else [mean]
    rows = [Row(comp=i, weight=1 / len(centres), mean=c, var=[max(v, floor) for v in spread]) for i, c in enumerate(centres)]
    last = -math.inf
    for _ in range(rounds):
        found = [r for r in _sums(_shares(data, "x", rows), "x", dims, squares=True).orderBy("comp").collect()]
        level = found[0]["ll"] / found[0]["rows"]
        alive = [r for r in found if r["n"] > 1e-6]
        total = sum(r["n"] for r in alive)
        means = [[s / r["n"] for s in r["s"]] for r in alive]
        rows = [Row(comp=i, weight=r["n"] / total, mean=m, var=[max(q / r["n"] - a * a, floor) for q, a in zip(r["q"], m)]) for i, (r, m) in enumerate(zip(alive, means))]
        if abs(level - last) < tol:
            break
        last = level
    data.unpersist()
    return gmm_table(spark, model, [r["weight"] for r in rows], [r["mean"] for r in rows], [r["var"] for r in rows])


def bic(frames: DataFrame, model: DataFrame, x: str = "features") -> float:
    """-2 log-likelihood plus the parameters' number times ln(rows)."""
    k, d = model.agg(F.count("*"), F.max(F.size("mean"))).first()
    ll, n = gmm_scores(frames, model, x).agg(F.sum("llr"), F.count("*")).first()
    return -2 * ll + (2 * k * d + k - 1) * math.log(n)


def select_by_bic(frames: DataFrame, x: str, most: int = 15, seed: int = 0, rounds: int = 100) -> DataFrame:
    """k and its criterion for 1..most components."""
    data = frames.withColumn("_x", F.col(x).cast("array<double>"))
    found = [(k, bic(data, gmm_fit(data, "_x", k, seed=seed, rounds=rounds), "_x")) for k in range(1, most + 1)]
    return frames.sparkSession.createDataFrame(found, "k int, bic double")


def adapt(frames: DataFrame, model: DataFrame, x: str = "features", relevance: float = 16.0, rounds: int = 5) -> DataFrame:
    """Maximum a posteriori means, one aggregation a round; weights and variances stay."""
    rows = _components(model)
    for _ in range(rounds):
        found = {r["comp"]: r for r in _sums(_shares(frames, x, rows), x, len(rows[0]["mean"])).collect()}
        rows = [_adapted(r, found.get(i), relevance) for i, r in enumerate(rows)]
    return gmm_table(frames.sparkSession, rows[0]["model"], [r["weight"] for r in rows], [r["mean"] for r in rows], [r["var"] for r in rows])


def _adapted(r: Row, sums, relevance: float) -> Row:
    mean = r["mean"] if sums is None else [(s + relevance * m) / (sums["n"] + relevance) for s, m in zip(sums["s"], r["mean"])]
    return Row(**(r.asDict() | {"mean": mean}))


def mix(a: DataFrame, b: DataFrame, model: str) -> DataFrame:
    """Both mixtures with halved weights as one."""
    first = a.agg(F.coalesce(F.max("comp") + 1, F.lit(0)).alias("_first"))
    both = a.unionByName(b.join(F.broadcast(first)).withColumn("comp", F.col("comp") + F.col("_first")).drop("_first"))
    return both.withColumns({"weight": F.col("weight") / 2, "model": F.lit(model)})


def select_components(model: DataFrame, comps: Sequence[int], invert: bool = False) -> DataFrame:
    """Chosen components, or all others, with weights that add up to 1."""
    kept = F.col("comp").isin([int(c) for c in comps])
    return model.filter(~kept if invert else kept).withColumn("weight", F.col("weight") / F.sum("weight").over(Window.partitionBy("model")))


def label_gaussians(df: DataFrame, label: str, x: str) -> DataFrame:
    """One Gaussian a label: weight, mean and population variance; two shuffles of small rows."""
    cells = df.select(label, F.posexplode(F.col(x).cast("array<double>")).alias("i", "v"))
    stats = cells.groupBy(label, "i").agg(F.avg("v").alias("m"), F.var_pop("v").alias("s"), F.count("*").alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "m", "s")))
    out = stats.groupBy(label).agg(ordered.alias("c"), F.max("n").alias("n"))
    total = df.agg(F.count("*").alias("_all"))
    return out.join(F.broadcast(total)).select(label, (F.col("n") / F.col("_all")).alias("weight"), F.transform("c", lambda c: c["m"]).alias("mean"), F.transform("c", lambda c: c["s"]).alias("var"))


def sequential_clusters(df: DataFrame, by: str, order: str, threshold: float) -> DataFrame:
    """Label runs of frames whose best components (mean, var) stay within a Bhattacharyya distance; a run of one frame is -1."""
    w = Window.partitionBy(by).orderBy(order)
    far = bhattacharyya(F.lag("mean").over(w), F.lag("var").over(w), F.col("mean"), F.col("var")) >= threshold
    runs = df.withColumn("_new", F.coalesce(far.cast("int"), F.lit(0))).withColumn("_run", F.sum("_new").over(w))
    size = F.count("*").over(Window.partitionBy(by, "_run"))
    sized = runs.withColumn("_n", size)
    # Runs of one frame take no number.
    return sized.withColumn("label", F.when(F.col("_n") == 1, F.lit(-1)).otherwise(F.dense_rank().over(Window.partitionBy(by, F.col("_n") == 1).orderBy("_run")) - 1)).drop("_new", "_run", "_n")


HMM_SCHEMA = "model string, state int, transitions array<double>, comp int, weight double, mean array<double>, var array<double>"


def left_right(n: int, stay: float = 0.6) -> list[list[float]]:
    """Transitions that stay or go to the next state; the last state stays."""
    return [[(1.0 if i == n - 1 else stay) if j == i else 1 - stay if j == i + 1 else 0.0 for j in range(n)] for i in range(n)]


def hmm_table(spark: SparkSession, model: str, transitions, states: Sequence[Sequence[Row]]) -> DataFrame:
    """A hidden Markov model as a table: one row for each component of each state."""
    rows = [(model, s, [float(t) for t in transitions[s]], i, r["weight"], list(r["mean"]), list(r["var"])) for s, part in enumerate(states) for i, r in enumerate(part)]
    return spark.createDataFrame(rows, HMM_SCHEMA)


def _hmm(model: DataFrame) -> tuple[list[list[float]], list[list[Row]]]:
    rows = model.orderBy("state", "comp").collect()
    n = max(r["state"] for r in rows) + 1
    states = [[r for r in rows if r["state"] == s] for s in range(n)]
    return [list(s[0]["transitions"]) for s in states], states


def _logs(transitions) -> list[list[float]]:
    return [[math.log(v) if v > 0 else LOG_ZERO for v in row] for row in transitions]


def _sum_of(a: Column, b: Column) -> Column:
    return log_sum_exp(F.zip_with(a, b, lambda p, q: p + q))


def _tables(utterances: DataFrame, frames: str, transitions, states) -> DataFrame:
    """Add emissions `b`, forward table `f`, backward table `g` (frames x states, logarithms) and log-probability `p`.

    The first frame is in state 0.  Both tables are folds over the frames of one utterance.
    """
    matrix = "array<array<double>>"
    to = constant([list(c) for c in zip(*_logs(transitions))], matrix)  # a row for each target
    out = constant(_logs(transitions), matrix)
    mixtures = constant([[{"weight": r["weight"], "mean": list(r["mean"]), "var": list(r["var"])} for r in s] for s in states], f"array<array<{_COMPONENT}>>")
    b = F.transform(frames, lambda x: F.transform(mixtures, lambda m: _likelihood(_densities(x, m))))
    n = F.size("b")
    first = F.transform(F.element_at("b", 1), lambda v, i: F.when(i == 0, v).otherwise(F.lit(LOG_ZERO)))
    ahead = lambda acc, row: F.array_append(acc, F.zip_with(row, to, lambda v, a: v + _sum_of(F.element_at(acc, -1), a)))
    f = F.aggregate(F.slice("b", 2, n), F.array(first), ahead)
    zeros = F.transform(F.element_at("b", 1), lambda v: F.lit(0.0))
    behind = lambda acc, row: F.array_append(acc, F.transform(out, lambda a: log_sum_exp(F.zip_with(a, F.zip_with(row, F.element_at(acc, -1), lambda u, v: u + v), lambda u, v: u + v))))
    g = F.reverse(F.aggregate(F.reverse(F.slice("b", 2, n)), F.array(zeros), behind))
    whole = utterances.filter(F.size(frames) > 0).withColumn("b", b).withColumns({"f": f, "g": g})
    return whole.withColumn("p", log_sum_exp(F.element_at("f", -1)))


def hmm_scores(utterances: DataFrame, model: DataFrame, frames: str = "frames") -> DataFrame:
    """Add the forward log-probability `p`; rows without frames are left out."""
    return _tables(utterances, frames, *_hmm(model)).drop("b", "f", "g")


def hmm_learn(utterances: DataFrame, model: DataFrame, frames: str = "frames", rounds: int = 10, tol: float = 1e-3, tau: float = 20.0) -> DataFrame:
    """Baum-Welch transitions over all utterances, then adapted means; each round is one aggregation of states x states sums."""
    transitions, states = _hmm(model)
    n, last = len(states), -math.inf
    a = lambda t: constant(_logs(t), "array<array<double>>")
    for _ in range(rounds):
        t = _tables(utterances, frames, transitions, states)
        level = t.agg(F.sum("p")).first()[0]
        steps = t.select("p", F.explode(F.arrays_zip(F.slice("f", 1, F.size("f") - 1).alias("f"), F.slice("b", 2, F.size("b")).alias("b"), F.slice("g", 2, F.size("g")).alias("g"))).alias("s"))
        rows = steps.select("p", F.zip_with("s.b", "s.g", lambda u, v: u + v).alias("next"), F.posexplode("s.f").alias("state", "f"))
        mass = F.zip_with(F.element_at(a(transitions), F.col("state") + 1), "next", lambda u, v: F.exp(u + v + F.col("f") - F.col("p")))
        sums = rows.withColumn("m", mass).groupBy("state").agg(F.array(*[F.sum(F.col("m")[j]) for j in range(n)]).alias("m")).collect()
        for r in sums:
            kept = [v if j >= r["state"] else 0.0 for j, v in enumerate(r["m"])]
            if sum(kept) > 0:
                transitions[r["state"]] = [v / sum(kept) for v in kept]
        if abs(level - last) < tol:
            break
        last = level
    t = _tables(utterances, frames, transitions, states)
    steps = t.select("p", F.explode(F.arrays_zip(F.col(frames).alias("x"), F.col("f").alias("f"), F.col("g").alias("g"))).alias("s"))
    occupied = steps.select(F.col("s.x").alias("x"), F.posexplode(F.zip_with("s.f", "s.g", lambda u, v: F.exp(u + v - F.col("p")))).alias("state", "occ")).filter("occ > 0")
    mixtures = constant([[{"weight": r["weight"], "mean": list(r["mean"]), "var": list(r["var"])} for r in s] for s in states], f"array<array<{_COMPONENT}>>")
    logs = occupied.withColumn("l", _densities(F.col("x"), F.element_at(mixtures, F.col("state") + 1))).withColumn("ll", _likelihood(F.col("l")))
    shares = logs.select("state", "x", "ll", F.posexplode(F.transform("l", lambda v: F.exp(v - F.col("ll")) * F.col("occ"))).alias("comp", "r"))
    found = {(r["state"], r["comp"]): r for r in _sums(shares, "x", len(states[0][0]["mean"]), ("state", "comp")).collect()}
    moved = [[_adapted(r, found.get((s, i)), tau) for i, r in enumerate(part)] for s, part in enumerate(states)]
    return hmm_table(utterances.sparkSession, states[0][0]["model"], transitions, moved)


def keyword_hmm(frames: DataFrame, garbage: DataFrame, by: str, order: str, x: str = "features", threshold: float = 4.5, top: int = 16) -> DataFrame:
    """Model of one keyword's utterance (ordered frames of one `by`): runs of near best background components are its states.

    A state's mixture has the components that come most often among the `top` best of its frames; then transitions and
    means are learned.
    """
    rows = _components(garbage)
    logs = frames.select(by, order, x, _densities(F.col(x), _mixture(rows)).alias("l"))
    best = logs.select(by, order, x, V.top_indices(F.col("l"), top).alias("best"))
    parts = garbage.select(F.col("comp").alias("_c"), "mean", "var")
    placed = best.withColumn("_c", F.col("best")[0]).join(F.broadcast(parts), "_c")
    w = Window.partitionBy(by).orderBy(order)
    far = bhattacharyya(F.lag("mean").over(w), F.lag("var").over(w), F.col("mean"), F.col("var")) >= threshold
    runs = placed.withColumn("_new", F.coalesce(far.cast("int"), F.lit(0))).withColumn("state", F.sum("_new").over(w).cast("int"))
    counts = runs.select("state", F.explode("best").alias("comp")).groupBy("state", "comp").count()
    rank = F.row_number().over(Window.partitionBy("state").orderBy(F.desc("count"), "comp"))
    chosen = counts.withColumn("_r", rank).filter(F.col("_r") <= top).orderBy("state", "_r").collect()
    n = max(r["state"] for r in chosen) + 1
    states = [[rows[r["comp"]] for r in chosen if r["state"] == s] for s in range(n)]
    totals = [sum(r["weight"] for r in s) for s in states]
    states = [[Row(**(r.asDict() | {"weight": r["weight"] / t})) for r in s] for s, t in zip(states, totals)]
    spoken = frames.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(x).alias("x")))), lambda s: s["x"]).alias("frames"))
    return hmm_learn(spoken, hmm_table(frames.sparkSession, rows[0]["model"], left_right(n), states))


def codebooks(df: DataFrame, label: str, x: str, k: int, seed: int = 1) -> dict[str, list[list[float]]]:
    """Centroids of each label; labels are a bounded list of classes."""
    return {r[0]: kmeans(df.filter(F.col(label) == r[0]), x, k, seed)[1] for r in df.select(label).distinct().orderBy(label).collect()}


def nearest_codebook(df: DataFrame, utterance: str, x: str, books: dict[str, list[list[float]]]) -> DataFrame:
    """Label of the codebook with the least mean distance to an utterance's frames; ties to the smaller label."""
    table = constant([{"label": str(name), "rows": rows} for name, rows in sorted(books.items(), key=lambda b: str(b[0]))], "array<struct<label: string, rows: array<array<double>>>>")
    each = F.transform(table, lambda b: F.struct(b["label"].alias("label"), F.array_min(F.transform(b["rows"], lambda c: V.euclidean(F.col(x), c))).alias("d")))
    means = df.select(utterance, F.explode(each).alias("e")).groupBy(utterance, "e.label").agg(F.avg("e.d").alias("distance"))
    return means.groupBy(utterance).agg(F.min_by("label", F.struct("distance", "label")).alias("label"), F.min("distance").alias("distance"))


def kernel(a: Column, b: Column, kind: str = "rbf", gamma: float = 1.0, degree: int = 3) -> Column:
    if kind == "linear":
        return V.dot(a, b)
    return F.pow(gamma * V.dot(a, b) + 1, F.lit(degree)) if kind == "poly" else F.exp(-gamma * V.l2_squared(a, b))


def kernel_kmeans(df: DataFrame, x: str, k: int, key: str, kind: str = "rbf", gamma: float = 1.0, degree: int = 3, landmarks: int = 64, seed: int = 1) -> DataFrame:
    """Add `cluster`: k-means in the kernel's feature space, spanned by at most `landmarks` rows, the least by hash of `key`.

    With as many landmarks as rows this is kernel k-means over all rows; otherwise all rows are clustered by their kernel
    values with the landmarks, so no pairs of rows are made.
    """
    rows = df.orderBy(F.xxhash64(key), key).limit(landmarks).select(F.col(x).cast("array<double>").alias("x")).collect()
    marks = constant([list(r["x"]) for r in rows], "array<array<double>>")
    near = df.withColumn("_k", F.transform(marks, lambda m: kernel(F.col(x), m, kind, gamma, degree)))
    among = near.sparkSession.createDataFrame([(i, list(r["x"])) for i, r in enumerate(rows)], f"i int, {x} array<double>")
    square = among.orderBy("i").select(F.transform(marks, lambda m: kernel(F.col(x), m, kind, gamma, degree)).alias("k")).collect()
    values, vectors = np.linalg.eigh(np.array([r["k"] for r in square]))
    good = values > max(values.max() * 1e-10, 1e-12)
    project = constant((vectors[:, good] / np.sqrt(values[good])).T.tolist(), "array<array<double>>")
    placed = near.withColumn("_phi", V.bound(F.col("_k"), lambda q: F.transform(project, lambda p: V.dot(q, p))))
    return kmeans(placed, "_phi", k, seed, attempts=3)[0].drop("_k", "_phi")


def adf_by_key(df: DataFrame, key: str, order: str | Sequence[str], value: str, block_rows: int = 32768) -> DataFrame:
    """Augmented Dickey-Fuller statistic with a constant, and the lag with the least AIC, of each series (null below 12 rows).

    A series is cut into blocks that overlap by the lags, each block gives its cross products, and these are added up; so no
    task sees a whole series, and what is solved a series is one small matrix.  The steps that have fewer steps than lags
    before them are as many as there are lags; each is kept as its own row, not as a matrix.
    """
    by = [order] if isinstance(order, str) else list(order)
    counts = df.groupBy(key).agg(F.count("*").alias("n")).withColumn("lags", F.greatest(F.lit(0), F.least(F.ceil(12 * F.pow(F.col("n") / 100, F.lit(0.25))), F.floor(F.col("n") / 2) - 2)).cast("int"))
    counts = cut(counts)
    placed = numbered(df.select(key, *by, value), by, "t", [key]).join(small_side(counts.filter("n >= 12")), key)
    block = F.floor(F.col("t") / block_rows)
    # A block also needs the lags + 2 rows before it.
    ahead = F.when(F.pmod("t", F.lit(block_rows)) >= block_rows - F.col("lags") - 2, F.array(block, block + 1)).otherwise(F.array(block))
    spread = placed.select(key, "t", F.col(value).cast("double").alias("v"), "lags", F.explode(ahead).alias("block"))

    def products(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("t")
        t, x, lags, own = p["t"].to_numpy(), p["v"].to_numpy(), int(p["lags"].iloc[0]), int(p["block"].iloc[0])
        d = np.diff(x)

        # Row i of the design is the step from t[i] to t[i + 1]: level, constant, earlier steps.
        def design(picked: np.ndarray) -> np.ndarray:
            return np.stack([x[:-1][picked], np.ones(len(picked)), *(np.where(picked >= j, d[picked - j], 0.0) for j in range(1, lags + 1)), d[picked]], axis=1)

        at = np.flatnonzero(t[1:] // block_rows == own)
        first, rest = at[t[at] < lags], at[t[at] >= lags]
        out = [(int(s), 1, row) for s, row in zip(t[first], design(first))]
        if len(rest):
            parts = (design(rest[s : s + 4096]) for s in range(0, len(rest), 4096))
            out.append((lags, len(rest), sum(rows.T @ rows for rows in parts).ravel()))
        return pd.DataFrame([(p[key].iloc[0], s, n, lags, m) for s, n, m in out], columns=[key, "start", "n", "lags", "m"])

    kind = dict(df.dtypes)[key]
    parts = spread.groupBy(key, "block").applyInPandas(products, f"{key} {kind}, start int, n long, lags int, m array<double>")
    cells = parts.select(key, "start", "lags", "n", F.posexplode("m").alias("i", "v")).groupBy(key, "start", "lags", "i").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    tables = cells.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "i", "v", "n"))).alias("c"), F.first("lags").alias("lags"))

    @F.udf("struct<adf: double, lag: int>")
    def solve(c, lags):
        size = lags + 3
        first, whole = np.array([r["v"] for r in c[: lags * size]]).reshape(lags, size), np.array([r["v"] for r in c[lags * size :]]).reshape(size, size)

        def fit(lag: int, since: int):
            m = whole + first[since:].T @ first[since:]
            n = c[-1]["n"] + lags - since
            keep = [*range(lag + 2), size - 1]
            m = m[np.ix_(keep, keep)]
            inverse = np.linalg.pinv(m[:-1, :-1], rcond=1e-14, hermitian=True)
            beta = inverse @ m[:-1, -1]
            left = max(m[-1, -1] - beta @ m[:-1, -1], 1e-300)
            return beta[0] / math.sqrt(inverse[0, 0] * left / (n - lag - 2)), 2 * (lag + 2) + n * (math.log(2 * math.pi * left / n) + 1)

        lag = min(range(lags + 1), key=lambda j: fit(j, lags)[1])
        return float(fit(lag, lag)[0]), lag

    solved = tables.withColumn("r", solve("c", "lags")).select(key, F.col("r.adf").alias("adf"), F.col("r.lag").alias("lag"))
    return counts.select(key).join(solved, key, "left")


def kmeans(df: DataFrame, x: str, k: int, seed: int = 1, rounds: int = 20, attempts: int = 1) -> tuple[DataFrame, list[list[float]], float]:
    """Labels, centroids and cost of the best of several k-means|| runs."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = df.withColumn("_x", array_to_vector(F.col(x).cast("array<double>")))
    fits = [KMeans(featuresCol="_x", predictionCol="cluster", k=k, seed=seed + i, maxIter=rounds).fit(data) for i in range(attempts)]
    best = min(fits, key=lambda m: m.summary.trainingCost)
    return best.transform(data).drop("_x"), [c.tolist() for c in best.clusterCenters()], best.summary.trainingCost


def elbow(df: DataFrame, x: str, most: int = 15, seed: int = 1) -> DataFrame:
    """Mean cost for k = 1..most; one centroid is the mean."""
    dims = len(df.select(x).first()[0])
    n, single = df.agg(F.count("*"), sum(F.var_pop(F.col(x)[i]) for i in range(dims))).first()
    rest = [(k, kmeans(df, x, k, seed)[2] / n) for k in range(2, most + 1)]
    return df.sparkSession.createDataFrame([(1, single), *rest], "k int, inertia double")


def pca(df: DataFrame, x: str, k: int) -> DataFrame:
    """Centred projection on the first k components: column `projected`."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    data = df.withColumn("_v", array_to_vector(F.col(x).cast("array<double>")))
    centred = StandardScaler(inputCol="_v", outputCol="_c", withMean=True, withStd=False).fit(data).transform(data)
    out = PCA(k=k, inputCol="_c", outputCol="_p").fit(centred).transform(centred)
    return out.withColumn("projected", vector_to_array("_p")).drop("_v", "_c", "_p")


def power_iteration_clusters(edges: DataFrame, k: int) -> DataFrame:
    """Spectral clusters of a weighted graph (src, dst, weight): id, cluster."""
    from pyspark.ml.clustering import PowerIterationClustering

    return PowerIterationClustering(k=k, maxIter=15, weightCol="weight").assignClusters(edges)
