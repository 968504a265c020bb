"""Mixtures, hidden Markov models, clusters and stationarity against plain NumPy."""

import numpy as np
import pytest
from plain import dtw_plain, models_plain
from pyspark.sql import functions as F

from lumenfold.operators import dtw, models
from lumenfold.sources import binary

RNG = np.random.default_rng(3)
X = np.concatenate([RNG.normal(-4, 1, (200, 2)), RNG.normal(4, 1, (200, 2))])
G = models_plain.Gmm(np.array([0.4, 0.6]), np.array([[-3.0, -3.0], [3.0, 2.0]]), np.array([[1.0, 1.5], [2.0, 0.5]]))


@pytest.fixture(scope="module")
def frames(spark):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(X)], "id int, features array<double>")


@pytest.fixture(scope="module")
def mixture(spark):
    return models.gmm_table(spark, "m", G.weights, G.means, G.variances)


def rows(table):
    return sorted((r["weight"], *r["mean"], *r["var"]) for r in table.collect())


def plain_rows(g):
    return sorted((w, *m, *v) for w, m, v in zip(g.weights, g.means, g.variances))


def test_scores_and_criterion(frames, mixture):
    got = [r["llr"] for r in models.gmm_scores(frames, mixture).orderBy("id").collect()]
    assert np.allclose(got, G.log_likelihood(X)) and models.bic(frames, mixture) == pytest.approx(G.bic(X))


def test_fit_and_selection(frames):
    fit = models.gmm_fit(frames, "features", 2)
    assert np.allclose(rows(fit), plain_rows(models_plain.gmm_fit(X, 2)), atol=0.02)
    found = {r["k"]: r["bic"] for r in models.select_by_bic(frames, "features", 3, rounds=10).collect()}
    assert min(found, key=found.get) == 2


def test_adapt_mix_select(spark, frames, mixture):
    assert np.allclose(rows(models.adapt(frames, mixture, rounds=3)), plain_rows(G.adapt(X, rounds=3)))
    both = models.mix(mixture, mixture, "b")
    assert sorted(r["comp"] for r in both.collect()) == [0, 1, 2, 3] and both.agg(F.sum("weight")).first()[0] == pytest.approx(1)
    assert np.allclose(rows(models.select_components(both, [0], invert=True)), plain_rows(G.mix(G).select([0], invert=True)))


def test_hidden_markov(spark, mixture, tmp_path):
    parts = mixture.orderBy("comp").collect()
    states = [[parts[0].__class__(**(r.asDict() | {"weight": 1.0}))] for r in parts]
    model = models.hmm_table(spark, "h", models.left_right(2), states)
    h = models_plain.Hmm(models_plain.left_right(2), [G.select([0]), G.select([1])])
    up = np.concatenate([X[:20], X[200:220]])
    said = spark.createDataFrame([(0, up.tolist()), (1, up[::-1].tolist()), (2, [])], "id int, frames array<array<double>>")
    got = {r["id"]: r["p"] for r in models.hmm_scores(said, model).collect()}
    assert set(got) == {0, 1} and got[0] == pytest.approx(h.forward(up)[0]) and got[1] < got[0]
    learned, plain = models.hmm_learn(said.filter("id = 0"), model), h.learn(up)
    transitions = [r["transitions"] for r in learned.orderBy("state").collect()]
    assert np.allclose(transitions, plain.transitions, atol=1e-6)
    assert np.allclose([r["mean"] for r in learned.orderBy("state").collect()], [s.means[0] for s in plain.states], atol=1e-6)
    binary.save_model(learned, str(tmp_path / "h"))
    assert binary.load_model(spark, str(tmp_path / "h"), "h").count() == 2 and binary.load_model(spark, str(tmp_path / "h"), "x").count() == 0


def test_keyword_states(spark, mixture):
    up = np.concatenate([X[:12], X[200:212]])
    f = spark.createDataFrame([("w", i, v.tolist()) for i, v in enumerate(up)], "word string, frame int, features array<double>")
    model = models.keyword_hmm(f, mixture, "word", "frame", threshold=1.0, top=1)
    assert [r["state"] for r in model.orderBy("state").collect()] == [0, 1]


def test_kernel_clusters_and_codebooks(spark, frames):
    got = [r["cluster"] for r in models.kernel_kmeans(frames, "features", 2, "id", gamma=0.1, landmarks=50).orderBy("id").collect()]
    assert len(set(got[:200])) == len(set(got[200:])) == 1 and got[0] != got[-1]
    named = frames.withColumn("who", F.when(F.col("id") < 200, "a").otherwise("b"))
    books = models.codebooks(named, "who", "features", 2)
    near = models.nearest_codebook(named.withColumn("utt", (F.col("id") / 100).cast("int")), "utt", "features", books)
    assert [r["label"] for r in near.orderBy("utt").collect()] == ["a", "a", "b", "b"]
    inertia = [r["inertia"] for r in models.elbow(frames, "features", 3).orderBy("k").collect()]
    assert inertia[0] == pytest.approx(X.var(axis=0).sum()) and inertia[0] > inertia[1] > inertia[2]


def test_sequential_clusters(spark):
    means = [0.0, 0.1, 9.0, 9.1, 20.0, 9.0]
    df = spark.createDataFrame([("u", i, [m], [1.0]) for i, m in enumerate(means)], "u string, frame int, mean array<double>, var array<double>")
    assert [r["label"] for r in models.sequential_clusters(df, "u", "frame", 1.0).orderBy("frame").collect()] == [0, 0, 1, 1, -1, -1]


def test_stationarity(spark):
    series = {"noise": RNG.normal(size=300), "walk": np.cumsum(RNG.normal(size=230)), "short": RNG.normal(size=13), "tiny": np.arange(5.0)}
    df = spark.createDataFrame([(k, i, float(v)) for k, x in series.items() for i, v in enumerate(x)], "k string, t int, v double")
    got = {r["k"]: (r["adf"], r["lag"]) for r in models.adf_by_key(df, "k", "t", "v", 64).collect()}
    for k in ("noise", "walk", "short"):
        assert got[k] == pytest.approx(models_plain.adf(series[k]), rel=1e-6)
    assert got["tiny"] == (None, None)


KINDS = [{}, {"subsequence": True, "best": True}, {"transition": "dtw", "subsequence": True, "best": True}, {"transition": "dtw", "kind": "euclidean"}, {"kind": "manhattan", "best": True}]


def test_warping(spark):
    pairs = [(i, RNG.normal(size=(RNG.integers(0, 11), 3)), RNG.normal(size=(RNG.integers(0, 8), 3))) for i in range(25)]
    df = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, a, b in pairs] + [(99, None, [[1.0]])], "i int, x array<array<double>>, y array<array<double>>")
    for options in KINDS:
        got = {r["i"]: r["w"] for r in df.select("i", dtw.warp(F.col("x"), F.col("y"), path=True, **options).alias("w")).collect()}
        for i, a, b in pairs:
            score, path = dtw_plain.score(a, b, **options)
            assert got[i]["score"] == pytest.approx(score) and (score == dtw.FAR or got[i]["at"] == path)
        assert got[99]["score"] == dtw.FAR


def test_template_fusion(spark):
    parts = [RNG.normal(size=(n, 3)) for n in (5, 4, 6)]
    df = spark.createDataFrame([("a", i, f.tolist()) for i, f in enumerate(parts)] + [("b", 0, parts[0].tolist())], "k string, id int, frames array<array<double>>")
    got = {r["k"]: r["frames"] for r in dtw.fuse_by_key(df, "k").collect()}
    assert np.allclose(got["a"], dtw_plain.fuse_templates(parts)) and np.allclose(got["b"], parts[0])


def test_stationarity_keeps_little_of_a_series(spark, monkeypatch):
    """What is gathered for a series is one matrix and a row for each lag, however its blocks lie; the result is that of the whole series."""
    x = np.cumsum(RNG.normal(size=3000)) * 0.1 + RNG.normal(size=3000)
    df = spark.createDataFrame([(k, i % 2, i, float(v)) for k in ("a", None) for i, v in enumerate(x)], "k string, odd int, t int, v double").repartition(3)
    lags = int(np.ceil(12 * 30**0.25))
    in_order = models.F.array_sort
    monkeypatch.setattr(models.F, "array_sort", lambda c: models.F.when(models.F.size(c) <= (2 * lags + 3) * (lags + 3), in_order(c)))  # else null
    got = {r["k"]: (r["adf"], r["lag"]) for r in models.adf_by_key(df, "k", ["t"], "v", 128).collect()}
    assert got["a"] == pytest.approx(models_plain.adf(x), rel=1e-6)
