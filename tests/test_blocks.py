"""Block matrices, kernel k-means on all rows, batches and sketches against NumPy and plain counts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.operators import batches, blocks


def test_gram_and_transpose(spark):
    x = np.random.default_rng(1).normal(size=(150, 4))
    df = spark.createDataFrame([(i * 2, r.tolist()) for i, r in enumerate(x)], "row long, v array<double>").repartition(5)
    g = np.zeros((4, 4))
    for r in blocks.gram(df.unionByName(spark.createDataFrame([(-1, None)], df.schema)), "v").collect():
        g[r["row"], r["col"]] = r["value"]
    assert np.allclose(g, x.T @ x) and blocks.gram(df.limit(0), "v").count() == 0
    got = {(r["col"], r["block"]): r["v"] for r in blocks.transpose(df, "row", "v", 64).collect()}
    assert got == {(c, b): x[b * 32 : (b + 1) * 32, c].tolist() for c in range(4) for b in range(5)}
    assert blocks.transpose(df.limit(0), "row", "v").count() == 0


def plain_kernel_kmeans(kernel, weights, labels, k, rounds, tolerance=1e-5):
    for _ in range(rounds):
        d = np.empty((len(labels), k))
        for j in range(k):
            own = labels == j
            w = weights[own]
            d[:, j] = np.outer(w, w).ravel() @ kernel[np.ix_(own, own)].ravel() / w.sum() ** 2 - 2 * kernel[:, own] @ w / w.sum()
        new = d.argmin(axis=1)
        changed = (new != labels).mean()
        labels = new
        if changed < tolerance:
            break
    return labels


@pytest.mark.parametrize("kind", ["rbf", "linear", "poly"])
def test_kernel_kmeans_without_landmarks(spark, kind):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(size=(30, 3)) + 4 * np.eye(3)[i] for i in range(3)])
    weights, labels = rng.uniform(0.5, 2, 90), rng.integers(0, 3, 90)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "place long, v array<double>").repartition(3)
    sq = (x * x).sum(1)
    want = {"rbf": np.exp(-0.3 * (sq[:, None] + sq - 2 * x @ x.T)), "linear": x @ x.T, "poly": (0.3 * x @ x.T + 1) ** 3}[kind]
    kernel = blocks.kernel_blocks(df, "place", "v", kind, 0.3, 3, size=32)
    got = np.zeros((90, 90))
    for r in kernel.collect():
        got[r["row"], r["block"] * 32 : r["block"] * 32 + len(r["values"])] = r["values"]
    assert np.allclose(got, want)
    first = spark.createDataFrame([(i, float(w), int(j)) for i, (w, j) in enumerate(zip(weights, labels))], "row long, weight double, label int")
    out = {r["row"]: r["label"] for r in blocks.precomputed_kernel_kmeans(kernel, first, 3, rounds=6, size=32).collect()}
    assert [out[i] for i in range(90)] == plain_kernel_kmeans(want, weights, labels, 3, 6).tolist()
    with pytest.raises(ValueError):
        blocks.precomputed_kernel_kmeans(kernel, first, 4, size=32)


@pytest.mark.parametrize("kind", ["rbf", "linear", "poly"])
def test_kernel_kmeans_without_a_stored_kernel(spark, kind):
    """Blocks whose last is short, rows in any order and numbers of four bytes: equal to the whole kernel."""
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(31, 5)) + 3 * np.eye(5)[i] for i in range(3)]).astype(np.float32)
    weights, labels = rng.uniform(0.5, 2, 93), rng.integers(0, 3, 93)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)][::-1], "place int, v array<float>").repartition(4)
    y = x.astype(float)
    sq = (y * y).sum(1)
    whole = {"rbf": np.exp(-0.3 * (sq[:, None] + sq - 2 * y @ y.T)), "linear": y @ y.T, "poly": (0.3 * y @ y.T + 1) ** 2}[kind]
    first = spark.createDataFrame([(i, float(w), int(j)) for i, (w, j) in enumerate(zip(weights, labels))], "row long, weight double, label int").repartition(3)
    for size in (20, 500):
        out = {r["row"]: r["label"] for r in blocks.vector_kernel_kmeans(df, "place", "v", first, 3, kind, 0.3, 2, rounds=6, size=size).collect()}
        assert [out[i] for i in range(93)] == plain_kernel_kmeans(whole, weights, labels, 3, 6).tolist()
    with pytest.raises(ValueError):
        blocks.vector_kernel_kmeans(df, "place", "v", first, 4, size=20)


def test_clusters_by_kernel_store_no_kernel(spark, monkeypatch):
    """The query checkpoints no more than its rows, their labels and sums: never a value for each pair."""
    from lumenfold import catalog

    kept = []
    monkeypatch.setattr(blocks, "cut", lambda df, cut=blocks.cut: kept.append(cut(df)) or kept[-1])
    rows = catalog.queries()["kernel_block_clusters"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 500 and kept and not any({"row", "block", "values"} <= set(df.columns) for df in kept)


def test_padding(spark):
    rng = np.random.default_rng(3)
    rows = [(i, None if i == 3 else rng.integers(1, 99, rng.integers(0, 60)).tolist(), "x") for i in range(400)]
    df = spark.createDataFrame(rows, "k long, ids array<long>, batch string").repartition(4)
    out = batches.padded_batches(df, "ids", ["k"], 200, 50)
    full = out.select("*", batches.pad(F.col("ids"), F.col("padded"), 0).alias("p"), batches.mask(F.col("ids"), F.col("padded")).alias("m"), batches.pad(F.col("ids"), F.col("padded"), 0, "left").alias("left")).collect()
    assert len(full) == 400
    sizes = {}
    for r in full:
        ids = (rows[r["k"]][1] or [])[:50]
        assert r["ids"] == ids and len(r["p"]) == len(r["m"]) == r["padded"] and r["p"][: len(ids)] == ids and sum(r["m"]) == len(ids)
        assert r["left"][r["padded"] - len(ids) :] == ids and r["padded"] - len(ids) < 8
        sizes.setdefault((r["bucket"], r["batch"]), []).append(r["padded"])
    assert all(len(set(v)) == 1 and len(v) * max(v[0], 1) <= 200 for v in sizes.values() if v[0])
    left = {r["k"]: r["ids"] for r in batches.padded_batches(df, "ids", ["k"], 200, 10, side="left").collect()}
    assert all(left[k] == (ids or [])[-10:] for k, ids, _ in rows)
    share = batches.pad_share(out).first()
    assert share["share"] < 0.2 and batches.padded_batches(df.limit(0), "ids", ["k"], 200, 50).count() == 0


def test_sketches(spark):
    df = spark.range(40_000).select((F.col("id") % 10).alias("day"), (F.col("id") % 9973).alias("user"), (F.col("id") * 7919 % 40_000).cast("double").alias("v"))
    days = batches.sketches(df, ["day"], "user", "v")
    assert dict(days.dtypes)["distinct"] == dict(days.dtypes)["quantiles"] == "binary"
    r = batches.estimates(batches.merged(days, []), [0.1, 0.5, 0.9]).first()
    assert r["rows"] == 40_000 and abs(r["n_distinct"] / 9973 - 1) < 0.05
    assert all(abs(x / 40_000 - q) < 0.03 for x, q in zip(r["at"], [0.1, 0.5, 0.9]))


def test_distinct_users_are_exact(spark, tmp_path):
    """Beyond the users whose number a sketch gives exactly, with null users and types."""
    from lumenfold import catalog
    from oracle import compare

    i = F.col("id")
    events = spark.range(300_000).select(
        i.alias("event_id"), F.timestamp_seconds(1_700_000_000 + i * 37 % 900_000).alias("ts"), F.when(i % 11 > 0, F.xxhash64(i % 90_001)).alias("user_id"),
        F.when(i % 3 == 0, "view").when(i % 3 == 1, "click").alias("event_type"), (i % 50).cast("double").alias("value"),
    )
    events.write.parquet(f"{tmp_path}/events.parquet")
    compare(spark, catalog.queries()["merged_sketches"], catalog.oracle_sql()["merged_sketches"], str(tmp_path))
