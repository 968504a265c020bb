"""The graph of nearest neighbours against all pairs, and clusters on it."""

import numpy as np
import pytest

from lumenfold.operators import neighbours

SF = "/root/testdata/sf0.1"


def test_small_graphs_are_exact(spark):
    x = np.random.default_rng(2).normal(size=(120, 5))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>").repartition(4)
    got = {}
    for r in neighbours.neighbour_graph(df, "id", "v", 4).collect():
        got.setdefault(r["id"], {})[r["rank"]] = (r["other"], r["distance"])
    d = np.linalg.norm(x[:, None] - x[None], axis=2) + np.diag([np.inf] * 120)
    for i in range(120):
        order = np.argsort(d[i])[:4]
        assert [got[i][k + 1][0] for k in range(4)] == order.tolist() and np.allclose([got[i][k + 1][1] for k in range(4)], d[i, order])
    assert neighbours.neighbour_graph(df.limit(0), "id", "v").count() == 0 and neighbours.neighbour_graph(df.limit(1), "id", "v").count() == 0


def test_recall_against_all_rows(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    graph = neighbours.neighbour_graph(e, "vec_id", "embedding")
    assert graph.groupBy("vec_id").count().filter("count <> 10").count() == 0
    assert neighbours.recall(graph, e, e.filter("vec_id % 100 = 0"), "vec_id", "embedding") >= 0.9


def test_equal_rows_are_split(spark):
    x = [[1.0, 2.0]] * 900 + np.random.default_rng(1).normal(size=(600, 2)).tolist()
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "id long, v array<double>")
    out = neighbours.neighbour_graph(df, "id", "v", 3, bucket=64, rounds=1)
    assert out.filter("id < 900 and distance > 1e-6").count() == 0 and out.select("id").distinct().count() == 1500


@pytest.mark.parametrize("k", [3])
def test_spectral_clusters(spark, k):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(60, 4)) * 0.2 + 5 * np.eye(4)[i] for i in range(k)])
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>")
    out = {r["id"]: r["cluster"] for r in neighbours.spectral_clusters(df, "id", "v", k, 8).collect()}
    assert len(out) == 180 and len(set(out.values())) == k and all(len({out[i] for i in range(c * 60, c * 60 + 60)}) == 1 for c in range(k))
