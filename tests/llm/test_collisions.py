"""Near copies of vectors against all pairs."""

import math

import numpy as np
import pytest

from lumenfold.llm import collisions

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold=0.95):
    """Links and components of (id, vector) rows by all pairs, in double precision."""
    sound = [k for k, (_, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    label, links = list(range(len(rows))), [0] * len(rows)
    vectors = {k: np.array(rows[k][1], np.float64) for k in sound}
    near = {k: [] for k in sound}
    for size in {len(v) for v in vectors.values()}:
        own = [k for k in sound if len(vectors[k]) == size]
        m = np.stack([vectors[k] for k in own])
        norm = np.sqrt((m * m).sum(axis=1))
        hit = (m @ m.T) / np.outer(norm, norm) >= threshold
        for a, k in enumerate(own):
            near[k] = [own[b] for b in np.flatnonzero(hit[a]) if b != a]
    for k in sound:
        links[k] = len(near[k])
    for k in sound:
        todo = [k] if label[k] == k else []
        while todo:
            x = todo.pop()
            for y in near[x]:
                if label[y] > k:
                    label[y] = k
                    todo.append(y)
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[k] and rows[j][0] is not None]
        component = min(ids, default=None)
        out.append((i, links[k], component, links[k] == 0 if i is None else i == component))
    return sorted(out, key=repr)


def spread(rng, centre, n, deviation):
    v = centre + rng.normal(size=(n, len(centre))) * deviation
    return v / np.linalg.norm(v, axis=1)[:, None]


@pytest.fixture(scope="module")
def planted():
    rng = np.random.default_rng(4)
    v = [rng.normal(size=(400, 64)) / 8]
    for n, deviation in ((2, 0.01), (3, 0.02), (60, 0.018), (120, 0.024), (40, 0.027), (25, 0.03)):
        v.append(spread(rng, rng.normal(size=64) / 8, n, deviation))
    v.append(np.tile(v[0][:1], (30, 1)))  # copies
    v.append(v[0][1:2] * 7.5)  # the same direction
    v = np.concatenate(v).astype(np.float32)
    return [(int(k), x.tolist()) for k, x in zip(rng.permutation(len(v)), v)]


def of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_same_links_as_all_pairs(spark, planted):
    frame = spark.createDataFrame([(k, v, 1) for k, v in planted], SCHEMA)
    assert of(collisions.link_counts(frame)) == brute(planted)


def test_split_cells(spark, planted, monkeypatch):
    monkeypatch.setattr(collisions, "BLOCK", 20)
    monkeypatch.setattr(collisions, "MEETS", 16)
    frame = spark.createDataFrame([(k, v, 1) for k, v in planted], SCHEMA).repartition(5)
    assert of(collisions.link_counts(frame)) == brute(planted)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (5, [1.0, 0.0]), (5, [1.0, 0.0]), (3, [0.99, 0.01]), (None, [0.98, 0.0]), (9, [0.0, 1.0]), (None, [0.0, -1.0]), (1, None), (2, []), (4, [0.0, 0.0]), (6, [nan, 1.0]),
        (7, [inf, 1.0]), (8, [None, 1.0]), (None, None), (10, [1.0]), (11, [2.0]), (12, [-1.0]), (13, [1e30, 1e28]), (14, [1e-30, 0.0]),
    ]
    frame = spark.createDataFrame([(k, v, "x", 4) for k, v in rows], "vec_id long, embedding array<double>, kept string, node int")
    assert of(collisions.link_counts(frame)) == brute(rows)
    assert collisions.link_counts(frame.limit(0)).count() == 0


def test_the_plan_follows_the_number_of_vectors():
    plans = [collisions.plan(10**k, 0.95) for k in range(1, 9)]
    assert [p.cells for p in plans] == sorted(p.cells for p in plans) and plans[0].cells == 0
    meet, near = collisions._within(collisions.WINDOW), collisions._same_cell(collisions.CELL)
    for p in plans:
        assert 1 - (1 - meet * near**p.cells) ** p.tables >= collisions.RECALL


def test_recall_at_the_threshold(spark):
    """Pairs at a cosine of 0.951 among others: nearly all are found."""
    rng = np.random.default_rng(8)
    a = rng.normal(size=(1500, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    o = rng.normal(size=a.shape)
    o -= (o * a).sum(axis=1)[:, None] * a
    o /= np.linalg.norm(o, axis=1)[:, None]
    v = np.concatenate([a, 0.951 * a + math.sqrt(1 - 0.951**2) * o])
    frame = spark.createDataFrame([(k, x.tolist(), 1) for k, x in enumerate(v)], "vec_id long, embedding array<double>, label int")
    links = sum(r["n_links"] for r in collisions.link_counts(frame).collect())
    assert 0.995 * 3000 <= links <= 3000


def test_long_vectors(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(30, 1500))
    rows = [(k, x.tolist()) for k, x in enumerate(np.concatenate([v, v + rng.normal(size=v.shape) * 0.1]))]
    frame = spark.createDataFrame([(k, x, 1) for k, x in rows], "vec_id long, embedding array<double>, label int")
    assert of(collisions.link_counts(frame)) == brute(rows)


def test_query_equals_its_sql(spark):
    import oracle

    from lumenfold.llm import queries

    oracle.compare(spark, queries.op12_embedding_neardup, queries.ORACLE_SQL["op12_embedding_neardup"], "/root/testdata/sf0.001")
