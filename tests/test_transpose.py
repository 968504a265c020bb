"""The transposed matrix has whole columns, however many rows there are, on odd vectors and ids too."""

import random

import pyarrow as pa
import pyarrow.parquet as pq
from oracle import compare

from lumenfold import catalog
from lumenfold.operators import blocks

SQL = "SELECT i - 1 AS col, list(v ORDER BY vec_id) AS embedding FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1"
QUERY = catalog.queries()["matrix_transpose"]


def test_columns_of_more_rows_than_a_block(spark):
    assert catalog.oracle_sql()["matrix_transpose"] == SQL
    compare(spark, QUERY, SQL, "/root/testdata/sf0.1")
    out = QUERY(spark, "/root/testdata/sf0.1")
    assert dict(out.dtypes) == {"col": "bigint", "embedding": "array<float>"}
    assert sorted((r["col"], len(r["embedding"])) for r in out.collect()) == [(c, 2000) for c in range(64)]


def test_odd_vectors_in_many_ranges(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i * 7 - 9000, [rng.choice([None, rng.gauss(0, 1), 0.0]) for _ in range(rng.choice([3, 3, 3, 0, 1, 300]))]) for i in range(3000)]
    rows += [(None, [1.5, 2.5]), (5_000_000_000, None), (-9_500_000_000, [7.0])]
    rng.shuffle(rows)
    pq.write_table(pa.table({"vec_id": pa.array([r[0] for r in rows], pa.int64()), "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float32()))}), tmp_path / "embeddings.parquet")
    held = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.execution.arrow.maxRecordsPerBatch": "100"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        compare(spark, QUERY, SQL, str(tmp_path))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_rows_of_one_number_stay_rows(spark):
    df = spark.createDataFrame([(i // 50, [float(i), float(-i)]) for i in range(1000)], "row long, v array<double>").repartition(5)
    a, b = (r["v"] for r in sorted(blocks.transpose_whole(df, "row", "v").collect()))
    assert [-x for x in a] == b and [x // 50 for x in a] == [i // 50 for i in range(1000)] and len(set(a)) == 1000
    assert blocks.transpose_whole(df.limit(0), "row", "v").count() == 0
