"""Queries over series whose rounded numbers must equal SQL's to the last bit, with the sign of zero."""

import pytest
from oracle import connect
from pyspark.sql import functions as F

from lumenfold import catalog
from lumenfold.functions.scalars import round_product


@pytest.fixture(scope="module")
def events(tmp_path_factory):
    """200 users with 128 values of two digits, whose means end with a 5 in the ninth place."""
    import duckdb

    folder = tmp_path_factory.mktemp("events")
    duckdb.connect().execute(
        f"""COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_seconds(i) AS ts, i // 128 AS user_id, 'view' AS event_type,
            round([(hash(i) % 50000) / 100.0, (hash(i) % 2500) / 100.0, 30 + (hash(i) % 60) / 100.0][1 + i // 128 % 3], 2) AS value, '{{}}' AS props FROM range(25600) t(i)) TO '{folder}/events.parquet'"""
    )
    return str(folder)


@pytest.mark.parametrize("name, column", [("normalise_signal", "y"), ("second_difference", "d")])
def test_series_to_the_last_bit(spark, events, name, column):
    want = dict(connect(events).execute(f"SELECT user_id, {column} FROM ({catalog.oracle_sql()[name]})").fetchall())
    got = {r["user_id"]: r[column] for r in catalog.queries()[name](spark, events).collect()}
    assert len(got) == 200 and any(repr(v) == "-0.0" for x in want.values() for v in x) >= (name == "second_difference")
    assert {k: list(map(repr, x)) for k, x in got.items()} == {k: list(map(repr, x)) for k, x in want.items()}


def test_round_product(spark):
    import duckdb

    values = [None, float("nan"), float("inf"), -float("inf"), 0.0, -0.0, -1e-9, 2.5, -2.5, 1.005, 0.49999999999999994, 1e305, -(2.0**53) - 2, 1234567.00005, 4503599627370497.5]
    for places in (0, 2, 4, 8):
        got = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(round_product(F.col("v"), places)).collect()]
        assert list(map(repr, got)) == [repr(duckdb.execute("SELECT round(CAST(? AS DOUBLE), ?)", [v, places]).fetchone()[0]) for v in values]
