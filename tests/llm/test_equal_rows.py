"""Many equal rows: they are one text for the search of repeats."""

import time

from lumenfold.llm import suffix


def test_equal_rows_take_the_time_of_one(spark):
    text = " ".join(str(i * 7919) for i in range(170))[:1000]
    other = "x" * 50 + text[300:600] + "y" * 50
    short = "z" * 150
    rows = spark.range(100_000).selectExpr("cast(null as long) as doc_id", f"'{text}' as text", "id as nth")
    more = spark.createDataFrame([(1, other, 0), (2, short, 0), (2, short, 0), (3, text[:199], 0), (3, None, 0), (3, None, 0), (None, short, 0)], "doc_id long, text string, nth long")
    began = time.time()
    got = suffix.without_repeats(rows.unionByName(more)).groupBy("doc_id", "n_bytes", "n_removed", "n_spans").count().collect()
    assert {tuple(r) for r in got} == {(None, 1000, 1000, 1, 100_000), (1, 400, 300, 1, 1), (2, 150, 0, 0, 2), (3, 199, 0, 0, 1), (3, 0, 0, 0, 2), (None, 150, 0, 0, 1)}
    assert time.time() - began < 60
