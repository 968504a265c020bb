import pytest
from oracle import compare

from lumenfold import catalog

SF = "/root/testdata/sf0.001"
SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_duckdb(spark, name):
    compare(spark, catalog.queries()[name], SQL[name], SF)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_runs(spark, name):
    df = catalog.queries()[name](spark, SF)
    rows = df.collect()
    assert rows and all(any(r[c] is not None for r in rows) for c in df.columns)
