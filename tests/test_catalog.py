"""Every catalogue query with SQL agrees with DuckDB, and the contract of the entry module holds."""

import pytest
from oracle import compare, connect

from tenora.catalog import load

SF = "/root/testdata/sf0.001"
CATALOG = load()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", [n for n, q in CATALOG.items() if q.sql])
def test_matches_sql(spark, duck, name):
    assert compare(spark, duck, CATALOG[name], SF, close=True) is None


@pytest.mark.parametrize("name", ["factor_projection", "principal_components", "segmented_embeddings"])
def test_rows_only(spark, name):
    assert CATALOG[name].build(spark, SF).count() > 0


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    df = entry.entry(spark)
    assert df.columns == ["Cluster", "n", "churn_pct", "churn_score_avg", "cltv_avg", "tenure_avg"]
    assert df.count() == 5
