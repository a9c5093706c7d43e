"""Every query of the catalogue with oracle SQL, against DuckDB on the smallest tables."""

import pytest
from conftest import same_as_oracle

from quillon.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_oracle(spark, duck, data, name):
    same_as_oracle(spark, duck, data, catalogue.QUERIES[name], catalogue.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, data, name):
    assert catalogue.QUERIES[name](spark, data).limit(3).collect() is not None


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0 and "risk_score" in df.columns
    assert set(e.oracle_sql()) <= set(e.queries())
