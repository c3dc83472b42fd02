"""Every query of the engine against its DuckDB twin on the smallest tables."""

import pytest
from twins import DATA, same

from epochal.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows_as_duckdb(spark, duck, name):
    same(registry.QUERIES[name](spark, f"{DATA}/sf0.001").toPandas(), duck.sql(registry.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs_the_same_twice(spark, name):
    rows = [sorted(map(str, registry.QUERIES[name](spark, f"{DATA}/sf0.001").collect())) for _ in range(2)]
    assert rows[0] and rows[0] == rows[1]
