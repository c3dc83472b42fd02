"""Queries that must report on every row of their tables."""

import pytest
from test_components import union_find
from twins import DATA

from epochal.operators import analytics as an
from epochal.plans import registry

D = f"{DATA}/sf0.001"


@pytest.mark.parametrize("name, column, ids", [("state_partition_scan", "t_id", "SELECT o_orderkey FROM orders"), ("tpcc_missing_items", "t_id", "SELECT l_orderkey FROM lineitem"), ("prediction_log_explode", "event_id", "SELECT event_id FROM events")])
def test_query_has_every_id(spark, duck, name, column, ids):
    got = registry.QUERIES[name](spark, D).select(column).distinct().toPandas()[column]
    assert set(got) == {x for (x,) in duck.sql(ids).fetchall()}


def test_components_of_all_epochs(spark):
    """sf0.01 has a dozen epochs; the components are held against union-find."""
    d = f"{DATA}/sf0.01"
    links = [(r.epoch, r.t_id, r.depends_on) for r in registry.QUERIES["fallback_dependencies"](spark, d).collect()]
    got = registry.QUERIES["fallback_components"](spark, d).collect()
    want = union_find([x[1:] for x in links])
    assert {r.t_id: r.component for r in got} == want and len(got) == len(want)
    assert len({e for e, _, _ in links}) > 4


def test_all_outputs_behind_the_first(spark, duck):
    got = registry.QUERIES["skip_first_outputs"](spark, D).count()
    assert got == len(duck.sql(registry.ORACLES["skip_first_outputs"].replace(" OFFSET 20", "")).df()) - 20 > 600
    rows = spark.createDataFrame([(1, 1), (1, 1), (1, 1), (2, 0)], "a int, b int")
    for n in range(6):
        assert sorted(map(tuple, an.behind_first(rows, ["a", "b"], n).collect())) == [(1, 1), (1, 1), (1, 1), (2, 0)][n:]


def test_data_of_bad_credit_goes_past_200_characters(spark):
    assert 500 >= registry.QUERIES["tpcc_bad_credit_data"](spark, D).toPandas()["data"].str.len().max() > 200
