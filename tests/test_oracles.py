"""Every query against its SQL twin, and the ordered ones again with large groups cut."""

import pytest
from compare import connect, differences
from conftest import FOLDER

import __spark_entry__ as contract
from pacegrid.queries import REGISTRY

WITH_SQL = sorted(n for n, q in REGISTRY.items() if q.sql)
FITS = sorted(n for n, q in REGISTRY.items() if not q.sql)
CUT = [
    "align_by_ordinal",
    "category_code",
    "fill_down",
    "fill_updown",
    "grid_left_join",
    "group_size",
    "impute_group_mean",
    "lag_lead",
    "lag_lead_offset",
    "multi_key_inner_join",
    "nest_unnest",
    "ordered_target_codes",
    "permutation_importance",
    "position_timeline",
    "repeat_ordinal",
    "row_block",
    "running_total",
    "sector_clock",
    "time_bucket_join",
]


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", WITH_SQL)
def test_same_rows_as_sql(spark, con, name):
    q = REGISTRY[name]
    df = q.run(spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for unwanted in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert unwanted not in plan
    assert differences(name, df, con, q.sql) == []


@pytest.mark.parametrize("name", CUT)
def test_same_rows_when_groups_are_cut(spark, con, splitting, name):
    q = REGISTRY[name]
    assert differences(name, q.run(spark, FOLDER), con, q.sql) == []


@pytest.mark.parametrize("name", FITS)
def test_fits_give_rows(spark, name):
    assert REGISTRY[name].run(spark, FOLDER).count() > 0


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).count() > 0
