"""Laps are exchanged once on their way to final features, and written once after their last window."""

import pytest
from conftest import FOLDER

from pyspark.sql import functions as F

from pacegrid.operators.skew import ROWS_SETTING, Profile
from pacegrid.plans import features
from pacegrid.plans import race as ways
from pacegrid.plans.features import PLAIN, RESIDUAL, SEARCHED
from pacegrid.queries import racing
from pacegrid.queries.base import Tables
from test_race import race  # noqa: F401
from test_rounds import final  # noqa: F401


def final_and_written(spark, monkeypatch, variant):
    written, whole = [], features.settle
    with monkeypatch.context() as patched:
        patched.setattr(features, "settle", lambda df: written.append(df) or whole(df))
        final = racing.final(Tables(spark, FOLDER), variant)
    return sorted(map(str, final.drop(*features.CELLS, "KPH").collect())), written


@pytest.mark.parametrize("variant", [RESIDUAL, SEARCHED, PLAIN], ids=lambda v: v.name)
def test_one_exchange_and_one_copy(spark, monkeypatch, variant):
    rows, written = final_and_written(spark, monkeypatch, variant)
    (copy,) = written
    plan = copy._jdf.queryExecution().executedPlan().toString()
    assert len([line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "NUMBER" in line]) == 1
    assert not {"DRIVER_NAME", "ELAPSED", "LAP_IMPROVEMENT", "ROW_N", "TIME_UTC_DATE"} & set(copy.columns)
    # without a bound the wide rows are written and looked through
    spark.conf.set(ROWS_SETTING, "1")
    try:
        looked, written = final_and_written(spark, monkeypatch, variant)
    finally:
        spark.conf.unset(ROWS_SETTING)
    assert looked == rows and len(written) > 1


@pytest.mark.parametrize("variant", [RESIDUAL, SEARCHED, PLAIN], ids=lambda v: v.name)
def test_known_bounds_change_no_row(spark, race, variant):  # noqa: F811
    wide = features.wide_features(*race, ["tr"], variant.carried, variant.cutoff)
    plain, known = (sorted(map(str, features.finalize_features(wide, variant, known=k).collect())) for k in (None, Profile({(): 100})))
    assert plain == known and plain


def test_laps_of_the_stack_are_written_once(final, monkeypatch):  # noqa: F811
    """Once with their part, and once with their codes."""
    written, whole = [], ways.settle
    monkeypatch.setattr(ways, "settle", lambda df: written.append(df.columns) or whole(df))
    more = {"GROUP": 0.0, "KPH": 150.0, "POWER": 200.0, "TEAM": "T"}
    predicted = ways.residual_predictions(final.withColumns({c: F.lit(v) for c, v in more.items()}), maxIter=2, maxDepth=2)
    assert ["NUMBER_MEAN" in c for c in written if "LAP_KEY" in c] == [False, True]
    assert predicted.count() == 180
