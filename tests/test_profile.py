"""Bounds taken once stand for finer keys and filtered rows, and save the look for large groups."""

import pytest
from pyspark.sql import functions as F

from pacegrid.operators import joins, skew
from pacegrid.operators.ordered import Ordered
from pacegrid.queries import REGISTRY
from pacegrid.session import Size, settle_sized
from conftest import FOLDER


def jobs(spark, work):
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    work()
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - before


@pytest.fixture(scope="module")
def table(spark):
    return spark.range(300).select((F.col("id") % 3).alias("a"), (F.col("id") % 30).alias("b"), "id").cache()


def test_bounds_hold(table):
    known = skew.profile(table, ["a"], ["b", "a"])
    assert 100 <= known.most(["a"]) <= 300 and known.most(["c"]) == known.most(()) == 300
    assert 10 <= known.most(["a", "b", "id"]) <= known.most(["a"])
    assert skew.Profile({("a",): 7}).most(["b"]) is None


def test_of_an_empty_table(table):
    assert skew.profile(table.limit(0), ["a"]).bounds == {(): 0, ("a",): 0}


def test_known_bounds_cost_no_job(spark, table):
    known = skew.profile(table, ["a"])
    assert jobs(spark, lambda: Ordered(table, ["a", "b"], ["id"], known=known)) == 0
    assert jobs(spark, lambda: Ordered(table, ["a", "b"], ["id"])) > 0


def test_bounds_above_the_limit_are_counted(table, splitting):
    known = skew.profile(table, ["a"])
    assert len(skew.large_groups(table, ["a"], known)) == 3
    assert Ordered(table, ["a"], ["id"], known=known).groups.split
    # the table has 300 rows, but no pair more than 10
    assert skew.large_groups(table, ["a", "b"], skew.Profile({(): 300})) == []


def test_sizes_are_observed(spark, table):
    df = table.selectExpr("id", "repeat('é', 10) AS s", "array(id, id) AS l").where("id < 50")
    settled, size = settle_sized(df)
    assert settled.count() == size.rows == 50 and size.bytes >= 50 * (8 + 20 + 16)
    assert settle_sized(df.where("id < 0"))[1] == Size(0, 0)
    assert jobs(spark, lambda: joins.fits_broadcast(settled, known=size)) == 0
    assert not joins.fits_broadcast(settled, rows=10, known=size)
    assert size.times(60).rows == 3000


@pytest.mark.parametrize("name, most", [("wide_features", 14), ("gapfilled_series", 8), ("position_timeline", 4), ("time_bucket_join", 8)])
def test_jobs_before_the_action(spark, name, most):
    assert jobs(spark, lambda: REGISTRY[name].run(spark, FOLDER)) <= most
