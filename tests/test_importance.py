"""A feature given to other rows: each value is used once, and what a model does not read costs nothing."""

import pytest
from pyspark.sql import functions as F

from pacegrid.plans import models as M
from pacegrid.plans.importance import permutation_importance, permuted


@pytest.fixture(scope="module")
def rows(spark):
    n = F.col("id")
    x, noise = (n * 37 % 101).cast("double"), (n * 53 % 17).cast("double")
    kind = F.element_at(F.array(F.lit("a"), F.lit("b")), (n % 2 + 1).cast("int"))
    y = 20 + 3 * x + F.when(kind == "b", 40.0).otherwise(0.0)
    return spark.range(400).select("id", x.alias("x"), noise.alias("noise"), kind.alias("kind"), y.alias("y")).cache()


def given(rows, **settings):
    return sorted((r["id"], r["o"]["id"]) for r in permuted(rows, ["id", "x"], ["id"], "o", **settings).collect())


def test_every_row_gives_once(rows):
    pairs = given(rows)
    assert [a for a, _ in pairs] == list(range(400)) == sorted(b for _, b in pairs)
    assert sum(a == b for a, b in pairs) < 12
    assert given(rows.repartition(7)) == pairs != given(rows, salt=1)


def test_same_pairs_when_the_table_is_cut(rows, splitting):
    cut = given(rows)
    rows.sparkSession.conf.unset("pacegrid.split.rows")
    assert cut == given(rows)


def test_importance_of_trees(rows):
    model = M.fit_trees(rows, "y", ["x", "noise"], ["kind"], maxDepth=6)
    table = permutation_importance(model.transform, rows, "y", ["x", "noise", "kind"], ["id"], "predict")
    found = {r["feature"]: r["importance"] for r in table.collect()}
    assert found["x"] > found["kind"] > 0 and abs(found["noise"]) < found["kind"] / 20


def test_unread_feature_is_exactly_zero(rows):
    table = permutation_importance(lambda df: df.withColumn("p", 20 + 3 * F.col("x")), rows, "y", ["x", "noise"], ["id"], "p")
    found = {r["feature"]: r["importance"] for r in table.collect()}
    assert found["noise"] == 0.0 and found["x"] > 0


def test_odd_rows(spark, rows):
    predict = lambda df: df.withColumn("prediction", F.col("x"))
    assert permutation_importance(predict, rows.limit(0), "y", ["x"], ["id"]).count() == 0
    odd = spark.createDataFrame([(None, 1.0, 1.0), (None, 1.0, 1.0), (1, None, 2.0), (2, 3.0, None)], "id int, x double, y double")
    table = permutation_importance(predict, odd, "y", ["x"], ["id"]).collect()
    assert [(r["feature"], r["scored"] + r["unscored"]) for r in table] == [("x", 4)]


def test_large_tables_are_permuted_without_cut_lists(spark, splitting):
    rows = spark.range(200).select("id", (F.col("id") * 3).alias("v"), F.lit(1.0).alias("y"))
    other = permuted(rows, ["v"], ["id"], "__other")
    assert "lambda" not in other._jdf.queryExecution().optimizedPlan().toString()
    taken = other.select("id", "v", "__other.v").collect()
    assert sorted(r[2] for r in taken) == sorted(r[1] for r in taken) and len(taken) == 200
