"""Rows are neither multiplied by the rounds that score them, nor written or predicted more often than needed."""

import pytest
from pyspark.sql import functions as F

from pacegrid.operators import targets
from pacegrid.plans import models as M
from pacegrid.plans import race, staged
from pacegrid.plans.features import CELLS
from pacegrid.plans.laps import SECTORS


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def final(spark):
    n = F.col("id")
    noise = F.pmod(F.xxhash64("id"), F.lit(97)).cast("double")
    numbers = {c: (noise * (i + 1) % 31).alias(c) for i, c in enumerate([*CELLS, *SECTORS])}
    return spark.range(240).select(
        F.when(n % 4 == 0, "TEST").otherwise("TRAIN").alias("tr"), F.concat(F.lit("E"), n % 2).alias("EVENT"), F.concat(F.lit("L"), n % 3).alias("LOCATION"),
        (n % 20).alias("NUMBER"), (1 + n % 6).cast("int").alias("LAP_NUMBER"), (80 + noise / 5).alias("LAP_TIME"),
        F.concat(F.lit("k"), n).alias("LAP_KEY"), *numbers.values(),
    )


def test_rounds_are_scored_without_a_row_for_each(spark):
    n = F.col("id")
    df = spark.range(300).select((n * 37 % 101).cast("double").alias("x"), F.when(n % 50 > 0, 20 + n % 13 + n * 37 % 101).cast("double").alias("y"))
    train, valid = df.where("x < 80"), df.where("x >= 80")
    stages = staged._fitted_stages(train, ["x"], [])
    model = M.fit_on(M.tree_estimator("y", "predict", maxIter=2 * staged.CARRY + 3, maxDepth=2), *M.tree_rows(stages, train.dropna(), "y"))
    points = staged.curve(model, staged.held_rows(stages, valid, "y"), "y")
    assert "explode" not in plan(points)
    held = stages.transform(valid)
    for row in points.collect():
        cut = staged.truncated(model, row["round"]).transform(held)
        assert row["rmsle"] == pytest.approx(M.RmsleEvaluator(labelCol="y", predictionCol="predict").evaluate(cut), rel=1e-12)
        assert row["scored"] + row["unscored"] == held.count() and row["unscored"] == held.where("y IS NULL").count()
    assert points.count() == 2 * staged.CARRY + 3


def test_laps_are_written_once_for_both_fits(final, monkeypatch):
    written, whole = [], race.settle
    for module in (race, targets):
        monkeypatch.setattr(module, "settle", lambda df: written.append(df.columns) or whole(df))
    predicted = race.tree_predictions(final, maxIter=2, maxDepth=2)
    assert not [c for c in written if "predict" in c or "__fitted" in c]
    assert len([c for c in written if "LAP_KEY" in c and "NUMBER_MEAN" not in c]) == 1
    assert predicted.columns == ["LAP_KEY", "LAP_TIME", "predict", "model"]
    assert {(r["model"], r["count"]) for r in predicted.groupBy("model").count().collect()} == {("stopped", 60), ("refitted", 60)}
    assert predicted.where("predict IS NULL").isEmpty()


def test_leader_and_stack_come_from_one_pass(final):
    more = {"GROUP": 0.0, "KPH": 150.0, "POWER": 200.0, "TEAM": "T"}
    predicted = race.residual_predictions(final.withColumns({c: F.lit(v) for c, v in more.items()}), maxIter=2, maxDepth=2)
    assert plan(predicted).count("Relation [") == 2
    counts = {r["model"]: r["count"] for r in predicted.groupBy("model").count().collect()}
    assert len(counts) == 3 and set(counts.values()) == {60} and {"Baseline_LM", "residual"} < set(counts)
