"""Fits against closed forms and simple baselines."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pacegrid.operators import stats
from pacegrid.operators.targets import ordered_target
from pacegrid.plans import models as M
from pacegrid.plans import report


@pytest.fixture(scope="module")
def table(spark):
    n = F.col("id")
    x, z = (n * 37 % 101).cast("double"), (n * 53 % 17).cast("double")
    kind = F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (n % 3 + 1).cast("int"))
    y = 20 + 3 * x - 0.5 * z + F.when(kind == "b", 10.0).otherwise(0.0) + (n * 7919 % 13).cast("double") / 10
    return spark.range(400).select("id", x.alias("x"), z.alias("z"), kind.alias("kind"), y.alias("y")).cache()


def test_line_equals_least_squares(spark, table):
    model = M.fit_linear(table, "y", ["x", "z", "kind"])
    terms = {r["term"]: r for r in M.linear_summary(model, table).collect()}
    rows = table.collect()
    design = np.array([[r["x"], r["z"], r["kind"] == "b", r["kind"] == "c", 1.0] for r in rows], dtype=float)
    target = np.array([r["y"] for r in rows])
    solved = np.linalg.lstsq(design, target, rcond=None)[0]
    ours = [terms["x"], terms["z"], terms["kind_b"], terms["kind_c"], terms["(Intercept)"]]
    assert np.allclose([t["estimate"] for t in ours], solved, atol=1e-6)
    noise = ((target - design @ solved) ** 2).sum() / (len(rows) - 5)
    errors = np.sqrt(noise * np.diag(np.linalg.inv(design.T @ design)))
    assert np.allclose([t["std_error"] for t in ours], errors, rtol=1e-5)


def test_rmsle(spark):
    df = spark.createDataFrame([(10.0, 12.0), (5.0, -3.0), (1.0, 1.0)], "label double, prediction double")
    score = M.RmsleEvaluator().evaluate(df)
    expected = np.sqrt(np.mean([np.log(11 / 13) ** 2, np.log(6) ** 2, 0]))
    assert score == pytest.approx(expected)
    grouped = stats.rmsle_by_group(df, [], "label", "prediction").first()
    assert (grouped["scored"], grouped["unscored"]) == (2, 1)


def test_split_is_stable(spark, table):
    first = {r["id"]: r["part"] for r in M.hash_split(table, ["id"], 0.8, "part").collect()}
    again = {r["id"]: r["part"] for r in M.hash_split(table.repartition(5), ["id"], 0.8, "part").collect()}
    assert first == again
    assert 0.7 < sum(p == "train" for p in first.values()) / len(first) < 0.9


def test_leaderboard_trees_and_stack(spark, table):
    marked = M.hash_split(table, ["id"], 0.8, "part")
    train, valid = marked.where("part = 'train'"), marked.where("part = 'valid'")
    score = M.RmsleEvaluator(labelCol="y", predictionCol="predict")
    mean = score.evaluate(valid.withColumn("predict", F.lit(train.agg(F.avg("y")).first()[0])))
    assert len(M.glm_candidates("y")) == 10
    few = {n: c for n, c in M.glm_candidates("y").items() if n in ("gaussian_identity_0.0", "gaussian_log_0.0", "elastic_1.0")}
    board = M.fit_leaderboard(train, valid, "y", ["x"], ["kind"], few)
    scores = [r["rmsle"] for r in board.table.collect()]
    assert len(scores) == 3 and scores == sorted(scores) and scores[0] < mean
    best_id, best = board.best()
    assert best_id == board.table.first()["model_id"]
    trees = M.fit_trees(
        marked.withColumn("held", F.col("part") == "valid"), "y", ["x", "z"], ["kind"], valid="held", maxIter=10
    )
    assert score.evaluate(trees.transform(valid)) < mean
    importance = M.feature_importance(trees, train).collect()
    assert importance[0]["feature"] == "x" and {r["feature"] for r in importance} == {"x", "z", "kind"}
    line = M.fit_linear(train, "y", ["x"])
    stack = M.fit_residual_stack(train, "y", line, ["z"], ["kind"], maxIter=10, maxDepth=3, stepSize=0.3)
    stacked = stack.transform(valid)
    summed = score.copy({score.predictionCol: "stacked_predict"})
    assert summed.evaluate(stacked) < score.evaluate(stacked)


def test_missing_and_unseen_values(spark, table):
    gaps = table.withColumn("x", F.when(F.col("id") % 5 > 0, F.col("x")))
    trees = M.fit_trees(gaps, "y", ["x", "z"], ["kind"], maxIter=3)
    other = spark.createDataFrame([(None, 1.0, "never seen")], "x double, z double, kind string")
    assert trees.transform(other).first()["predict"] is not None


def test_indexed_categories_are_few(spark, table):
    with pytest.raises(ValueError, match="more than"):
        M.fit_trees(table.withColumn("name", F.col("id").cast("string")), "y", ["x"], ["name"], maxIter=1)


def test_codes_of_noise_say_nothing_about_held_out_rows(spark):
    """500 categories of 4 rows whose label is chance: no fold's code may know the label."""
    n = F.col("id")
    noise = (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0).alias("y")
    df = spark.range(2000).select("id", F.concat(F.lit("c"), n % 500).alias("c"), noise)
    df = M.hash_split(df, ["id"], 0.8, "part")
    coded = M.target_folds(df, "c", "y", "code", F.col("part") == "train", ["id"]).cache()
    for part in ("train", "valid"):
        assert abs(coded.where(F.col("part") == part).agg(F.corr("code", "y")).first()[0]) < 0.12
    assert coded.count() == 2000 and coded.where("code IS NULL").isEmpty()


def test_running_codes_of_noise_say_nothing(spark):
    """As above for the running mean, with one category on half the rows, cut or not."""
    n = F.col("id")
    noise = (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0).alias("y")
    df = spark.range(2000).select("id", F.concat(F.lit("c"), F.when(n % 2 == 0, 0).otherwise(n % 500)).alias("c"), noise)
    df = M.hash_split(df, ["id"], 0.8, "part")
    coded = ordered_target(df, "c", "y", "code", F.col("part") == "train", ["id"]).cache()
    for part in ("train", "valid"):
        assert abs(coded.where(F.col("part") == part).agg(F.corr("code", "y")).first()[0]) < 0.12
    assert coded.count() == 2000 and coded.where("code IS NULL").isEmpty() and coded.columns == [*df.columns, "code"]


def test_running_codes(spark):
    rows = [(1, "a", 1.0, True), (2, "a", 3.0, True), (3, "a", None, True), (4, "b", 9.0, False), (5, "a", 7.0, False), (6, None, 5.0, True), (7, None, 1.0, True), (8, "a", float("nan"), True)]
    df = spark.createDataFrame(rows, "id int, c string, y double, fit boolean")
    got = {r["id"]: r["code"] for r in ordered_target(df, "c", "y", "code", F.col("fit"), ["id"], smoothing=0.0).collect()}
    overall = 2.5
    order = sorted([1, 2, 6, 7], key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    labels = {1: 1.0, 2: 3.0, 6: 5.0, 7: 1.0}
    for group in ((1, 2), (6, 7)):
        first, second = sorted(group, key=order.index)
        assert got[first] == pytest.approx(overall) and got[second] == pytest.approx(labels[first])
    assert got[3] == got[5] == got[8] == pytest.approx(2) and got[4] == pytest.approx(overall)
    assert ordered_target(df.limit(0), "c", "y", "code", F.col("fit"), ["id"]).count() == 0


def test_target_codes(spark):
    rows = [(1, "a", 1.0, True), (2, "a", 3.0, True), (3, "a", None, True), (4, "b", 9.0, False), (5, "a", 7.0, False), (6, None, 5.0, True)]
    df = spark.createDataFrame(rows, "id int, c string, y double, fit boolean")
    got = {r["id"]: r["code"] for r in M.target_folds(df, "c", "y", "code", F.col("fit"), ["id"], smoothing=0.0, folds=1000).collect()}
    assert got[1] == pytest.approx(3) and got[2] == pytest.approx(1)
    assert got[5] == got[3] == pytest.approx(2) and got[4] == pytest.approx(3) and got[6] == pytest.approx(3)


def test_unlabelled_rows_change_no_model(spark, table):
    more = table.unionByName(table.limit(20).withColumn("y", F.lit(None).cast("double")))
    few = {n: c for n, c in M.glm_candidates("y").items() if n == "gaussian_identity_0.0"}
    scores = [M.fit_leaderboard(df, more, "y", ["x"], ["kind"], few).table.first() for df in (table, more)]
    assert scores[0]["rmsle"] == pytest.approx(scores[1]["rmsle"]) and scores[0]["unscored"] >= 20


def test_save_and_load(spark, table, tmp_path):
    model = M.fit_trees(table, "y", ["x"], ["kind"], maxIter=2)
    M.save_model(model, str(tmp_path / "m"))
    loaded = M.load_model(str(tmp_path / "m"))
    assert loaded.transform(table).agg(F.sum("predict")).first() == model.transform(table).agg(F.sum("predict")).first()


def test_grid_and_report(spark, table):
    assert len(M.parameter_grid(**M.SEARCH_GRID)) == 36
    log = M.prediction_log(
        {"close": table.select("y", (F.col("y") + 1).alias("p")), "far": table.select("y", (F.col("y") * 2).alias("p"))}
    )
    rows = {r["model"]: r for r in report.evaluation_report(log, "y", "p").collect()}
    assert rows["close"]["rmsle"] < rows["far"]["rmsle"]
    assert rows["close"]["mean_residual"] == pytest.approx(-1)
    assert rows["far"]["slope"] == pytest.approx(-0.5)
    density = report.prediction_density(log, "p", 10)
    assert density.agg(F.sum("rows")).first()[0] == 800
    assert report.residuals(log, "y", "p").where("model = 'close' and abs(residual + 1) > 1e-9").count() == 0
