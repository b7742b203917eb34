"""Trees fitted in one task are those of GBTRegressor, and the search runs its published rounds."""

import pytest
from pyspark.sql import functions as F

from pacegrid.plans import binned, staged
from pacegrid.plans import models as M
from pacegrid.queries import models, racing

SETTINGS = dict(maxIter=6, maxDepth=4, stepSize=0.3)


@pytest.fixture(scope="module")
def table(spark):
    n = F.col("id")
    number = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(10007)) / 100
    kind = F.element_at(F.array(*[F.lit(c) for c in "abcdefg"]), (1 + n % 7).cast("int"))
    df = spark.range(2000).select("id", number(1).alias("x"), F.when(n % 9 > 0, number(2)).alias("z"), F.when(n % 11 > 0, kind).alias("kind"))
    y = 20 + 2 * F.col("x") + F.coalesce(F.col("z"), F.lit(70)) * F.when(F.col("kind") == "c", 2).otherwise(1) + number(3) / 10
    return df.withColumn("y", F.when(n % 97 > 0, y))


def rows_of(df):
    known = df.where("y IS NOT NULL")
    stages = staged._fitted_stages(known, ["x", "z"], ["kind"])
    return M.tree_rows(stages, known, "y"), staged.held_rows(stages, df, "y")


def shapes(model):
    return [tree.numNodes for tree in model.trees], list(model.treeWeights), model.numFeatures


@pytest.mark.parametrize("merged", [False, True])
def test_trees_and_scores_are_those_of_spark(table, monkeypatch, merged):
    if merged:
        monkeypatch.setattr(M, "MERGE_ROWS", 10)
        table = table.withColumns({c: F.round(F.col(c) / 20) for c in ("x", "z")})
    (ready, found), held = rows_of(table)
    assert found == merged

    def trees():
        estimator = M.tree_estimator("y", "predict", **SETTINGS)
        return estimator.setWeightCol(M.WEIGHT) if merged else estimator

    spark_fit, rows = trees().fit(ready), binned.Rows(ready, held)
    fit = rows.fit(trees())
    own = fit.model()
    assert shapes(own) == shapes(spark_fit)
    both = [[r["predict"] for r in m.transform(held).collect()] for m in (own, spark_fit)]
    assert both[0] == pytest.approx(both[1], rel=1e-9)
    assert [len(fit.model(k).trees) for k in (1, 4)] == [1, 4]
    curve = {r["round"]: (r["rmsle"], r["unscored"]) for r in staged.curve(spark_fit, held, "y").collect()}
    scores = rows.scores(fit, "y")
    assert set(scores) == set(curve) and all(scores[k][1] == curve[k][1] == 21 for k in curve)
    assert [scores[k][0] for k in curve] == pytest.approx([curve[k][0] for k in curve], rel=1e-9)


def test_only_what_a_task_holds_is_fitted_there(table, monkeypatch):
    (ready, merged), _ = rows_of(table)
    used, whole = [], binned.Rows.fit
    monkeypatch.setattr(binned.Rows, "fit", lambda self, *a: used.append(1) or whole(self, *a))
    small = M.fit_in_task(M.tree_estimator("y", "predict", **SETTINGS), ready, merged)
    monkeypatch.setattr(binned, "TASK_BYTES", 1000)
    large = M.fit_in_task(M.tree_estimator("y", "predict", **SETTINGS), ready, merged)
    assert used == [1] and shapes(small) == shapes(large)
    assert not binned.knows(M.tree_estimator("y", "predict").setSubsamplingRate(0.5))


def test_the_search_has_the_published_rounds():
    for shape in (models.SEARCH_SHAPE, racing.SEARCH_SHAPE):
        assert len(shape) == 36 and {p["maxIter"] for p in shape} == {500, 1000, 3000}
        assert {p["maxDepth"] for p in shape} == {4, 6, 8} and {p["stepSize"] for p in shape} == {0.01, 0.03, 0.1, 0.3}


def test_a_search_of_many_rounds(table, monkeypatch):
    """Rounds as many as published, in one task; on the cluster they are scored block by block."""
    train, valid = table.where("id % 5 > 0"), table.where("id % 5 = 0")
    grid = M.parameter_grid(maxIter=(500, 3000), maxDepth=(2,), stepSize=(0.1,))
    table = {r["model_id"]: r for r in staged.search(train, valid, "y", ["x", "z"], ["kind"], grid).table.collect()}
    assert len(table) == 2 and all(r["rmsle"] < 0.05 and r["unscored"] == 5 for r in table.values())
    grid = M.parameter_grid(maxIter=(3, 7), maxDepth=(2,), stepSize=(0.1,))
    one_task = staged.search(train, valid, "y", ["x", "z"], ["kind"], grid).table.collect()
    monkeypatch.setattr(binned, "TASK_BYTES", 0)
    monkeypatch.setattr(staged, "BLOCK", 2)
    spread = staged.search(train, valid, "y", ["x", "z"], ["kind"], grid).table.collect()
    assert [r["model_id"] for r in spread] == [r["model_id"] for r in one_task]
    assert [r["rmsle"] for r in spread] == pytest.approx([r["rmsle"] for r in one_task], rel=1e-9)
