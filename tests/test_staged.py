"""One fit for all numbers of rounds, the best round, models by id, and a search that goes on."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from pacegrid.plans import models as M
from pacegrid.plans import staged
from pacegrid.plans.registry import Entry, Registry

GRID = M.parameter_grid(maxIter=(1, 2, 4), maxDepth=(2, 3), stepSize=(0.1, 0.3))


@pytest.fixture(scope="module")
def halves(spark):
    n = F.col("id")
    x, z = (n * 37 % 101).cast("double"), (n * 53 % 17).cast("double")
    kind = F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (n % 3 + 1).cast("int"))
    y = 20 + 3 * x - 0.5 * z + F.when(kind == "b", 10.0).otherwise(0.0) + (n * 7919 % 130).cast("double")
    df = spark.range(300).select("id", x.alias("x"), z.alias("z"), kind.alias("kind"), y.alias("y"))
    df = M.hash_split(df, ["id"], 0.8, "part").cache()
    return df.where("part = 'train'"), df.where("part = 'valid'")


@pytest.fixture(scope="module")
def board(halves):
    return staged.search(*halves, "y", ["x", "z"], ["kind"], GRID)


def rmsle(model, df, prediction="prediction"):
    return M.RmsleEvaluator(labelCol="y", predictionCol=prediction).evaluate(model.transform(df))


def test_staged_scores_are_those_of_shorter_models(halves, board):
    train, valid = halves
    table = {r["model_id"]: r for r in board.table.collect()}
    assert set(table) == {M.point_name(p) for p in GRID} == set(board.models)
    for point in (GRID[1], GRID[6], GRID[-1]):
        name = M.point_name(point)
        alone = M.fit_trees(train, "y", ["x", "z"], ["kind"], prediction="prediction", **point)
        assert rmsle(alone, valid) == pytest.approx(table[name]["rmsle"], rel=1e-12)
        assert rmsle(board.models[name], valid) == pytest.approx(table[name]["rmsle"], rel=1e-12)
        assert len(board.models[name].stages[-1].trees) == point["maxIter"]
    assert [r["rmsle"] for r in board.table.collect()] == sorted(r["rmsle"] for r in table.values())
    best_id, best = board.best()
    assert rmsle(board.refit(best_id, train), valid) == pytest.approx(rmsle(best, valid), rel=1e-12)


def test_best_round():
    assert staged.best_round([3.0, 2.0, 2.0, 5.0]) == 2
    assert staged.best_round([3.0, 4.0, 4.0, 1.0]) == 4
    assert staged.best_round([3.0, 4.0, 4.0, 1.0], patience=2) == 1
    assert staged.best_round([3.0, 4.0, 2.0, 4.0, 1.0], patience=2) == 5
    assert staged.best_round([None, 2.0, None]) == 2 and staged.best_round([None, None]) == 2


def test_ensemble_is_cut_at_the_least_of_its_curve(halves, tmp_path):
    train, valid = halves
    model, curve = staged.fit_best_round(train, valid, "y", ["x", "z"], ["kind"], maxIter=12, maxDepth=5, stepSize=0.9)
    scores = [r["rmsle"] for r in curve.orderBy("round").collect()]
    kept = len(model.stages[-1].trees)
    assert len(scores) == 12 and kept == scores.index(min(scores)) + 1 < 12
    assert rmsle(model, valid, "predict") == pytest.approx(min(scores), rel=1e-12)
    M.save_model(model, str(tmp_path / "cut"))
    assert rmsle(M.load_model(str(tmp_path / "cut")), valid, "predict") == pytest.approx(min(scores), rel=1e-12)


def test_curve_without_rows_or_labels(halves):
    train, valid = halves
    nothing = valid.withColumn("y", F.lit(None).cast("double"))
    model, curve = staged.fit_best_round(train, nothing, "y", ["x"], maxIter=2, maxDepth=2)
    rows = curve.collect()
    assert all(r["rmsle"] is None and r["unscored"] == nothing.count() for r in rows) and len(rows) == 2
    model, curve = staged.fit_best_round(train, valid.limit(0), "y", ["x"], maxIter=2, maxDepth=2)
    assert curve.count() == 0 and len(model.stages[-1].trees) == 2


def test_stopped_search_goes_on(spark, halves, board, tmp_path, monkeypatch):
    """The third fit breaks; the next search fits only what is missing, and ends with the same table."""
    registry, fits, whole = Registry(spark, str(tmp_path / "r")), [], M.tree_estimator

    def breaking(*args, **settings):
        if len(fits) == 2:
            raise RuntimeError("stopped")
        fits.append(settings)
        return whole(*args, **settings)

    monkeypatch.setattr(staged, "AT_ONCE", 1)
    monkeypatch.setattr(M, "tree_estimator", breaking)
    with pytest.raises(RuntimeError, match="stopped"):
        staged.search(*halves, "y", ["x", "z"], ["kind"], GRID, registry)
    assert registry.table().count() == 6
    monkeypatch.setattr(M, "tree_estimator", lambda *a, **k: fits.append(k) or whole(*a, **k))
    again = staged.search(*halves, "y", ["x", "z"], ["kind"], GRID, registry)
    assert len(fits) == 4
    expected = [tuple(r) for r in board.table.collect()]
    assert [(r[0], pytest.approx(r[1], rel=1e-12), *r[2:]) for r in expected] == [tuple(r) for r in again.table.collect()]
    best_id, best = again.best()
    assert rmsle(best, halves[1]) == pytest.approx(rmsle(board.models[best_id], halves[1]), rel=1e-12)


def test_models_by_id_in_another_session(spark, halves, board, tmp_path):
    """Two writers at once; an id written twice means the later; an unfinished part is not read."""
    folder = str(tmp_path / "models")
    assert Registry(spark, folder).table().count() == 0
    rows = board.table.collect()
    entries = [Entry(r["model_id"], board.models[r["model_id"]], r["rmsle"], r["unscored"], r["params"]) for r in rows]
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(Registry(spark, folder).add, (entries[:2], entries[2:4])))
    (tmp_path / "models" / "manifest" / "half").mkdir()
    other = Registry(spark.newSession(), folder)
    assert [r["model_id"] for r in other.table().collect()] == [e.model_id for e in entries[:4]]
    valid = halves[1]
    for e in entries[:2]:
        fetched = other.fetch(e.model_id)
        assert fetched.transform(valid).select("id", "prediction").collect() == e.model.transform(valid).select("id", "prediction").collect()
    other.add([Entry(entries[0].model_id, board.models[entries[0].model_id], 99.0)])
    assert [r["score"] for r in Registry(spark, folder).table().collect()][-1] == 99.0
    assert set(other.fetch_all()) == {e.model_id for e in entries[:4]}
    with pytest.raises(KeyError):
        other.fetch("no such model")
