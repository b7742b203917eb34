"""Splits, grids, scores and fits on ``pyspark.ml``."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import product

from pyspark import keyword_only
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import Imputer, OneHotEncoder, RFormula, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.param.shared import HasLabelCol, HasPredictionCol
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pacegrid.operators.joins import lookup_join
from pacegrid.operators.ordered import global_ordinal
from pacegrid.operators.quantiles import basics, order_statistics, summaries
from pacegrid.operators.sets import tagged_union
from pacegrid.operators.stats import rmsle_by_group, squared_log_error
from pacegrid.plans import binned
from pacegrid.session import Size, settle, settle_sized, shared_dir

# The seed of the tree models, the search grid of the published runs, the mark of a missing number.
TREE_SEED = 55
SEARCH_GRID = {"maxIter": (500, 1000, 3000), "maxDepth": (4, 6, 8), "stepSize": (0.01, 0.1, 0.03, 0.3)}
MISSING_LOW = -999
MAX_CATEGORIES = 64
MAX_BINS = 2 * MAX_CATEGORIES
#: Independent fits that run at the same time.
AT_ONCE = 4
#: Tables beyond this are looked through for rows of equal features before a tree fit.
MERGE_ROWS = 100_000
#: Rows of a fit that one task holds.
TASK_ROWS = 1_000_000
WEIGHT = "__weight"


def hash_split(df: DataFrame, keys: Sequence[str], share: float, out: str) -> DataFrame:
    """Mark rows train or valid by a hash of their key: the same row lands the same way in every run."""
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    bucket = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % 100
    return df.withColumn(out, F.when(bucket < round(share * 100), "train").otherwise("valid"))


def exact_split(df: DataFrame, keys: Sequence[str], share: float, out: str) -> DataFrame:
    """Mark exactly ``floor(share * rows + 0.5)`` rows train, those of the smallest key hashes, the rest valid.

    The hash that parts them is found by counting (see ``quantiles``), so no rows are sorted. Rows that
    share it are told apart by their keys; rows of equal keys by chance.
    """
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    # 52 bits, which a double holds exactly
    df = df.withColumn("__hash", F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double"))
    hashes = df.select(F.col("__hash").alias("c0"))
    facts = basics(hashes)
    wanted = math.floor(share * facts[0].known + 0.5)
    if not 0 < wanted < facts[0].known:
        return df.withColumn(out, F.lit("train" if wanted else "valid")).drop("__hash")
    last = order_statistics(hashes, facts, {0: [wanted - 1]})[0, wanted - 1]
    below, same = hashes.agg(F.count_if(F.col("c0") < last), F.count_if(F.col("c0") == last)).first()
    if below + same == wanted:
        return df.withColumn(out, F.when(F.col("__hash") <= last, "train").otherwise("valid")).drop("__hash")
    tied = global_ordinal(df.where(F.col("__hash") == last), list(keys), "__n")
    tied = tied.withColumn(out, F.when(F.col("__n") <= wanted - below, "train").otherwise("valid")).drop("__n")
    rest = df.where(F.col("__hash") != last).withColumn(out, F.when(F.col("__hash") < last, "train").otherwise("valid"))
    return rest.unionByName(tied).drop("__hash")


def parameter_grid(**values: Sequence) -> list[dict]:
    """All combinations of the given parameter values."""
    return [dict(zip(values, point)) for point in product(*values.values())]


def prediction_log(by_model: Mapping[str, DataFrame]) -> DataFrame:
    """Predictions of several models in one frame, each row marked with its model."""
    return tagged_union(by_model, "model")


class RmsleEvaluator(Evaluator, HasLabelCol, HasPredictionCol):
    """Root mean squared log error; smaller is better. Predictions below zero count as zero."""

    @keyword_only
    def __init__(self, labelCol: str = "label", predictionCol: str = "prediction"):
        super().__init__()
        self._set(labelCol=labelCol, predictionCol=predictionCol)

    def _evaluate(self, dataset: DataFrame) -> float:
        predicted = F.greatest(F.col(self.getPredictionCol()), F.lit(0.0))
        scored = dataset.withColumn("__p", predicted)
        return rmsle_by_group(scored, [], self.getLabelCol(), "__p").first()["rmsle"]

    def isLargerBetter(self) -> bool:
        return False


def check_categories(df: DataFrame, categorical: Sequence[str], most: int = MAX_CATEGORIES) -> None:
    """Raise where a column has more values than can be coded one by one on the driver."""
    for c in categorical:
        if df.select(c).distinct().limit(most + 1).count() > most:
            raise ValueError(f"{c} has more than {most} values: encode it by target_folds, or leave it out")


def target_folds(
    df: DataFrame, category: str, label: str, out: str, fitted: Column, keys: Sequence[str],
    smoothing: float = 20.0, folds: int = 5,
) -> DataFrame:
    """Mean label of the row's category in the rows where ``fitted`` holds.

    A fitted row's own code comes from the other folds only, so no row sees its own label; other rows
    use all fitted ones. Unseen categories take the overall mean.
    """
    number = F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in keys]), F.lit(folds)).cast("int")
    df = df.withColumn("__fold", F.when(fitted & F.col(label).isNotNull(), number).otherwise(F.lit(-1)))
    rows = df.where(F.col("__fold") >= 0)
    own = rows.groupBy(category, "__fold").agg(F.sum(label).alias("s"), F.count(label).alias("n"))
    overall = rows.agg(F.avg(label)).scalar()
    sums = own.groupBy(category).agg(
        F.sum("s").alias("all_s"), F.sum("n").alias("all_n"), F.map_from_entries(F.collect_list(F.struct("__fold", F.struct("s", "n")))).alias("by")
    )
    every = F.explode(F.array(*[F.lit(f) for f in range(-1, folds)])).alias("__fold")
    sums = sums.select(category, "all_s", "all_n", "by", every).withColumn("mine", F.try_element_at("by", F.col("__fold")))
    s = F.col("all_s") - F.coalesce(F.col("mine.s"), F.lit(0.0))
    n = F.col("all_n") - F.coalesce(F.col("mine.n"), F.lit(0))
    code = F.try_divide(s + F.lit(smoothing) * overall, n + F.lit(smoothing))
    joined = lookup_join(df, settle(sums.select(category, "__fold", code.alias(out))), [category, "__fold"])
    return joined.withColumn(out, F.coalesce(F.col(out), overall)).drop("__fold")


def feature_stages(
    numeric: Sequence[str], categorical: Sequence[str], missing: str = "low", one_hot: bool = False
) -> list:
    """Index the categories, unseen values getting a code of their own, and assemble one vector.

    ``one_hot`` gives each value a column, as linear models need: a code's size means nothing. Missing numbers take the column's mean (``"mean"``, for linear models) or a value below all others
    (``"low"``, for trees).
    """
    stages, numbers, codes = [], [f"{c}_CODE" for c in numeric], [f"{c}_CODE" for c in categorical]
    if categorical:
        stages.append(StringIndexer(inputCols=list(categorical), outputCols=codes, handleInvalid="keep"))
        if one_hot:
            hot = [f"{c}_HOT" for c in codes]
            stages.append(OneHotEncoder(inputCols=codes, outputCols=hot, handleInvalid="keep"))
            codes = hot
    if not numeric:
        numbers = []
    elif missing == "mean":
        stages.append(Imputer(inputCols=list(numeric), outputCols=numbers, strategy="mean"))
    else:
        known = [f"coalesce(CASE WHEN NOT isnan(`{c}`) THEN `{c}` END, {MISSING_LOW}) AS `{c}_CODE`" for c in numeric]
        stages.append(SQLTransformer(statement=f"SELECT *, {', '.join(known)} FROM __THIS__"))
    return [*stages, VectorAssembler(inputCols=[*numbers, *codes], outputCol="features")]


def fit_linear(df: DataFrame, label: str, predictors: Sequence[str], prediction: str = "predict") -> PipelineModel:
    """Least squares with categories against their first level; rows with a missing value are left out."""
    formula = RFormula(
        formula=f"{label} ~ {' + '.join(predictors)}",
        stringIndexerOrderType="alphabetDesc",
        handleInvalid="skip",
        featuresCol="__x",
        labelCol="__y",
    )
    line = LinearRegression(featuresCol="__x", labelCol="__y", predictionCol=prediction, solver="normal")
    known = df.dropna(subset=[label, *predictors])
    texts = [c for c in predictors if known.schema[c].dataType.simpleString() == "string"]
    check_categories(known, texts)
    return Pipeline(stages=[formula, line]).fit(settle(known.select(label, *predictors)))


def linear_summary(model: PipelineModel, fitted_on: DataFrame) -> DataFrame:
    """Term, estimate, standard error, t and p of a fitted linear model (the intercept last)."""
    line = model.stages[-1]
    names = _vector_names(model.transform(fitted_on.limit(0)), "__x")
    summary = line.summary
    rows = zip(
        [*names, "(Intercept)"],
        [*(float(v) for v in line.coefficients), float(line.intercept)],
        summary.coefficientStandardErrors,
        summary.tValues,
        summary.pValues,
    )
    kinds = "term string, estimate double, std_error double, t_value double, p_value double"
    return fitted_on.sparkSession.createDataFrame(list(rows), kinds)


def fit_summary(model: PipelineModel, fitted_on: DataFrame, label: str, prediction: str = "predict") -> DataFrame:
    """One row on a fitted linear model: residual quartiles, residual error, R2, adjusted R2, F and degrees of freedom.

    Rows with a missing predictor or label, which the fit left out, count nowhere.
    """
    scored = model.transform(fitted_on.where(F.col(label).isNotNull()))
    scored = scored.withColumn("__r", F.col(label) - F.col(prediction)).where(~F.isnan("__r") & F.col("__r").isNotNull())
    (spread, (q1, median, q3)), = summaries(scored, ["__r"], (0.25, 0.5, 0.75))
    n, unexplained, total = scored.agg(F.count("__r"), F.sum(F.col("__r") ** 2), F.var_pop(label) * F.count("__r")).first()
    terms = model.stages[-1].coefficients.size
    free = n - terms - 1
    r2 = 1 - unexplained / total if total else None
    adjusted = 1 - (1 - r2) * (n - 1) / free if r2 is not None and free > 0 else None
    ratio = (r2 / terms) / ((1 - r2) / free) if r2 is not None and r2 < 1 and free > 0 else None
    error = math.sqrt(unexplained / free) if unexplained is not None and free > 0 else None
    row = (spread.minimum, q1, median, q3, spread.maximum, error, r2, adjusted, ratio, terms, free)
    kinds = ", ".join(f"{c} double" for c in ("min", "q1", "median", "q3", "max", "residual_error", "r2", "adjusted_r2", "f_value"))
    return fitted_on.sparkSession.createDataFrame([row], f"{kinds}, terms bigint, free bigint")


def _vector_names(df: DataFrame, column: str) -> list[str]:
    attributes = df.schema[column].metadata["ml_attr"]["attrs"]
    flat = [a for kind in attributes.values() for a in kind]
    return [a["name"] for a in sorted(flat, key=lambda a: a["idx"])]


def glm_candidates(label: str, prediction: str = "prediction") -> dict[str, object]:
    """Ten linear models: Gaussian and gamma, identity and log link, several penalties."""
    common = dict(labelCol=label, featuresCol="features", predictionCol=prediction)
    models: dict[str, object] = {}
    for penalty in (0.0, 0.01, 0.1):
        for link in ("identity", "log"):
            name = f"gaussian_{link}_{penalty}"
            models[name] = GeneralizedLinearRegression(family="gaussian", link=link, regParam=penalty, **common)
    for mix in (0.5, 1.0):
        models[f"elastic_{mix}"] = LinearRegression(regParam=0.1, elasticNetParam=mix, **common)
    for penalty in (0.0, 0.1):
        models[f"gamma_log_{penalty}"] = GeneralizedLinearRegression(
            family="gamma", link="log", regParam=penalty, **common
        )
    return models


@dataclass
class Leaderboard:
    """Scores best first, the fitted models by id, and how to fit one of them on other rows."""

    table: DataFrame
    models: Mapping[str, PipelineModel]
    refit: Callable[[str, DataFrame], PipelineModel]

    def best_id(self) -> str:
        return self.table.first()["model_id"]

    def best(self) -> tuple[str, PipelineModel]:
        model_id = self.best_id()
        return model_id, self.models[model_id]


def fit_leaderboard(
    train: DataFrame,
    valid: DataFrame,
    label: str,
    numeric: Sequence[str],
    categorical: Sequence[str] = (),
    candidates: Mapping[str, object] | None = None,
    linear: bool | None = None,
) -> Leaderboard:
    """Fit every candidate on assembled features and rank by log error on the validation rows.

    Rows without a label are left out of the fits; in the scores they, and rows without a log error,
    count as unscored. Independent fits run side by side, all candidates are scored in one pass.
    ``linear`` says whether missing numbers and categories are coded as linear models need.
    """
    shared_dir(train.sparkSession)
    linear = candidates is None if linear is None else linear
    candidates = glm_candidates(label) if candidates is None else candidates
    check_categories(train, categorical)
    plan = feature_stages(numeric, categorical, "mean" if linear else "low", one_hot=linear)

    def assembled(df: DataFrame):
        known = df.where(F.col(label).isNotNull())
        stages = Pipeline(stages=plan).fit(known)
        return stages, settle(stages.transform(known).select(label, "features"))

    stages, ready = assembled(train)

    def refit(model_id: str, df: DataFrame) -> PipelineModel:
        on, rows = assembled(df)
        return PipelineModel([*on.stages, candidates[model_id].fit(rows)])

    with ThreadPoolExecutor(AT_ONCE) as pool:
        fits = list(pool.map(lambda e: e.fit(ready), candidates.values()))
    fitted = {model_id: PipelineModel([*stages.stages, fit]) for model_id, fit in zip(candidates, fits)}
    scored = stages.transform(valid).select(label, "features")
    for i, model in enumerate(fitted.values()):
        scored = model.stages[-1].transform(scored).withColumnRenamed("prediction", f"p{i}")
    errors = [squared_log_error(F.col(label), F.greatest(F.col(f"p{i}"), F.lit(0.0))) for i in range(len(fitted))]
    scores = scored.agg(
        *[F.sqrt(F.avg(e)).alias(f"p{i}") for i, e in enumerate(errors)],
        *[F.count_if(e.isNull()).alias(f"u{i}") for i, e in enumerate(errors)],
    ).first()
    rows = [
        (model_id, scores[f"p{i}"], scores[f"u{i}"], _settings(candidates[model_id]))
        for i, model_id in enumerate(fitted)
    ]
    table = train.sparkSession.createDataFrame(rows, "model_id string, rmsle double, unscored bigint, params string")
    return Leaderboard(table.orderBy(F.asc_nulls_last("rmsle"), "model_id"), fitted, refit)


def _settings(estimator) -> str:
    chosen = {p.name: v for p, v in estimator.extractParamMap().items() if estimator.isSet(p)}
    return ", ".join(f"{k}={chosen[k]}" for k in sorted(chosen) if not k.endswith("Col"))


def tree_estimator(
    label: str, prediction: str, maxIter: int = 20, maxDepth: int = 5, stepSize: float = 0.1
) -> GBTRegressor:
    """Boosted regression trees under squared loss."""
    return GBTRegressor(
        featuresCol="features",
        labelCol=label,
        predictionCol=prediction,
        maxIter=maxIter,
        maxDepth=maxDepth,
        stepSize=stepSize,
        maxBins=MAX_BINS,
        lossType="squared",
        seed=TREE_SEED,
    )


def coded_rows(stages: PipelineModel, df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, list[str], Size, bool]:
    """(``columns`` and codes of all rows, names of the codes, size, whether at least every second row repeats another's codes).

    ``stages`` ends with the assembler. Every fit and score reads these rows, so they are written once.
    """
    codes = stages.stages[-1].getInputCols()
    coded = PipelineModel(stages.stages[:-1]).transform(df).select(*columns, *codes)
    rows, size = settle_sized(coded)
    if size.rows <= MERGE_ROWS:
        return rows, codes, size, False
    return rows, codes, size, 2 * rows.agg(F.approx_count_distinct(F.xxhash64(*codes))).first()[0] <= size.rows


def tree_rows(stages: PipelineModel, df: DataFrame, label: str, valid: str | None = None) -> tuple[DataFrame, bool]:
    """(assembled rows for a tree fit, whether rows of equal features are merged with their number as ``WEIGHT``).

    Under squared loss a merged row with the mean label tells a tree the same: every split's gain and
    every leaf's mean depend on counts and sums of labels only. Rows that decide when to stop become
    two, a deviation below and above their mean, which keeps their squared error as well. Where few
    rows repeat, as with measured features, all stay, and a task holds at most ``TASK_ROWS``.
    Then the tasks come in full rounds of all cores, as every pass of a fit waits for its last task.
    """
    kept = [label, *([valid] if valid else [])]
    rows, codes, size, repeats = coded_rows(stages, df, kept)
    if repeats:
        y = F.col(label).cast("double")
        found = [F.count(F.lit(1)).cast("double").alias("__n"), F.avg(y).alias("__mean"), F.stddev_pop(y).alias("__apart")]
        sums = rows.groupBy(*codes, *kept[1:]).agg(*found)
        one = F.array(F.struct(F.col("__mean").alias(label), F.col("__n").alias(WEIGHT)))
        if valid:
            ends = (F.col("__mean") - F.col("__apart"), F.col("__mean") + F.col("__apart"))
            two = F.array(*[F.struct(y.alias(label), (F.col("__n") / 2).alias(WEIGHT)) for y in ends])
            one = F.when(F.col(valid), two).otherwise(one)
        kept = [*kept, WEIGHT]
        rows, size = settle_sized(sums.select(*codes, *kept[1:-1], F.inline(one)))
        if rows.count() < MAX_BINS:
            # Spark takes no more bins than rows, so few rows are divided
            rows = rows.withColumns({WEIGHT: F.col(WEIGHT) / MAX_BINS, "__copy": F.explode(F.sequence(F.lit(1), F.lit(MAX_BINS)))})
    ready = stages.stages[-1].transform(rows).select(*kept, "features")
    tasks, cores = math.ceil(size.rows / TASK_ROWS), df.sparkSession.sparkContext.defaultParallelism
    # files of small numbers are read in few tasks, however many rows they hold
    return ready if tasks <= cores else ready.repartition(cores * math.ceil(tasks / cores)), repeats


def fit_on(trees: GBTRegressor, ready: DataFrame, merged: bool):
    return (trees.setWeightCol(WEIGHT) if merged else trees).fit(ready)


def fit_in_task(trees: GBTRegressor, ready: DataFrame, merged: bool):
    """Trees fitted in one task where it can hold the rows, else as by ``fit_on``."""
    rows = binned.Rows(ready)
    if not (rows.fit_one_task() and binned.knows(trees)):
        return fit_on(trees, ready, merged)
    return rows.fit(trees.setWeightCol(WEIGHT) if merged else trees).model()


def fit_trees(
    df: DataFrame,
    label: str,
    numeric: Sequence[str],
    categorical: Sequence[str] = (),
    valid: str | None = None,
    prediction: str = "predict",
    in_task: bool = False,
    **settings,
) -> PipelineModel:
    """Fit boosted trees; ``valid`` names a boolean column whose rows only decide when to stop.

    ``in_task`` fits them as a search does, in one task if it can hold the rows: thousands of rounds would
    else be as many jobs for each level. Splits of equal gain may then fall to other features.
    """
    shared_dir(df.sparkSession)
    trees = tree_estimator(label, prediction, **settings)
    if valid:
        trees.setValidationIndicatorCol(valid)
    known = df.where(F.col(label).isNotNull())
    check_categories(known, categorical)
    stages = Pipeline(stages=feature_stages(numeric, categorical)).fit(known)
    fit = fit_in_task if in_task else fit_on
    return PipelineModel([*stages.stages, fit(trees, *tree_rows(stages, known, label, valid))])


def feature_importance(model: PipelineModel, like: DataFrame) -> DataFrame:
    """Features by falling importance in a fitted tree model."""
    assembler, trees = model.stages[-2], model.stages[-1]
    importance = trees.featureImportances.toArray()
    names = [c.removesuffix("_CODE") for c in assembler.getInputCols()]
    rows = [(name, float(v)) for name, v in zip(names, importance)]
    table = like.sparkSession.createDataFrame(rows, "feature string, importance double")
    return table.orderBy(F.desc("importance"), "feature")


@dataclass
class ResidualStack:
    """A linear model and trees on what it leaves over; the prediction is the sum of the two."""

    linear: Transformer
    trees: PipelineModel

    def transform(self, df: DataFrame) -> DataFrame:
        first = self.linear.transform(df)
        second = self.trees.transform(_without_features(first).withColumnRenamed("prediction", "predict"))
        total = F.col("predict") + F.col("residual_predict")
        return _without_features(second).withColumn("stacked_predict", total)


def _without_features(df: DataFrame) -> DataFrame:
    """Drop the columns a fitted model adds on its way to a prediction."""
    return df.drop(*[c for c in df.columns if c in ("features", "__x", "__y") or c.endswith(("_CODE", "_CODE_HOT"))])


def fit_residual_stack(
    train: DataFrame,
    label: str,
    linear: Transformer,
    numeric: Sequence[str],
    categorical: Sequence[str] = (),
    **settings,
) -> ResidualStack:
    """Fit trees on the residuals of an already fitted model, over other features."""
    first = linear.transform(train).withColumnRenamed("prediction", "predict")
    residual = first.withColumn("residual", F.col(label) - F.col("predict"))
    residual = residual.select("residual", *numeric, *categorical)
    trees = fit_trees(residual, "residual", numeric, categorical, prediction="residual_predict", **settings)
    return ResidualStack(linear, trees)


def tree_candidates(label: str, grid: Sequence[Mapping]) -> dict[str, object]:
    """One tree estimator per grid point, for ``fit_leaderboard``."""
    return {
        point_name(point): tree_estimator(label, "prediction", **point)
        for point in grid
    }


def point_name(point: Mapping) -> str:
    return ", ".join(f"{k}={v}" for k, v in point.items())


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
