"""Evaluation tables of logged predictions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pacegrid.operators.quantiles import summaries
from pacegrid.operators.stats import histogram_by_group, squared_log_error

#: Groups of one density table.
MOST_GROUPS = 256


def evaluation_report(log: DataFrame, actual: str, predicted: str, group: str = "model") -> DataFrame:
    """Per model: log error, and the trend of the residual over the fitted value, in one pass."""
    residual, fitted = F.col(actual) - F.col(predicted), F.col(predicted)
    error = squared_log_error(F.col(actual), fitted)
    return log.groupBy(group).agg(
        F.sqrt(F.avg(error)).alias("rmsle"),
        F.count(error).alias("scored"),
        F.count_if(error.isNull()).alias("unscored"),
        F.regr_slope(residual, fitted).alias("slope"),
        F.regr_intercept(residual, fitted).alias("intercept"),
        F.regr_r2(residual, fitted).alias("r2"),
        F.avg(residual).alias("mean_residual"),
    )


def residuals(log: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Difference, actual and fitted value of each prediction."""
    return log.withColumns(
        {"residual": F.col(actual) - F.col(predicted), "actual": F.col(actual), "fitted": F.col(predicted)}
    )


def prediction_density(log: DataFrame, predicted: str, bins: int = 50, group: str = "model") -> DataFrame:
    """How the predictions of each model are distributed over common bins."""
    return histogram_by_group(log, [group], predicted, bins)


def density_curve(log: DataFrame, predicted: str, points: int = 512, group: str = "model") -> DataFrame:
    """``group, point, x, density``: a Gaussian kernel density of each group's values on a grid of its own.

    The bandwidth is 0.9 times the smaller of the deviation and the quartile distance over 1.34, times
    the fifth root of one over the values; where both are nothing, the value itself counts, or one. The
    grid goes three bandwidths beyond the values. Each value is shared between its two grid points, so
    the kernel is only worked out from grid to grid. Missing values are left out, and so are groups
    without any other.
    """
    value = F.when(~F.isnan(F.col(predicted).cast("double")), F.col(predicted).cast("double"))
    rows = log.select(F.col(group).alias("__g"), value.alias("__v")).where("__v IS NOT NULL")
    spread = rows.groupBy("__g").agg(F.count("__v"), F.stddev_samp("__v"), F.min("__v"), F.max("__v"))
    found = spread.orderBy("__g").limit(MOST_GROUPS + 1).collect()
    if len(found) > MOST_GROUPS:
        raise ValueError(f"{group} has more than {MOST_GROUPS} values")
    of = [F.when(F.col("__g").eqNullSafe(F.lit(g)), F.col("__v")).alias(f"g{i}") for i, (g, *_) in enumerate(found)]
    quartiles = summaries(rows.select(*of), [f"g{i}" for i in range(len(found))], (0.25, 0.75)) if found else []
    grids = []
    for (g, n, deviation, low, high), (_, (q1, q3)) in zip(found, quartiles):
        deviation = deviation or 0.0
        narrow = min(deviation, (q3 - q1) / 1.34) or deviation or abs(low) or 1.0
        width = 0.9 * narrow * n**-0.2
        grids.append((g, n, width, low - 3 * width, (high - low + 6 * width) / (points - 1)))
    kind = log.schema[group].dataType.simpleString()
    grid = log.sparkSession.createDataFrame(grids, f"__g {kind}, n long, width double, low double, step double")
    # one row per group, as just counted
    placed = rows.join(F.broadcast(grid), F.col("__v").isNotNull() & rows["__g"].eqNullSafe(grid["__g"])).select(grid["__g"], ((F.col("__v") - F.col("low")) / F.col("step")).alias("at"))
    left = F.least(F.floor("at"), F.lit(points - 2)).cast("int")
    halves = F.array(F.struct(left.alias("j"), (1 - (F.col("at") - left)).alias("w")), F.struct((left + 1).alias("j"), (F.col("at") - left).alias("w")))
    bins = placed.select("__g", F.inline(halves)).groupBy("__g", "j").agg(F.sum("w").alias("w"))
    every = grid.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    bins = bins.select(F.col("__g").alias("__k"), "j", "w")
    away = (F.col("point") - F.col("j")) * F.col("step") / F.col("width")
    # at most `points` rows a group on either side
    kernel = F.sum(F.col("w") * F.exp(-away * away / 2)) / (F.first("n") * F.first("width") * math.sqrt(2 * math.pi))
    met = every.join(F.broadcast(bins), every["__g"].eqNullSafe(bins["__k"]))
    x = F.first(F.col("low") + F.col("point") * F.col("step"))
    return met.groupBy("__g", "point").agg(x.alias("x"), kernel.alias("density")).withColumnRenamed("__g", group)
