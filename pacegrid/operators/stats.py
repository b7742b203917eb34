"""Profiles, scores, trends, scaling and category codes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pacegrid.functions.numbers import missing
from pacegrid.operators.joins import lookup_join, salted_join
from pacegrid.operators.ordered import Ordered, global_ordinal
from pacegrid.operators.quantiles import summaries
from pacegrid.operators.skew import Profile, large_groups
from pacegrid.session import settle


def _floating(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType))


def session_bounds(df: DataFrame, keys: Sequence[str], clock: str) -> DataFrame:
    bounds = df.groupBy(*keys).agg(F.min(clock).alias("MIN_TIM"), F.max(clock).alias("MAX_TIM"))
    return bounds.withColumn("SESSION_TIME", F.col("MAX_TIM") - F.col("MIN_TIM"))


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing values per column, all columns in one pass."""
    columns = list(columns or df.columns)
    counts = df.agg(*[F.count_if(missing(F.col(c), _floating(df, c))).alias(c) for c in columns])
    return counts.unpivot([], columns, "column", "missing")


def column_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Minimum, exact quartiles (linear interpolation), mean, maximum and missing count per column.

    Quartiles come from rounds of bucket counts, so no values are shuffled or stored.
    """
    found = summaries(df, columns, (0.25, 0.5, 0.75))
    rows = [(c, b.minimum, q1, median, b.mean, q3, b.maximum, b.missing) for c, (b, (q1, median, q3)) in zip(columns, found)]
    kinds = "column string, minimum double, q1 double, median double, mean double, q3 double, maximum double, missing bigint"
    return df.sparkSession.createDataFrame(rows, kinds)


def histogram_by_group(df: DataFrame, keys: Sequence[str], value: str, bins: int) -> DataFrame:
    """Rows per group and equal-width bin over the whole range of the value."""
    span = df.agg(F.struct(F.min(value).alias("low"), F.max(value).alias("high")).alias("s")).scalar()
    spanned = df.where(F.col(value).isNotNull()).withColumn("__s", span)
    low, high = F.col("__s.low"), F.col("__s.high")
    share = F.coalesce(F.try_divide(F.col(value) - low, high - low), F.lit(0.0))
    bucket = F.least(F.floor(share * bins) + 1, F.lit(bins)).cast("int")
    return spanned.groupBy(*keys, bucket.alias("bin")).agg(F.count(F.lit(1)).alias("rows"))


def squared_log_error(actual: Column, predicted: Column) -> Column:
    return F.pow(F.log1p(actual) - F.log1p(predicted), F.lit(2.0))


def rmsle_by_group(df: DataFrame, keys: Sequence[str], actual: str, predicted: str) -> DataFrame:
    """Root mean squared log error, with the number of rows that have no such error (value <= -1 or null)."""
    error = squared_log_error(F.col(actual), F.col(predicted))
    return df.groupBy(*keys).agg(
        F.sqrt(F.avg(error)).alias("rmsle"),
        F.count(error).alias("scored"),
        F.count_if(error.isNull()).alias("unscored"),
    )


def trend_line(df: DataFrame, keys: Sequence[str], y: str, x: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2")
    )


def zscore(df: DataFrame, columns: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Centre and scale by mean and sample deviation over all rows; null where the deviation is 0.

    The statistics are one row from one aggregation, read as a scalar subquery.
    """
    known = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns}
    stats = [F.struct(F.avg(known[c]).alias("m"), F.stddev_samp(known[c]).alias("s")).alias(c) for c in columns]
    fitted = (fit_on if fit_on is not None else df).agg(F.struct(*stats).alias("z")).scalar()
    scaled = df.withColumn("__z", fitted)
    scores = {c: F.try_divide(known[c] - F.col(f"__z.{c}.m"), F.col(f"__z.{c}.s")) for c in columns}
    return scaled.withColumns(scores).drop("__z")


def category_code(df: DataFrame, column: str, out: str) -> DataFrame:
    """Position of the value among the sorted distinct values, from 1; null keeps null."""
    levels = df.select(column).where(F.col(column).isNotNull()).distinct()
    return lookup_join(df, settle(global_ordinal(levels, [column], out)), [column])


def target_encode(
    df: DataFrame, category: str, label: str, out: str, smoothing: float = 0.0, fit_on: DataFrame | None = None
) -> DataFrame:
    """Mean label of the row's category, drawn to the overall mean by ``smoothing`` pseudo-rows."""
    source = (fit_on if fit_on is not None else df).where(F.col(label).isNotNull())
    sums = source.groupBy(category).agg(F.sum(label).alias("__sum"), F.count(label).alias("__n"))
    overall = source.agg(F.avg(label)).scalar()
    encoded = (F.col("__sum") + F.lit(smoothing) * F.col("__overall")) / (F.col("__n") + F.lit(smoothing))
    codes = sums.withColumn("__overall", overall).select(category, encoded.alias(out))
    joined = lookup_join(df, settle(codes), [category])
    return joined.withColumn(out, F.coalesce(F.col(out), overall))


def position(df: DataFrame, field: Sequence[str], elapsed: str, out: str, known: Profile | None = None) -> DataFrame:
    """Rank within the field by elapsed time, equal times sharing the better rank, missing times last.

    In a field too large for one task the rank is one more than the number of rows with a smaller
    time: counts per distinct time are enough, and equal rows travel once.
    """
    if not large_groups(df, field, known):
        rank = F.rank().over(Window.partitionBy(*field).orderBy(F.col(elapsed).asc_nulls_last())).cast("bigint")
        return df.withColumn(out, rank)
    times = df.groupBy(*field, elapsed).agg(F.count(F.lit(1)).alias("__n"))
    upto = Ordered(times, field, [elapsed]).running_total("__n", "__upto").frame
    ranks = upto.select(*field, elapsed, (F.col("__upto") - F.col("__n") + 1).alias(out))
    return salted_join(df, ranks, [*field, elapsed], "inner")
