"""Penalised lines on one predictor, where every candidate of the path has a closed form."""

from uuid import uuid4

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pacegrid.functions.numbers import rounded
from pacegrid.plans import models as M
from pacegrid.plans import path, race
from pacegrid.queries.base import query
from pacegrid.queries.models import CATEGORICAL, KEY, KEY_SQL, LABEL, NUMERIC, PARTS_SQL, parts
from pacegrid.session import shared_dir
from pacegrid.sources.files import read_csv, write_csv

MIXES, SHARES = (0.0, 0.5, 1.0), (1.5, 0.5, 0.1, 0.0)

#: What is left of the correlation at a penalty is what is left of the slope.
LINES_SQL = f"""{PARTS_SQL},
    facts AS (
      SELECT corr(l_extendedprice, l_quantity) AS c, stddev_pop(l_quantity) AS sx, stddev_pop(l_extendedprice) AS sy,
             avg(l_quantity) AS mx, avg(l_extendedprice) AS my
      FROM p WHERE fitted),
    lines AS (
      SELECT mix, share, my - slope * mx AS intercept, slope FROM (
        SELECT *, sign(c) * greatest(abs(c) - share * mix, 0) / (1 + share * (1 - mix)) * sy / sx AS slope
        FROM facts, (SELECT unnest({list(MIXES)})::DOUBLE AS mix), (SELECT unnest({list(SHARES)})::DOUBLE AS share))),
    scores AS (
      SELECT mix, share, any_value(intercept) AS intercept, any_value(slope) AS slope,
             sqrt(avg(pow(ln(1 + l_extendedprice) - ln(1 + greatest(intercept + slope * l_quantity, 0)), 2))) AS rmsle
      FROM p, lines WHERE NOT fitted GROUP BY mix, share)
"""


def _board(t):
    train, valid, _ = parts(t)
    return valid, path.fit_path(train, valid, LABEL, ["l_quantity"], mixes=MIXES, penalties=SHARES)


@query(
    "linear_path",
    f"""{LINES_SQL}
    SELECT mix, share, round(intercept, 4) AS intercept, round(slope, 5) AS slope FROM scores
    """,
)
def linear_path(t):
    train, _, _ = parts(t)
    on = path.design(train, ["l_quantity"], [])
    m = path.moments(train, on, LABEL)
    lines = [line for mix in MIXES for line in path.solve(m, mix, SHARES)]
    rows = [(line.mix, line.share, line.intercept, line.coefficients[0]) for line in lines]
    table = t.spark.createDataFrame(rows, "mix double, share double, intercept double, slope double")
    return table.withColumns({"intercept": rounded(F.col("intercept"), 4), "slope": rounded(F.col("slope"), 5)})


@query(
    "linear_leaderboard",
    f"""{LINES_SQL}
    SELECT 'gaussian, mix=' || CAST(mix AS DECIMAL(2, 1))::VARCHAR || ', share=' || CAST(share AS DECIMAL(2, 1))::VARCHAR AS model_id,
           round(rmsle, 7) AS rmsle, CAST(0 AS BIGINT) AS unscored, rank() OVER (ORDER BY round(rmsle, 7)) AS place
    FROM scores
    """,
)
def linear_leaderboard(t):
    """The ranking, with the two numbers of an id written alike in both."""
    _, board = _board(t)
    numbers = F.split(F.regexp_replace("params", "[a-z=]", ""), ", ")
    number = [F.format_string("%.1f", numbers[i].cast("double")) for i in range(2)]
    name = F.concat(F.lit("gaussian, mix="), number[0], F.lit(", share="), number[1])
    table = board.table.select(name.alias("model_id"), rounded(F.col("rmsle"), 7).alias("rmsle"), "unscored")
    # one row per candidate
    return table.withColumn("place", F.rank().over(Window.orderBy("rmsle")).cast("bigint"))


@query(
    "linear_leader",
    f"""{LINES_SQL},
    best AS (SELECT * FROM scores ORDER BY rmsle LIMIT 1)
    SELECT {KEY_SQL}, round(intercept + slope * l_quantity, 3) AS prediction FROM p, best WHERE NOT fitted
    """,
)
def linear_leader(t):
    """Held-out rows by the best candidate."""
    valid, board = _board(t)
    return board.best()[1].transform(valid).select(*KEY, rounded(F.col("prediction"), 3).alias("prediction"))


@query("penalty_path")
def penalty_path(t):
    """The whole path of each mix over all predictors."""
    train, valid, _ = parts(t)
    return path.fit_path(train, valid, LABEL, NUMERIC, CATEGORICAL).table


@query(
    "line_summary",
    f"""{PARTS_SQL},
    r AS (SELECT l_extendedprice - a * l_quantity - b AS r FROM p, line WHERE fitted),
    f AS (SELECT regr_r2(l_extendedprice, l_quantity) AS r2, count(*) AS n FROM p WHERE fitted)
    SELECT round(min(r), 3) AS min, round(quantile_cont(r, 0.25), 3) AS q1, round(quantile_cont(r, 0.5), 3) AS median,
           round(quantile_cont(r, 0.75), 3) AS q3, round(max(r), 3) AS max, round(sqrt(sum(r * r) / (any_value(n) - 2)), 3) AS residual_error,
           round(any_value(r2), 8) AS r2, round(1 - (1 - any_value(r2)) * (any_value(n) - 1) / (any_value(n) - 2), 8) AS adjusted_r2,
           round(any_value(r2) / (1 - any_value(r2)) * (any_value(n) - 2), 3) AS f_value, CAST(1 AS BIGINT) AS terms, any_value(n) - 2 AS free
    FROM r, f
    """,
)
def line_summary(t):
    train, _, _ = parts(t)
    table = M.fit_summary(M.fit_linear(train, LABEL, ["l_quantity"]), train, LABEL)
    digits = {c: 8 if c.endswith("r2") else 3 for c, kind in table.dtypes if kind == "double"}
    return table.withColumns({c: rounded(F.col(c), d) for c, d in digits.items()})


@query(
    "submission",
    f"""{PARTS_SQL}
    SELECT concat_ws('|', {KEY_SQL}) AS LAP_KEY, round(a * l_quantity + b, 3) AS LAP_TIME FROM p, line WHERE NOT fitted
    """,
)
def submission(t):
    """Predictions handed in as a file, and the file read again."""
    train, valid, _ = parts(t)
    predicted = M.fit_linear(train, LABEL, ["l_quantity"]).transform(valid)
    named = predicted.withColumn("LAP_KEY", F.concat_ws("|", *[F.col(k).cast("string") for k in KEY]))
    folder = f"{shared_dir(t.spark)}/submission-{uuid4().hex}"
    write_csv(race.submission(named.select("LAP_KEY", "predict")), folder)
    schema = T.StructType([T.StructField("LAP_KEY", T.StringType()), T.StructField("LAP_TIME", T.DoubleType())])
    read = read_csv(t.spark, folder, schema, sequence="_seq").drop("_seq")
    return read.withColumn("LAP_TIME", rounded(F.col("LAP_TIME"), 3))
