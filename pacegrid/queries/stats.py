"""Aggregates, profiles, scores and trends."""

from functools import reduce

from pyspark.sql import functions as F

from pacegrid.functions.numbers import rounded
from pacegrid.operators import stats as A
from pacegrid.plans.models import hash_split, parameter_grid
from pacegrid.plans.report import residuals
from pacegrid.queries.base import day_text, query


@query(
    "session_bounds",
    """
    SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, CAST(min(floor(epoch(ts))) AS BIGINT) AS first_second,
           CAST(max(floor(epoch(ts))) AS BIGINT) AS last_second,
           CAST(max(floor(epoch(ts))) - min(floor(epoch(ts))) AS BIGINT) AS session_time
    FROM events GROUP BY 1, 2
    """,
)
def session_bounds(t):
    df = t.events.select("event_type", day_text(F.col("ts")).alias("day"), F.unix_timestamp("ts").alias("s"))
    names = {"MIN_TIM": "first_second", "MAX_TIM": "last_second", "SESSION_TIME": "session_time"}
    return A.session_bounds(df, ["event_type", "day"], "s").withColumnsRenamed(names)


@query(
    "null_profile",
    """
    SELECT 'l_quantity' AS "column", count(*) FILTER (l_quantity <= 10) AS missing FROM lineitem
    UNION ALL SELECT 'l_tax', count(*) FILTER (l_tax = 0) FROM lineitem
    UNION ALL SELECT 'l_returnflag', count(*) FILTER (l_returnflag = 'R') FROM lineitem
    """,
)
def null_profile(t):
    df = t.lineitem.select(
        F.when(F.col("l_quantity") > 10, F.col("l_quantity")).alias("l_quantity"),
        F.when(F.col("l_tax") == 0, F.lit(float("nan"))).otherwise(F.col("l_tax")).alias("l_tax"),
        F.when(F.col("l_returnflag") != "R", F.col("l_returnflag")).alias("l_returnflag"),
    )
    return A.null_profile(df)


def _summary_sql(column: str) -> str:
    return f"""
    SELECT '{column}' AS "column", min(v) AS minimum, round(quantile_cont(v, 0.25), 4) AS q1,
           round(quantile_cont(v, 0.5), 4) AS median, round(avg(v), 4) AS mean,
           round(quantile_cont(v, 0.75), 4) AS q3, max(v) AS maximum, count(*) - count(v) AS missing
    FROM (SELECT CASE WHEN l_quantity > 2 THEN {column} END AS v FROM lineitem) x
    """


SUMMARISED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("column_summary", " UNION ALL ".join(_summary_sql(c) for c in SUMMARISED))
def column_summary(t):
    df = t.lineitem.select(*[F.when(F.col("l_quantity") > 2, F.col(c)).alias(c) for c in SUMMARISED])
    inexact = ("q1", "median", "mean", "q3")
    return A.column_summary(df, SUMMARISED).withColumns({c: rounded(F.col(c), 4) for c in inexact})


@query(
    "histogram_by_group",
    """
    WITH span AS (SELECT min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem)
    SELECT l_returnflag,
           CAST(least(floor((l_quantity - low) / (high - low) * 20) + 1, 20) AS INTEGER) AS bin, count(*) AS rows
    FROM lineitem, span GROUP BY 1, 2
    """,
)
def histogram_by_group(t):
    return A.histogram_by_group(t.lineitem, ["l_returnflag"], "l_quantity", 20)


FITTED_SQL = """
    SELECT l_orderkey, l_returnflag, l_shipdate, l_extendedprice AS actual,
           1000 * l_quantity * (1 + l_tax) AS fitted FROM lineitem
"""


def closed_form(t):
    """Actual price and a prediction by a fixed formula, so that SQL can say the same."""
    fitted = 1000 * F.col("l_quantity") * (1 + F.col("l_tax"))
    return t.lineitem.select(
        "l_orderkey", "l_quantity", "l_returnflag", "l_shipdate", F.col("l_extendedprice").alias("actual"), fitted.alias("fitted")
    )


@query(
    "rmsle_by_group",
    f"""
    SELECT l_returnflag, round(sqrt(avg(pow(ln(1 + actual) - ln(1 + fitted), 2))), 6) AS rmsle,
           count(*) FILTER (fitted IS NOT NULL) AS scored, count(*) FILTER (fitted IS NULL) AS unscored
    FROM (SELECT l_returnflag, actual, CASE WHEN fitted > 2000 THEN fitted END AS fitted FROM ({FITTED_SQL}) f)
    GROUP BY 1
    """,
)
def rmsle_by_group(t):
    df = closed_form(t).withColumn("fitted", F.when(F.col("fitted") > 2000, F.col("fitted")).otherwise(-2.0))
    scores = A.rmsle_by_group(df, ["l_returnflag"], "actual", "fitted")
    return scores.withColumn("rmsle", rounded(F.col("rmsle"), 6))


@query(
    "trend_line",
    f"""
    SELECT l_returnflag, round(regr_slope(actual - fitted, fitted), 6) AS slope,
           round(regr_intercept(actual - fitted, fitted), 3) AS intercept,
           round(regr_r2(actual - fitted, fitted), 6) AS r2
    FROM ({FITTED_SQL}) f GROUP BY 1
    """,
)
def trend_line(t):
    df = closed_form(t).withColumn("residual", F.col("actual") - F.col("fitted"))
    line = A.trend_line(df, ["l_returnflag"], "residual", "fitted")
    return line.select(
        "l_returnflag",
        rounded(F.col("slope"), 6).alias("slope"),
        rounded(F.col("intercept"), 3).alias("intercept"),
        rounded(F.col("r2"), 6).alias("r2"),
    )


@query(
    "residual_table",
    f"""
    SELECT l_orderkey, actual, round(fitted, 4) AS fitted, round(actual - fitted, 4) AS residual
    FROM ({FITTED_SQL}) f
    """,
)
def residual_table(t):
    df = residuals(closed_form(t).withColumnRenamed("fitted", "predict"), "actual", "predict")
    digits = [rounded(F.col(c), 4).alias(c) for c in ("fitted", "residual")]
    return df.select("l_orderkey", "actual", *digits)


@query(
    "ols_simple",
    """
    SELECT count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope,
           round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept,
           round(regr_r2(l_extendedprice, l_quantity), 6) AS r2
    FROM lineitem
    """,
)
def ols_simple(t):
    y, x = "l_extendedprice", "l_quantity"
    return t.lineitem.agg(
        F.count(F.lit(1)).alias("n"),
        rounded(F.regr_slope(y, x), 4).alias("slope"),
        rounded(F.regr_intercept(y, x), 3).alias("intercept"),
        rounded(F.regr_r2(y, x), 6).alias("r2"),
    )


@query(
    "target_encode",
    """
    WITH m AS (SELECT p_brand, sum(p_retailprice) AS s, count(*) AS n FROM part GROUP BY 1),
    o AS (SELECT avg(p_retailprice) AS overall FROM part)
    SELECT p_partkey, p_brand, round((s + 20 * overall) / (n + 20), 4) AS encoded
    FROM part JOIN m USING (p_brand), o
    """,
)
def target_encode(t):
    df = t.part.select("p_partkey", "p_brand", "p_retailprice")
    encoded = A.target_encode(df, "p_brand", "p_retailprice", "encoded", smoothing=20.0)
    return encoded.select("p_partkey", "p_brand", rounded(F.col("encoded"), 4).alias("encoded"))


@query(
    "split_train_valid",
    """
    SELECT o_orderkey,
           CASE WHEN CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8) AS BIGINT) % 100 < 80
                THEN 'train' ELSE 'valid' END AS part
    FROM orders
    """,
)
def split_train_valid(t):
    return hash_split(t.orders.select("o_orderkey"), ["o_orderkey"], 0.8, "part")


MODELS_SQL = f"""
    SELECT l_orderkey, actual, fitted AS predict, 'formula' AS model FROM ({FITTED_SQL}) f
    UNION ALL SELECT l_orderkey, l_extendedprice, 1000 * l_quantity, 'by quantity' FROM lineitem
    UNION ALL SELECT l_orderkey, l_extendedprice, CAST(25000 AS DOUBLE), 'constant' FROM lineitem
"""


def prediction_log_of(t):
    """Each line with the prediction of three formulas, from one scan."""
    df = closed_form(t)
    named = {"formula": F.col("fitted"), "by quantity": 1000 * F.col("l_quantity"), "constant": F.lit(25000.0)}
    logged = F.array(*[F.struct(F.lit(m).alias("model"), p.cast("double").alias("predict")) for m, p in named.items()])
    return df.select("l_orderkey", "actual", F.inline(logged))


@query(
    "prediction_log",
    f"""
    SELECT model, round(sqrt(avg(pow(ln(1 + actual) - ln(1 + predict), 2))), 6) AS rmsle, count(*) AS scored,
           CAST(0 AS BIGINT) AS unscored
    FROM ({MODELS_SQL}) m GROUP BY model
    """,
)
def prediction_log(t):
    scores = A.rmsle_by_group(prediction_log_of(t), ["model"], "actual", "predict")
    return scores.withColumn("rmsle", rounded(F.col("rmsle"), 6))


GRID = parameter_grid(shrink=(0.9, 1.0, 1.1), power=(0.95, 1.0, 1.05), base=(800.0, 900.0, 1000.0, 1100.0))


def _grid_sql() -> str:
    rows = [
        f"SELECT {p['shrink']}::DOUBLE AS shrink, {p['power']}::DOUBLE AS power, {p['base']}::DOUBLE AS base,"
        f" round(sqrt(avg(pow(ln(1 + l_extendedprice)"
        f" - ln(1 + {p['base']}::DOUBLE * {p['shrink']}::DOUBLE * pow(l_quantity, {p['power']}::DOUBLE)), 2))), 6)"
        f" AS rmsle FROM lineitem"
        for p in GRID
    ]
    return " UNION ALL ".join(rows)


@query("param_grid", _grid_sql())
def param_grid(t):
    """Every point of a 3 x 3 x 4 grid scored in one pass over the table."""
    price = F.col("l_extendedprice")
    errors = [
        F.sqrt(
            F.avg(
                A.squared_log_error(price, p["base"] * p["shrink"] * F.pow("l_quantity", F.lit(p["power"])))
            )
        ).alias(f"p{i}")
        for i, p in enumerate(GRID)
    ]
    scores = t.lineitem.agg(*errors).unpivot([], [f"p{i}" for i in range(len(GRID))], "point", "rmsle")
    point = F.col("point")

    def setting(name):
        return reduce(
            lambda chain, ip: chain.when(point == f"p{ip[0]}", float(ip[1][name])), enumerate(GRID), F
        )

    settings = [setting(n).alias(n) for n in ("shrink", "power", "base")]
    return scores.select(*settings, rounded(F.col("rmsle"), 6).alias("rmsle"))


@query(
    "position_timeline",
    """
    WITH laps AS (
      SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS BIGINT) AS lap_seconds,
             row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_shipdate)
               AS row_n, l_shipdate
      FROM lineitem),
    clocked AS (
      SELECT *, CAST(sum(lap_seconds) OVER (PARTITION BY l_orderkey ORDER BY row_n, l_linenumber) AS BIGINT)
               AS elapsed
      FROM laps)
    SELECT l_orderkey, l_linenumber, row_n, elapsed,
           rank() OVER (PARTITION BY l_suppkey, row_n, l_linenumber ORDER BY elapsed) AS position
    FROM clocked
    """,
)
def position_timeline(t):
    from pacegrid.operators.ordered import Ordered
    from pacegrid.operators.skew import profile
    from pacegrid.queries.windows import LINE_ORDER

    car, lap = ["l_orderkey"], ["l_orderkey", "l_linenumber"]
    df = t.lineitem.select(*lap, *LINE_ORDER, F.col("l_quantity").cast("bigint").alias("lap_seconds"))
    # one look serves the cars, their laps and the fields, which are finer than supplier and line
    known = profile(df, car, ["l_suppkey", "l_linenumber"])
    found = Ordered(df, car, LINE_ORDER, known=known)
    numbered = found.refine(lap, LINE_ORDER).number("row_n").frame
    df = found.refine(car, ["row_n", "l_linenumber"], numbered).running_total("lap_seconds", "elapsed").frame
    field = ["l_suppkey", "row_n", "l_linenumber"]
    ranked = A.position(df, field, "elapsed", "position", known)
    return ranked.select(*lap, "row_n", "elapsed", "position")
