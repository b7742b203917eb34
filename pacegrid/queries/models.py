"""Files, models and reports. Fits have no SQL twin; reports on formula predictions do."""

from uuid import uuid4

from pyspark.sql import functions as F
from pyspark.sql import types as T

from pacegrid.functions.numbers import rounded
from pacegrid.plans import models as M
from pacegrid.plans import path, report, staged
from pacegrid.queries.base import query
from pacegrid.queries.stats import MODELS_SQL, prediction_log_of
from pacegrid.session import settle, shared_dir
from pacegrid.sources.files import read_csv, write_csv

LABEL = "l_extendedprice"
NUMERIC = ["l_quantity", "l_discount", "l_tax"]
CATEGORICAL = ["l_returnflag", "l_linestatus"]
#: The published 3 x 3 x 4 search.
SEARCH_SHAPE = M.parameter_grid(**M.SEARCH_GRID)
KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@query(
    "csv_roundtrip",
    """
    SELECT o_orderkey, o_orderstatus, '"' || o_orderstatus || '", or "' || o_orderpriority || '"' AS note, nullif(o_orderpriority, '5-LOW') AS o_orderpriority,
           CASE WHEN o_totalprice >= 20000 THEN o_totalprice END AS o_totalprice
    FROM orders
    """,
)
def csv_roundtrip(t):
    df = t.orders.select(
        "o_orderkey",
        "o_orderstatus",
        F.concat(F.lit('"'), "o_orderstatus", F.lit('", or "'), "o_orderpriority", F.lit('"')).alias("note"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("o_orderpriority"),
        F.when(F.col("o_totalprice") >= 20000, F.col("o_totalprice")).alias("o_totalprice"),
    )
    folder = f"{shared_dir(t.spark)}/csv-{uuid4().hex}"
    write_csv(df, folder)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in df.schema.fields])
    return read_csv(t.spark, folder, schema, sequence="_seq").drop("_seq")


@query(
    "evaluation_report",
    f"""
    SELECT model, round(sqrt(avg(pow(ln(1 + actual) - ln(1 + predict), 2))), 6) AS rmsle, count(*) AS scored,
           CAST(0 AS BIGINT) AS unscored,
           round(CASE WHEN model <> 'constant' THEN regr_slope(actual - predict, predict) END, 6) AS slope,
           round(CASE WHEN model <> 'constant' THEN regr_r2(actual - predict, predict) END, 6) AS r2,
           round(avg(actual - predict), 3) AS mean_residual
    FROM ({MODELS_SQL}) m GROUP BY model
    """,
)
def evaluation_report(t):
    table = report.evaluation_report(prediction_log_of(t), "actual", "predict")
    table = table.drop("intercept").withColumn("r2", F.when(F.col("slope").isNotNull(), F.col("r2")))
    digits = {"rmsle": 6, "slope": 6, "r2": 6, "mean_residual": 3}
    return table.withColumns({c: rounded(F.col(c), d) for c, d in digits.items()})


@query(
    "prediction_density",
    f"""
    WITH m AS ({MODELS_SQL}), span AS (SELECT min(predict) AS low, max(predict) AS high FROM m)
    SELECT model, CAST(least(floor((predict - low) / (high - low) * 25) + 1, 25) AS INTEGER) AS bin, count(*) AS rows
    FROM m, span GROUP BY 1, 2
    """,
)
def prediction_density(t):
    return report.prediction_density(prediction_log_of(t), "predict", bins=25)


@query(
    "prediction_curve",
    f"""
    WITH m AS ({MODELS_SQL}),
    s AS (
      SELECT model, count(*) AS n, min(predict) AS lo, max(predict) AS hi,
             0.9 * coalesce(nullif(least(stddev_samp(predict), (quantile_cont(predict, 0.75) - quantile_cont(predict, 0.25)) / 1.34), 0),
               nullif(stddev_samp(predict), 0), nullif(abs(min(predict)), 0), 1) * pow(count(*), -0.2) AS width
      FROM m GROUP BY model),
    g AS (SELECT model, n, width, lo - 3 * width AS low, (hi - lo + 6 * width) / 63 AS step FROM s),
    b AS (
      SELECT model, pos, least(floor(pos), 62)::INT AS j FROM (SELECT m.model, (predict - low) / step AS pos FROM m JOIN g ON m.model = g.model)),
    w AS (
      SELECT model, j, sum(w) AS w FROM (
        SELECT model, j, 1 - (pos - j) AS w FROM b UNION ALL SELECT model, j + 1, pos - j FROM b) GROUP BY ALL)
    SELECT g.model, point, round(any_value(low + point * step), 3) AS x,
           round(sum(w * exp(-pow((point - j) * step / width, 2) / 2)) / any_value(n * width * sqrt(2 * pi())), 12) AS density
    FROM g, (SELECT unnest(range(64))::INT AS point), w WHERE w.model = g.model GROUP BY g.model, point
    """,
)
def prediction_curve(t):
    curve = report.density_curve(prediction_log_of(t), "predict", points=64)
    return curve.withColumns({"x": rounded(F.col("x"), 3), "density": rounded(F.col("density"), 12)})


@query(
    "split_exact",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
           CASE WHEN row_number() OVER (ORDER BY CAST('0x' || substr(md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey)), 1, 13) AS BIGINT),
                  l_orderkey, l_linenumber, l_partkey, l_suppkey) <= floor(0.8::DOUBLE * count(*) OVER () + 0.5)
                THEN 'train' ELSE 'valid' END AS part
    FROM lineitem
    """,
)
def split_exact(t):
    return M.exact_split(t.lineitem.select(*KEY), KEY, 0.8, "part")


def parts(t):
    df = t.lineitem.select(*KEY, LABEL, *NUMERIC, *CATEGORICAL)
    # read by every fit and score below
    df = settle(M.hash_split(df, KEY, 0.8, "part"))
    return df.where(F.col("part") == "train"), df.where(F.col("part") == "valid"), df


@query("ols_fit")
def ols_fit(t):
    df = t.lineitem.select(LABEL, *NUMERIC, "l_returnflag")
    model = M.fit_linear(df, LABEL, [*NUMERIC, "l_returnflag"])
    return M.linear_summary(model, df)


@query("glm_leaderboard")
def glm_leaderboard(t):
    train, valid, _ = parts(t)
    return path.fit_glm_board(train, valid, LABEL, NUMERIC, CATEGORICAL).table


@query("gbt_fit_predict")
def gbt_fit_predict(t):
    _, valid, df = parts(t)
    marked = df.withColumn("held_out", F.col("part") == "valid")
    model = M.fit_trees(marked, LABEL, NUMERIC, CATEGORICAL, maxIter=20, maxDepth=6, stepSize=0.3, valid="held_out")
    return model.transform(valid).select(*KEY, LABEL, "predict")


@query("feature_importance")
def feature_importance(t):
    train, _, _ = parts(t)
    model = M.fit_trees(train, LABEL, NUMERIC, CATEGORICAL, maxIter=20, maxDepth=6, stepSize=0.3)
    return M.feature_importance(model, train)


def _line(train):
    return M.fit_linear(train, LABEL, ["l_quantity", "l_linestatus"])


@query("residual_stack")
def residual_stack(t):
    train, valid, _ = parts(t)
    stack = M.fit_residual_stack(
        train, LABEL, _line(train), ["l_discount", "l_tax"], ["l_returnflag"], maxIter=20, maxDepth=6, stepSize=0.03
    )
    scored = stack.transform(valid)
    return scored.select(*KEY, LABEL, "predict", "residual_predict", "stacked_predict")


@query("grid_search_scores")
def grid_search_scores(t):
    train, valid, _ = parts(t)
    return staged.search(train, valid, LABEL, NUMERIC, CATEGORICAL, SEARCH_SHAPE).table


PARTS_SQL = """
    WITH p AS (
      SELECT *, CAST(('0x' || substr(md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey)), 1, 8)) AS BIGINT)
                % 100 < 80 AS fitted
      FROM lineitem),
    line AS (
      SELECT regr_slope(l_extendedprice, l_quantity) AS a, regr_intercept(l_extendedprice, l_quantity) AS b
      FROM p WHERE fitted)
"""
KEY_SQL = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


@query(
    "model_save_load",
    f"""{PARTS_SQL}
    SELECT {KEY_SQL}, l_extendedprice, round(a * l_quantity + b, 3) AS predict FROM p, line WHERE NOT fitted
    """,
)
def model_save_load(t):
    train, valid, _ = parts(t)
    folder = f"{shared_dir(t.spark)}/model-{uuid4().hex}"
    M.save_model(M.fit_linear(train, LABEL, ["l_quantity"]), folder)
    return M.load_model(folder).transform(valid).select(*KEY, LABEL, rounded(F.col("predict"), 3).alias("predict"))


@query(
    "ols_check",
    "SELECT unnest(['one', 'l_quantity', 'l_discount', 'l_tax', 'flag_N', 'flag_R']) AS term, CAST(0 AS DOUBLE) AS moment",
)
def ols_check(t):
    """The residuals of the full line stand at right angles to every predictor."""
    df = t.lineitem.select(LABEL, *NUMERIC, "l_returnflag")
    left = F.col(LABEL) - F.col("predict")
    sides = {"one": F.lit(1.0)} | {c: F.col(c) for c in NUMERIC}
    sides |= {f"flag_{v}": (F.col("l_returnflag") == v).cast("double") for v in "NR"}
    scored = M.fit_linear(df, LABEL, [*NUMERIC, "l_returnflag"]).transform(df)
    moments = scored.agg(*[(F.abs(F.sum(left * x)) / F.sum(F.abs(F.col(LABEL) * x))).alias(n) for n, x in sides.items()])
    table = moments.unpivot([], list(sides), "term", "moment")
    return table.withColumn("moment", rounded(F.col("moment"), 8))


@query(
    "tree_group_means",
    f"""{PARTS_SQL}, means AS (
      SELECT l_linestatus, avg(l_extendedprice) AS m FROM p WHERE fitted GROUP BY 1)
    SELECT {KEY_SQL}, round(m, 3) AS predict FROM p JOIN means USING (l_linestatus) WHERE NOT fitted
    """,
)
def tree_group_means(t):
    """One round of depth 1 on a category of two values: its leaves are the group means."""
    train, valid, _ = parts(t)
    model = M.fit_trees(train, LABEL, [], ["l_linestatus"], maxIter=1, maxDepth=1)
    return model.transform(valid).select(*KEY, rounded(F.col("predict"), 3).alias("predict"))


@query(
    "stack_group_means",
    f"""{PARTS_SQL}, means AS (
      SELECT l_linestatus, avg(l_extendedprice - a * l_quantity - b) AS m FROM p, line WHERE fitted GROUP BY 1)
    SELECT {KEY_SQL}, round(a * l_quantity + b, 3) AS predict, round(m, 3) AS residual_predict
    FROM p JOIN means USING (l_linestatus), line WHERE NOT fitted
    """,
)
def stack_group_means(t):
    """A line on one predictor, and one round of depth 1 on what it leaves over."""
    train, valid, _ = parts(t)
    line = M.fit_linear(train, LABEL, ["l_quantity"])
    stack = M.fit_residual_stack(train, LABEL, line, [], ["l_linestatus"], maxIter=1, maxDepth=1)
    scored = stack.transform(valid)
    return scored.select(*KEY, *[rounded(F.col(c), 3).alias(c) for c in ("predict", "residual_predict")])
