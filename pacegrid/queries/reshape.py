"""Unpivot, pivot, nested rows."""

from pyspark.sql import functions as F

from pacegrid.operators import reshape as R
from pacegrid.queries.base import day_text, query

FLAGS = ["A", "N", "R"]


@query(
    "unpivot_measures",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, session, reading FROM (
      SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, CASE WHEN l_tax > 0 THEN l_tax END AS l_tax,
             l_discount FROM lineitem)
    UNPIVOT INCLUDE NULLS (reading FOR session IN (l_quantity, l_tax, l_discount))
    """,
)
def unpivot_measures(t):
    ids = ["l_orderkey", "l_linenumber", "l_partkey"]
    taxed = F.when(F.col("l_tax") > 0, F.col("l_tax")).alias("l_tax")
    df = t.lineitem.select(*ids, "l_quantity", taxed, "l_discount")
    return R.unpivot_measures(df, ids, ["l_quantity", "l_tax", "l_discount"], "session", "reading")


@query(
    "pivot_single",
    """
    SELECT l_orderkey, min(l_quantity) FILTER (l_returnflag = 'A') AS "A",
           min(l_quantity) FILTER (l_returnflag = 'N') AS "N", min(l_quantity) FILTER (l_returnflag = 'R') AS "R"
    FROM lineitem GROUP BY l_orderkey
    """,
)
def pivot_single(t):
    return R.pivot_measures(t.lineitem, ["l_orderkey"], "l_returnflag", FLAGS, ["l_quantity"])


@query(
    "pivot_multi",
    """
    SELECT l_orderkey, l_linestatus,
           min(l_quantity) FILTER (l_returnflag = 'A') AS "l_quantity_A",
           min(l_quantity) FILTER (l_returnflag = 'N') AS "l_quantity_N",
           min(l_quantity) FILTER (l_returnflag = 'R') AS "l_quantity_R",
           min(l_tax) FILTER (l_returnflag = 'A') AS "l_tax_A", min(l_tax) FILTER (l_returnflag = 'N') AS "l_tax_N",
           min(l_tax) FILTER (l_returnflag = 'R') AS "l_tax_R"
    FROM lineitem GROUP BY l_orderkey, l_linestatus
    """,
)
def pivot_multi(t):
    ids = ["l_orderkey", "l_linestatus"]
    return R.pivot_measures(t.lineitem, ids, "l_returnflag", FLAGS, ["l_quantity", "l_tax"])


@query(
    "nest_unnest",
    """
    WITH numbered AS (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    blocks AS (SELECT user_id, (n - 1) // 50 AS block, count(*) AS held FROM numbered GROUP BY ALL)
    SELECT n.event_id, n.user_id, CAST(b.block AS INTEGER) AS block, CAST(b.held AS INTEGER) AS held, n.value
    FROM numbered n JOIN blocks b ON b.user_id = n.user_id AND b.block = (n.n - 1) // 50
    """,
)
def nest_unnest(t):
    df = t.events.select("user_id", "ts", "event_id", "value")
    nested = R.nest(df, ["user_id"], ["ts", "event_id"], ["event_id", "value"], "laps", block=50)
    return R.unnest(nested.withColumn("held", F.size("laps")), "laps")


@query(
    "wide_and_back",
    """
    SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, round(min(value), 2) AS value
    FROM events GROUP BY ALL
    """,
)
def wide_and_back(t):
    kinds = ["click", "error", "purchase", "signup", "view"]
    df = t.events.select(day_text(F.col("ts")).alias("day"), "event_type", "value")
    wide = R.pivot_measures(df, ["day"], "event_type", kinds, ["value"])
    back = R.unpivot_measures(wide, ["day"], kinds, "event_type", "value")
    return back.where(F.col("value").isNotNull())
