"""Lookups, grids, minute buckets, multi-key joins, alignment, unions and blocks."""

from pyspark.sql import functions as F

from pacegrid.functions.clock import minute_bucket
from pacegrid.operators import joins as J
from pacegrid.operators import sets as S
from pacegrid.operators.ordered import Ordered
from pacegrid.operators.reshape import minutes_of, session_starts
from pacegrid.operators.skew import large_groups
from pacegrid.queries.base import clock_text, query
from pacegrid.queries.windows import GRID_SQL, event_grid
from pacegrid.session import settle_sized


@query(
    "lookup_left_join",
    """
    SELECT s.s_suppkey, s.s_nationkey AS nationkey, n.n_name, r.r_name
    FROM supplier s LEFT JOIN nation n ON n.n_nationkey = s.s_nationkey
                    LEFT JOIN region r ON r.r_regionkey = n.n_regionkey
    """,
)
def lookup_left_join(t):
    nations = t.nation.withColumnsRenamed({"n_nationkey": "nationkey", "n_regionkey": "regionkey"})
    regions = t.region.withColumnRenamed("r_regionkey", "regionkey")
    df = t.supplier.select("s_suppkey", F.col("s_nationkey").alias("nationkey"))
    df = J.lookup_join(J.lookup_join(df, nations, ["nationkey"]), regions, ["regionkey"])
    return df.drop("regionkey")


@query(
    "grid_left_join",
    f"""{GRID_SQL}
    SELECT i.event_type, strftime(i.moment, '%Y-%m-%d %H:%M:%S') AS moment, CAST(i.t_idx AS INTEGER) AS t_idx,
           e.event_id, e.value
    FROM indexed i LEFT JOIN events e ON e.event_type = i.event_type AND date_trunc('minute', e.ts) = i.moment
    """,
)
def grid_left_join(t):
    observed = t.events.select("event_type", F.date_trunc("minute", "ts").alias("moment"), "event_id", "value")
    df = J.grid_join(event_grid(t), observed, ["event_type", "moment"])
    return df.select(
        "event_type", clock_text(F.col("moment")).alias("moment"), F.col("T_IDX").alias("t_idx"), "event_id", "value"
    )


@query(
    "multi_key_inner_join",
    """
    WITH sums AS (SELECT l_orderkey, l_linenumber, sum(CAST(l_quantity AS BIGINT)) AS quantity
                  FROM lineitem GROUP BY ALL),
    tops AS (SELECT l_orderkey, l_linenumber, max(l_extendedprice) AS top_price
             FROM lineitem WHERE l_returnflag <> 'A' GROUP BY ALL)
    SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, CAST(s.quantity AS BIGINT) AS quantity, p.top_price
    FROM lineitem l JOIN sums s ON s.l_orderkey = l.l_orderkey AND s.l_linenumber = l.l_linenumber
                    JOIN tops p ON p.l_orderkey = l.l_orderkey AND p.l_linenumber = l.l_linenumber
    """,
)
def multi_key_inner_join(t):
    keys = ["l_orderkey", "l_linenumber"]
    sums = t.lineitem.groupBy(*keys).agg(F.sum(F.col("l_quantity").cast("bigint")).alias("quantity"))
    kept = t.lineitem.where(F.col("l_returnflag") != "A")
    tops = kept.groupBy(*keys).agg(F.max("l_extendedprice").alias("top_price"))
    df = t.lineitem.select(*keys, "l_partkey")
    hot = large_groups(df, keys)
    return J.salted_join(J.salted_join(df, sums, keys, "inner", hot), tops, keys, "inner", hot)


@query(
    "time_bucket_join",
    f"""{GRID_SQL},
    moments AS (
      SELECT *, CAST(sum(CAST(round(value) AS BIGINT))
                     OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS BIGINT) AS seconds
      FROM events),
    bucketed AS (
      SELECT event_id, m.event_type, CAST(n.row_n AS INTEGER) AS row_n,
             CAST(ceil(seconds / 60.0) AS INTEGER) AS running_minute
      FROM moments m JOIN numbered n ON n.event_type = m.event_type AND n.d = CAST(m.ts AS DATE))
    SELECT b.event_id, b.event_type, b.row_n, b.running_minute, strftime(i.moment, '%Y-%m-%d %H:%M:%S') AS moment
    FROM bucketed b LEFT JOIN indexed i
      ON i.event_type = b.event_type AND i.t_idx = b.running_minute AND i.row_n = b.row_n
     AND i.moment_day = i.d
    """,
)
def time_bucket_join(t):
    df = t.events.select("event_id", "event_type", "user_id", "ts", F.round("value").cast("bigint").alias("step"))
    df = Ordered(df, ["user_id", "event_type"], ["ts", "event_id"]).running_total("step", "seconds").frame
    minute = minute_bucket(F.col("seconds")).alias("running_minute")
    moments = df.select("event_id", "event_type", F.to_date("ts").alias("d"), minute)
    days = t.events.select("event_type", F.date_trunc("minute", "ts").alias("moment"), F.to_date("ts").alias("d"))
    starts, size = settle_sized(session_starts(days, ["event_type"], "d", "moment"))
    sessions = starts.select("event_type", "d", "ROW_N")
    moments = J.lookup_join(moments, sessions, ["event_type", "d"], known=size).drop("d")
    grid = minutes_of(starts, ["event_type"], "moment")
    grid = grid.where(F.col("DATE") == F.col("d")).select("event_type", "ROW_N", "T_IDX", "moment")
    bound = size.times(60, 32)
    joined = J.time_bucket_join(moments, grid, ["event_type", "ROW_N"], ("running_minute", "T_IDX"), bound)
    return joined.withColumnRenamed("ROW_N", "row_n").withColumn("moment", clock_text(F.col("moment")))


@query(
    "align_by_ordinal",
    """
    WITH a AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders),
    b AS (SELECT o_custkey AS predicted_for, o_totalprice * 0.5 AS predicted,
                 row_number() OVER (ORDER BY o_orderkey) AS n FROM orders)
    SELECT o_orderkey, o_totalprice, predicted_for, predicted FROM a JOIN b USING (n)
    """,
)
def align_by_ordinal(t):
    actual = t.orders.select("o_orderkey", "o_totalprice")
    predicted = t.orders.select(
        F.col("o_orderkey").alias("row_key"),
        F.col("o_custkey").alias("predicted_for"),
        (F.col("o_totalprice") * 0.5).alias("predicted"),
    )
    return J.align_by_ordinal(actual, ["o_orderkey"], predicted, ["row_key"]).drop("row_key")


@query(
    "union_by_name",
    """
    SELECT o_orderkey, CAST(o_totalprice AS VARCHAR) AS price, o_orderpriority AS priority FROM orders
    WHERE o_orderstatus = 'F'
    UNION ALL BY NAME
    SELECT o_orderkey, CAST(o_totalprice AS VARCHAR) AS price, o_custkey FROM orders WHERE o_orderstatus <> 'F'
    """,
)
def union_by_name(t):
    closed = t.orders.where(F.col("o_orderstatus") == "F").select(
        "o_orderkey", F.col("o_totalprice").cast("string").alias("price"), F.col("o_orderpriority").alias("priority")
    )
    running = t.orders.where(F.col("o_orderstatus") != "F").select(
        F.col("o_orderkey").alias("order_no"), F.col("o_totalprice").alias("price"), "o_custkey"
    )
    running = running.withColumnRenamed("order_no", "o_orderkey").withColumn("price", F.col("price").cast("string"))
    return S.union_by_name(closed, running)


@query(
    "tagged_union",
    """
    SELECT o_orderkey, o_totalprice, o_orderstatus, 'TRAIN' AS tr FROM orders WHERE o_orderstatus = 'F'
    UNION ALL SELECT o_orderkey, o_totalprice, o_orderstatus, 'TEST' FROM orders WHERE o_orderstatus <> 'F'
    """,
)
def tagged_union(t):
    df = t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus")
    feeds = {"TRAIN": df.where(F.col("o_orderstatus") == "F"), "TEST": df.where(F.col("o_orderstatus") != "F")}
    both = S.tagged_union(feeds, "tr")
    return S.union_by_name(*[S.of_tag(both, "tr", name) for name in feeds])


@query(
    "row_block",
    """
    WITH numbered AS (
      SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) AS row_no, count(*) OVER () AS n
      FROM orders)
    SELECT o_orderkey, o_totalprice, row_no FROM numbered
    WHERE row_no > floor(n / 3.0 * 2) AND row_no <= floor(n / 3.0 * 3)
    """,
)
def row_block(t):
    return S.row_block(t.orders.select("o_orderkey", "o_totalprice"), ["o_orderkey"], block=3, blocks=3)


@query(
    "top_k",
    """
    SELECT o_orderpriority, o_orderkey, o_totalprice, CAST(rank AS INTEGER) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rank
      FROM orders) r
    WHERE rank <= 3
    """,
)
def top_k(t):
    df = t.orders.select("o_orderpriority", "o_orderkey", "o_totalprice")
    return S.top_k(df, ["o_orderpriority"], [F.desc("o_totalprice"), F.asc("o_orderkey")], k=3)
