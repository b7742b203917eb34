"""Ordinals, shifts, running totals, fills and imputation over ordered groups."""

from pyspark.sql import functions as F

from pacegrid.functions.numbers import rounded
from pacegrid.operators.ordered import Ordered
from pacegrid.operators.reshape import minute_grid as grid_of
from pacegrid.operators.reshape import session_starts
from pacegrid.operators.stats import zscore
from pacegrid.queries.base import clock_text, day_text, query

CAR = ["user_id"]
LAPS = ["ts", "event_id"]
LINE_ORDER = ["l_partkey", "l_suppkey", "l_shipdate"]


@query(
    "session_ordinal",
    """
    WITH days AS (SELECT event_type, CAST(ts AS DATE) AS d FROM events GROUP BY ALL)
    SELECT event_type, strftime(d, '%Y-%m-%d') AS day,
           CAST(row_number() OVER (PARTITION BY event_type ORDER BY d) AS INTEGER) AS session_no
    FROM days
    """,
)
def session_ordinal(t):
    days = session_starts(t.events.withColumn("d", F.to_date("ts")), ["event_type"], "d", "ts")
    return days.select("event_type", day_text(F.col("d")).alias("day"), F.col("ROW_N").alias("session_no"))


@query(
    "repeat_ordinal",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y-%m-%d') AS shipped,
           row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                              ORDER BY l_partkey, l_suppkey, l_shipdate) AS repeat_no
    FROM lineitem
    """,
)
def repeat_ordinal(t):
    df = t.lineitem.select("l_orderkey", "l_linenumber", *LINE_ORDER)
    df = Ordered(df, ["l_orderkey", "l_linenumber"], LINE_ORDER).number("repeat_no").frame
    return df.withColumn("shipped", day_text(F.col("l_shipdate"))).drop("l_shipdate")


GRID_SQL = """
    WITH starts AS (
      SELECT event_type, CAST(ts AS DATE) AS d, min(date_trunc('minute', ts)) AS m FROM events GROUP BY ALL),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY d) AS row_n FROM starts),
    grid AS (
      SELECT event_type, d, row_n, m + to_minutes(CAST(i AS BIGINT)) AS moment
      FROM numbered, (SELECT unnest(range(60)) AS i)),
    indexed AS (
      SELECT *, CAST(moment AS DATE) AS moment_day,
             row_number() OVER (PARTITION BY event_type, CAST(moment AS DATE) ORDER BY row_n, moment) AS t_idx
      FROM grid)
"""


def event_grid(t):
    minutes = t.events.select("event_type", F.date_trunc("minute", "ts").alias("moment"))
    return grid_of(minutes.withColumn("d", F.to_date("moment")), ["event_type"], "d", "moment")


@query(
    "minute_grid",
    f"""{GRID_SQL}
    SELECT event_type, strftime(d, '%Y-%m-%d') AS day, CAST(row_n AS INTEGER) AS row_n,
           strftime(moment, '%Y-%m-%d %H:%M:%S') AS moment, strftime(moment_day, '%Y-%m-%d') AS moment_day
    FROM indexed
    """,
)
def minute_grid(t):
    return event_grid(t).select(
        "event_type",
        day_text(F.col("d")).alias("day"),
        F.col("ROW_N").alias("row_n"),
        clock_text(F.col("moment")).alias("moment"),
        day_text(F.col("DATE")).alias("moment_day"),
    )


@query(
    "minute_index",
    f"""{GRID_SQL}
    SELECT event_type, strftime(moment, '%Y-%m-%d %H:%M:%S') AS moment, CAST(t_idx AS INTEGER) AS t_idx,
           CAST(t_idx * 60 AS INTEGER) AS t_sec
    FROM indexed
    """,
)
def minute_index(t):
    return event_grid(t).select(
        "event_type",
        clock_text(F.col("moment")).alias("moment"),
        F.col("T_IDX").alias("t_idx"),
        (F.col("T_IDX") * 60).alias("t_sec"),
    )


@query("group_size", "SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id) AS laps FROM events")
def group_size(t):
    df = t.events.select("event_id", "user_id")
    return Ordered(df, CAR, ["event_id"]).size("laps").frame


@query(
    "lag_lead",
    """
    SELECT event_id, user_id, lag(value) OVER w AS previous, lead(value) OVER w AS following,
           lag(event_type) OVER w AS previous_type, lead(event_type) OVER w AS following_type
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
    """,
)
def lag_lead(t):
    df = t.events.select(*LAPS, *CAR, "value", "event_type")
    shifted = Ordered(df, CAR, LAPS).shift(
        {
            "previous": ("value", 1),
            "following": ("value", -1),
            "previous_type": ("event_type", 1),
            "following_type": ("event_type", -1),
        }
    )
    return shifted.frame.drop("ts", "value", "event_type")


@query(
    "lag_lead_offset",
    """
    SELECT event_id, user_id, lag(event_type, 4) OVER w AS four_back, lead(event_type, 4) OVER w AS four_ahead
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
    """,
)
def lag_lead_offset(t):
    df = t.events.select(*LAPS, *CAR, "event_type")
    shifted = Ordered(df, CAR, LAPS).shift({"four_back": ("event_type", 4), "four_ahead": ("event_type", -4)})
    return shifted.frame.drop("ts", "event_type")


@query(
    "running_total",
    """
    SELECT event_id, user_id,
           CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT)
             AS cents_so_far
    FROM events
    """,
)
def running_total(t):
    df = t.events.select(*LAPS, *CAR, F.round(F.col("value") * 100).cast("bigint").alias("cents"))
    return Ordered(df, CAR, LAPS).running_total("cents", "cents_so_far").frame.drop("ts", "cents")


READINGS_SQL = "SELECT event_id, user_id, ts, CASE WHEN value >= 8 THEN value END AS reading FROM events"


def gappy_readings(t):
    return t.events.select(*LAPS, *CAR, F.when(F.col("value") >= 8, F.col("value")).alias("reading"))


@query(
    "impute_group_mean",
    f"""
    SELECT event_id, user_id,
           round(coalesce(reading, avg(reading) OVER (PARTITION BY user_id)), 6) AS reading
    FROM ({READINGS_SQL}) r
    """,
)
def impute_group_mean(t):
    df = Ordered(gappy_readings(t), CAR, LAPS).impute_mean(["reading"]).frame
    return df.select("event_id", "user_id", rounded(F.col("reading"), 6).alias("reading"))


@query(
    "fill_down",
    f"""
    SELECT event_id, user_id,
           last_value(reading IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS reading
    FROM ({READINGS_SQL}) r
    """,
)
def fill_down(t):
    return Ordered(gappy_readings(t), CAR, LAPS).fill(["reading"], "down").frame.drop("ts")


@query(
    "fill_updown",
    f"""
    SELECT event_id, user_id,
           coalesce(first_value(reading IGNORE NULLS) OVER later, last_value(reading IGNORE NULLS) OVER sofar)
             AS updown,
           coalesce(last_value(reading IGNORE NULLS) OVER sofar, first_value(reading IGNORE NULLS) OVER later)
             AS downup
    FROM ({READINGS_SQL}) r
    WINDOW sofar AS (PARTITION BY user_id ORDER BY ts, event_id
                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
           later AS (PARTITION BY user_id ORDER BY ts, event_id
                     ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
    """,
)
def fill_updown(t):
    twice = gappy_readings(t).withColumns({"updown": F.col("reading"), "downup": F.col("reading")})
    filled = Ordered(twice, CAR, LAPS).fill(["updown"], "updown").fill(["downup"], "downup")
    return filled.frame.drop("ts", "reading")


@query(
    "zscore_global",
    """
    SELECT l_orderkey, l_linenumber,
           round((l_quantity - avg(l_quantity) OVER ()) / stddev_samp(l_quantity) OVER (), 6) + 0.0 AS quantity,
           round((l_tax - avg(l_tax) OVER ()) / stddev_samp(l_tax) OVER (), 6) + 0.0 AS tax,
           CAST(NULL AS DOUBLE) AS constant
    FROM lineitem
    """,
)
def zscore_global(t):
    df = t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_quantity").alias("quantity"),
        F.col("l_tax").alias("tax"),
        F.lit(5.0).alias("constant"),
    )
    scaled = zscore(df, ["quantity", "tax", "constant"])
    return scaled.withColumns({c: rounded(F.col(c), 6) for c in ("quantity", "tax")})


@query(
    "prev_lap_features",
    """
    SELECT event_id, user_id, value - lag(value) OVER w AS change,
           CAST(floor(epoch(ts)) - floor(epoch(lag(ts) OVER w)) AS BIGINT) AS seconds_since
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
    """,
)
def prev_lap_features(t):
    df = t.events.select(*LAPS, *CAR, "value")
    shifted = Ordered(df, CAR, LAPS).shift({"before": ("value", 1), "before_ts": ("ts", 1)}).frame
    return shifted.select(
        "event_id",
        "user_id",
        (F.col("value") - F.col("before")).alias("change"),
        (F.unix_timestamp("ts") - F.unix_timestamp("before_ts")).alias("seconds_since"),
    )
