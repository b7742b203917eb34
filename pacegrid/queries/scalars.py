"""Row-wise repair of text, numbers and clocks."""

from pyspark.sql import functions as F

from pacegrid.functions import clock, numbers, text
from pacegrid.queries.base import clock_text, day_text, query

def price_text():
    return F.col("o_totalprice").cast("decimal(12,2)").cast("string")



@query(
    "decimal_comma",
    """
    WITH typed AS (
      SELECT o_orderkey,
             replace(CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR), '.', ',')
               || CASE WHEN o_orderstatus = 'P' THEN ',9' ELSE '' END AS typed
      FROM orders)
    SELECT o_orderkey, typed, regexp_replace(typed, ',', '.') AS repaired,
           TRY_CAST(regexp_replace(typed, ',', '.') AS DOUBLE) AS number
    FROM typed
    """,
)
def decimal_comma(t):
    tail = F.when(F.col("o_orderstatus") == "P", ",9").otherwise("")
    df = t.orders.select("o_orderkey", F.concat(F.replace(price_text(), F.lit("."), F.lit(",")), tail).alias("typed"))
    repaired = text.decimal_comma(F.col("typed"))
    return df.select("o_orderkey", "typed", repaired.alias("repaired"), text.to_number(repaired).alias("number"))


@query(
    "dirty_numeric_cast",
    """
    WITH typed AS (
      SELECT o_orderkey,
             CASE o_orderstatus WHEN 'P' THEN 'n/a'
                  WHEN 'F' THEN CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR)
                  ELSE ' ' || CAST(CAST(trunc(o_totalprice) AS BIGINT) AS VARCHAR) END AS typed
      FROM orders)
    SELECT o_orderkey, TRY_CAST(typed AS DOUBLE) AS number,
           CAST(trunc(TRY_CAST(typed AS DOUBLE)) AS INTEGER) AS whole
    FROM typed
    """,
)
def dirty_numeric_cast(t):
    status = F.col("o_orderstatus")
    typed = (
        F.when(status == "P", "n/a")
        .when(status == "F", price_text())
        .otherwise(F.concat(F.lit(" "), F.col("o_totalprice").cast("bigint").cast("string")))
    )
    df = t.orders.select("o_orderkey", typed.alias("typed"))
    typed = F.col("typed")
    return df.select("o_orderkey", text.to_number(typed).alias("number"), text.to_whole(typed).alias("whole"))


@query(
    "strip_digits",
    """
    SELECT p_partkey, regexp_replace(p_brand, '[0-9]', '', 'g') AS brand,
           regexp_replace(p_name || ' ' || CAST(p_size AS VARCHAR), '[0-9]', '', 'g') AS name
    FROM part
    """,
)
def strip_digits(t):
    sized = F.concat_ws(" ", "p_name", F.col("p_size").cast("string"))
    return t.part.select(
        "p_partkey", text.strip_digits(F.col("p_brand")).alias("brand"), text.strip_digits(sized).alias("name")
    )


@query(
    "duration_seconds",
    """
    WITH cents AS (SELECT event_id, event_type, CAST(round(value * 100) AS BIGINT) AS c FROM events),
    typed AS (
      SELECT event_id,
             CASE WHEN event_type = 'error' THEN NULL
                  ELSE CASE WHEN event_type = 'signup' THEN '00:' ELSE '' END
                       || CAST(c // 100 AS VARCHAR) || ':' || lpad(CAST(c % 60 AS VARCHAR), 2, '0')
                       || '.' || CAST(c % 10 AS VARCHAR) END AS duration
      FROM cents),
    pieces AS (SELECT *, string_split(duration, ':') AS p FROM typed),
    whole AS (
      SELECT *, CAST(trunc(TRY_CAST(p[1] AS DOUBLE)) AS INTEGER) AS a,
             CAST(trunc(TRY_CAST(p[2] AS DOUBLE)) AS INTEGER) AS b,
             CAST(trunc(TRY_CAST(p[3] AS DOUBLE)) AS INTEGER) AS c
      FROM pieces)
    SELECT event_id, duration, CAST(a * 60 + b AS INTEGER) AS seconds,
           CAST(CASE WHEN c IS NULL THEN a * 60 + b ELSE (a * 60 + b) * 60 + c END AS INTEGER) AS seconds_of_three
    FROM whole
    """,
)
def duration_seconds(t):
    cents = F.round(F.col("value") * 100).cast("bigint")
    typed = F.concat(
        F.when(F.col("event_type") == "signup", "00:").otherwise(""),
        F.floor(cents / 100).cast("string"),
        F.lit(":"),
        F.lpad((cents % 60).cast("string"), 2, "0"),
        F.lit("."),
        (cents % 10).cast("string"),
    )
    df = t.events.select("event_id", F.when(F.col("event_type") != "error", typed).alias("duration"))
    return df.select(
        "event_id",
        "duration",
        text.duration_seconds(F.col("duration")).alias("seconds"),
        text.duration_seconds(F.col("duration"), parts=3).alias("seconds_of_three"),
    )


@query(
    "split_columns",
    """
    WITH typed AS (SELECT event_id, strftime(ts, '%-d/%-m/%Y %-H:%M') AS stamp FROM events)
    SELECT event_id, stamp, split_part(stamp, ' ', 1) AS stamp_date, split_part(stamp, ' ', 2) AS stamp_time
    FROM typed
    """,
)
def split_columns(t):
    df = t.events.select("event_id", F.date_format("ts", "d/M/yyyy H:mm").alias("stamp"))
    stamp = F.col("stamp")
    return df.withColumns({"stamp_date": text.part(stamp, " ", 0), "stamp_time": text.part(stamp, " ", 1)})


@query(
    "leading_digits",
    """
    SELECT c_custkey,
           TRY_CAST(substr(CAST(CAST(round_even(floor(c_acctbal) / 2.0, 0) AS BIGINT) AS VARCHAR), 1, 2) AS INTEGER)
             AS two_digits,
           TRY_CAST(substr(CAST(CAST(round_even(c_acctbal, 0) AS BIGINT) AS VARCHAR), 1, 4) AS INTEGER) AS four_digits
    FROM customer
    """,
)
def leading_digits(t):
    return t.customer.select(
        "c_custkey",
        text.leading_digits(F.floor("c_acctbal") / 2.0).alias("two_digits"),
        text.leading_digits(F.col("c_acctbal"), 4).alias("four_digits"),
    )


@query(
    "range_rescale",
    """
    WITH read AS (
      SELECT o_orderkey, floor(o_totalprice * CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END) AS v FROM orders)
    SELECT o_orderkey,
           CASE WHEN v > 770000 AND v < 777000 THEN v / 1000
                WHEN v > 100000 AND v < 120000 THEN v / 100
                WHEN v > 10000 AND v < 11000 THEN v / 10
                WHEN v > 77000 AND v < 777000 THEN v / 100
                ELSE v END AS rescaled
    FROM read
    """,
)
def range_rescale(t):
    doubled = F.col("o_totalprice") * F.when(F.col("o_orderstatus") == "F", 2).otherwise(1)
    return t.orders.select("o_orderkey", numbers.range_rescale(doubled).alias("rescaled"))


@query(
    "rounding_family",
    """
    SELECT s_suppkey AS id, CAST(round_even(floor(s_acctbal) / 2.0, 0) AS BIGINT) AS half_even,
           CAST(floor(s_acctbal) AS BIGINT) AS down, CAST(ceil(s_acctbal) AS BIGINT) AS up
    FROM supplier
    """,
)
def rounding_family(t):
    return t.supplier.select(
        F.col("s_suppkey").alias("id"),
        F.bround(F.floor("s_acctbal") / 2.0, 0).cast("bigint").alias("half_even"),
        F.floor("s_acctbal").alias("down"),
        F.ceil("s_acctbal").alias("up"),
    )


@query(
    "parse_timestamp",
    """
    SELECT event_id,
           CASE WHEN event_type <> 'error' THEN strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') END AS moment,
           CASE WHEN event_type <> 'error' THEN strftime(ts, '%Y-%m-%d') END AS day,
           CASE WHEN event_type <> 'error' THEN CAST(hour(ts) * 60 + minute(ts) AS INTEGER) END AS minute_of_day
    FROM events
    """,
)
def parse_timestamp(t):
    kind = F.col("event_type")
    typed = (
        F.when(kind == "click", F.date_format("ts", "d-M-yyyy H:mm"))
        .when(kind == "purchase", F.date_format("ts", "dd.MM.yyyy HH:mm"))
        .when(kind == "signup", F.date_format("ts", "d/M/yy H:mm"))
        .when(kind == "error", F.lit("unknown"))
        .otherwise(F.date_format("ts", "d/M/yyyy H:mm"))
    )
    df = t.events.select("event_id", typed.alias("typed"))
    time = text.part(F.col("typed"), " ", 1)
    hours, minutes = text.to_whole(text.part(time, ":", 0)), text.to_whole(text.part(time, ":", 1))
    span = clock.clock_interval(hours, minutes)
    return df.select(
        "event_id",
        clock_text(clock.parse_timestamp(F.col("typed"))).alias("moment"),
        day_text(clock.parse_date(text.part(F.col("typed"), " ", 0))).alias("day"),
        (F.extract(F.lit("HOUR"), span) * 60 + F.extract(F.lit("MINUTE"), span)).cast("int").alias("minute_of_day"),
    )


@query(
    "epoch_fallback",
    """
    SELECT event_id,
           CASE WHEN value < 3 THEN CAST(floor(epoch(ts)) AS DOUBLE) ELSE round(value * 100) END AS seconds
    FROM events
    """,
)
def epoch_fallback(t):
    known = F.when(F.col("value") >= 3, F.round(F.col("value") * 100))
    return t.events.select("event_id", F.coalesce(known, clock.epoch_seconds(F.col("ts"))).alias("seconds"))
