"""Hand-worked cases for the repair rules."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pacegrid.functions import clock, numbers, text
from pacegrid.operators import columns, stats
from pacegrid.operators.ordered import Ordered
from pacegrid.plans import weather


def apply(spark, values, kind, change):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["out"] for r in df.select("i", change(F.col("v")).alias("out")).orderBy("i").collect()]


def test_duration(spark):
    values = ["1:23.456", "0:59.9", None, "00:02:13", "x", "7"]
    assert apply(spark, values, "string", text.duration_seconds) == [83, 59, None, 2, None, None]
    three = apply(spark, values, "string", lambda c: text.duration_seconds(c, parts=3))
    assert three == [83, 59, None, 133, None, None]


def test_decimal_comma(spark):
    repaired = apply(spark, ["3,75", "1,2,3", "abc", "4.5", None], "string", text.decimal_comma)
    assert repaired == ["3.75", "1.2,3", "abc", "4.5", None]
    as_number = apply(spark, ["3,75", "1,2,3", "abc"], "string", lambda c: text.to_number(text.decimal_comma(c)))
    assert as_number == [3.75, None, None]


def test_leading_digits(spark):
    values = [23.4, 235.4, 2350.0, -5.0, 2.5, 100000.0, None]
    assert apply(spark, values, "double", text.leading_digits) == [23, 23, 23, -5, 2, 10, None]


def test_magnitude(spark):
    values = [771500.9, 101325.2, 10132.4, 102000.0, 90000.0, 1012.7, 77000.0, None]
    expected = [771.5, 1013.25, 1013.2, 1020.0, 900.0, 1012.0, 77000.0, None]
    assert apply(spark, values, "double", numbers.range_rescale) == expected


def test_clock_text(spark):
    values = ["5/7/2021 9:03", "05/07/2021 09:03", "5-7-2021 9:03", "5.7.2021 9:03", "5/7/21 9:03", "soon", None]
    moment = dt.datetime(2021, 7, 5, 9, 3)
    assert apply(spark, values, "string", clock.parse_timestamp) == [moment] * 5 + [None, None]
    assert apply(spark, ["5/7/2021", "x"], "string", clock.parse_date) == [moment.date(), None]


def test_minute_bucket(spark):
    assert apply(spark, [0, 1, 60, 61, 3600], "bigint", clock.minute_bucket) == [0, 1, 1, 2, 60]


def test_fills(spark):
    rows = [(i, v) for i, v in enumerate([None, 1, None, 2, None])]
    df = spark.createDataFrame(rows, "i int, v int").withColumn("k", F.lit("a"))
    for direction, expected in {
        "down": [None, 1, 1, 2, 2],
        "up": [1, 1, 2, 2, None],
        "updown": [1, 1, 2, 2, 2],
        "downup": [1, 1, 1, 2, 2],
    }.items():
        frame = Ordered(df, ["k"], ["i"]).fill(["v"], direction).frame
        assert [r["v"] for r in frame.orderBy("i").collect()] == expected


def test_zscore_of_a_constant(spark):
    df = spark.createDataFrame([(5.0,), (5.0,), (5.0,)], "v double")
    scaled = stats.zscore(df, ["v"])
    assert [r["v"] for r in scaled.collect()] == [None] * 3
    assert [r["v"] for r in columns.fill_sentinel(scaled).collect()] == [-999.0] * 3


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "v double")
    assert stats.null_profile(df).collect() == [("v", 2)]
    assert columns.nan_to_null(df).where("v is null").count() == 2


def test_category_code_keeps_null(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "v string")
    coded = stats.category_code(df, "v", "code").collect()
    assert sorted((r["v"] or "", r["code"]) for r in coded if r["v"]) == [("a", 1), ("b", 2), ("b", 2)]
    assert [r["code"] for r in coded if r["v"] is None] == [None]


READING = "TIME_UTC_SECONDS double, TIME_UTC_STR string, AIR_TEMP double, TRACK_TEMP double, HUMIDITY double,"
READING += " PRESSURE double, WIND_SPEED string, WIND_DIRECTION double, RAIN string, LOCATION string, EVENT string"


def reading(stamp, air=None, wind=None, seconds=None, event="E1", rain="0"):
    return (seconds, stamp, air, 30.0, 50.0, 1012.7, wind, 90.0, rain, "L1", event)


def test_grid_past_midnight(spark):
    feed = spark.createDataFrame([reading("1/7/2021 23:30")], READING)
    rows = weather.minute_grid(feed).orderBy("TIME_UTC_STR").collect()
    assert len(rows) == 60
    assert [r["T_IDX"] for r in rows] == list(range(1, 31)) * 2
    assert {r["ROW_N"] for r in rows} == {1}
    through = weather.minute_grid(feed, index_by="session").orderBy("TIME_UTC_STR").collect()
    assert [r["T_IDX"] for r in through] == list(range(1, 61))


def test_weather_series(spark):
    feed = spark.createDataFrame(
        [
            reading("1/7/2021 10:00", air=235.0, wind="3,75", seconds=7.0),
            reading("1/7/2021 10:02", air=25.0),
            reading("2/7/2021 10:00", air=None, wind="1,5"),
        ],
        READING,
    )
    rows = weather.minute_weather(feed).orderBy("ROW_N", "T_IDX").collect()
    assert len(rows) == 120
    assert [r["AIR_TEMP"] for r in rows[:3]] == [23.0, 24.0, 25.0]
    assert [r["WIND_SPEED"] for r in rows[:61:30]] == [3.75, 3.75, 1.5]
    assert rows[0]["TIME_UTC_SECONDS"] == 7.0
    assert rows[1]["TIME_UTC_SECONDS"] == dt.datetime(2021, 7, 1, 10, 1, tzinfo=dt.timezone.utc).timestamp()
    assert rows[5]["T_SEC"] == 360 and rows[5]["PRESSURE_2"] == 1012.0


def test_calendar_and_feeds(spark):
    train = spark.createDataFrame([reading("1/7/2021 10:00", seconds=5.0), reading("3/7/2021 9:00", seconds=9.0)], READING)
    test = spark.createDataFrame([reading("1/7/2021 10:30", seconds=8.0)], READING)
    test = test.withColumnRenamed("EVENT", "EVENTS").withColumn("RAIN", F.lit(0.5))
    both = weather.harmonise(train, test)
    assert dict(both.dtypes)["RAIN"] == "string"
    rows = weather.session_calendar(both).orderBy("ROW_N").collect()
    assert [(r["MIN_TIM"], r["MAX_TIM"], r["SESSION_TIME"], r["RACES"], r["ROW_N"]) for r in rows] == [
        (5.0, 8.0, 3.0, 2, 1),
        (9.0, 9.0, 0.0, 2, 2),
    ]


@pytest.mark.parametrize("parts", [1, 7])
def test_results_do_not_depend_on_partitioning(spark, parts):
    feed = spark.createDataFrame([reading(f"1/7/2021 10:{m:02d}", air=20.0 + m) for m in range(0, 40, 3)], READING)
    usual = sorted(map(str, weather.minute_weather(feed).collect()))
    assert sorted(map(str, weather.minute_weather(feed.repartition(parts)).collect())) == usual
