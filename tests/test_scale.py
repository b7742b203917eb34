"""Results do not depend on how large a table is thought to be, or on how it is spread."""

import os

import pytest
from pyspark.sql import functions as F

from pacegrid.operators import joins, ordered, skew, stats
from pacegrid.operators.ordered import Ordered
from pacegrid.plans import weather
from pacegrid.session import scratch, settle, shared_dir


def test_hot_key_among_many_parts(spark):
    spark.conf.set(skew.ROWS_SETTING, "50")
    spark.conf.set(skew.PARTS_SETTING, "20000")
    try:
        df = spark.range(40_000).select(F.when(F.col("id") < 80, -1).otherwise(F.col("id")).alias("k"))
        assert [(r["k"], r["__n"]) for r in skew.large_groups(df, ["k"])] == [(-1, 80)]
    finally:
        spark.conf.unset(skew.ROWS_SETTING)
        spark.conf.unset(skew.PARTS_SETTING)


def test_missing_times_rank_last_both_ways(spark, splitting):
    rows = [("f", float(i)) for i in range(59)] + [("f", None)]
    df = spark.createDataFrame(rows, "field string, time double")
    cut = {(r["time"], r["place"]) for r in stats.position(df, ["field"], "time", "place").collect()}
    spark.conf.set(skew.ROWS_SETTING, "1000")
    whole = {(r["time"], r["place"]) for r in stats.position(df, ["field"], "time", "place").collect()}
    assert cut == whole and (None, 60) in whole and (0.0, 1) in whole


def test_mean_of_a_group_without_an_order(spark, splitting):
    df = spark.range(300).selectExpr("'g' AS k", "1 AS same", "if(id % 3 = 0, null, cast(id AS double)) AS v")
    out = Ordered(df, ["k"], ["same"]).impute_mean(["v"]).frame
    assert out.count() == 300 and out.where("v IS NULL").isEmpty()
    assert out.where("v = 150.0").count() >= 100


def test_far_shifts_do_not_broadcast(spark, splitting, monkeypatch):
    df = spark.range(200).selectExpr("id % 2 AS k", "id")
    near_by = Ordered(df, ["k"], ["id"]).shift({"p": ("id", 30)}).frame
    monkeypatch.setattr(ordered, "BROADCAST_ROWS", 10)
    far = Ordered(df, ["k"], ["id"]).shift({"p": ("id", 30)}).frame
    assert sorted(map(str, near_by.collect())) == sorted(map(str, far.collect()))


def test_unequal_frames_do_not_align(spark):
    with pytest.raises(ValueError, match="5 and 3 rows"):
        joins.align_by_ordinal(spark.range(5), ["id"], spark.range(3).withColumnRenamed("id", "b"), ["b"])


def test_readings_of_one_minute_keep_their_order(spark):
    kinds = "EVENT string, LOCATION string, TIME_UTC_SECONDS long, TIME_UTC_STR string, WIND_SPEED string, WIND_DIRECTION long, RAIN string, AIR_TEMP double, TRACK_TEMP double, HUMIDITY double, PRESSURE double, _seq int"
    rows = [("E", "L", None, "19/04/2020 10:00", "1", w, "0", 20.0, 20.0, 50.0, 1000.0, i) for i, w in enumerate([90, None, 180, None])]
    found = set()
    for n in (1, 3, 7):
        df = spark.createDataFrame(rows, kinds).repartition(n, "_seq")
        series = weather.minute_weather(df, sequence=["_seq"])
        first = series.where("_seq IS NOT NULL").orderBy("_seq")
        found.add(tuple(r["WIND_DIRECTION"] for r in first.collect()))
    assert found == {(90, 90, 180, 180)}


def test_scratch_leaves_nothing(spark):
    before = set(os.listdir(shared_dir(spark)))
    with scratch(spark):
        assert settle(spark.range(10)).count() == 10
        assert set(os.listdir(shared_dir(spark))) != before
    assert set(os.listdir(shared_dir(spark))) == before
