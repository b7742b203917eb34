"""The pit rule branch by branch, the wide frame both ways, and the variants."""

import pytest
from pyspark.sql import functions as F

from pacegrid.plans import features, laps, weather
from pacegrid.plans.features import CARRIED, CELLS, LAP_KEYS, PLAIN, RESIDUAL, SEARCHED
from pacegrid.plans.laps import SECTORS
from pacegrid.session import settle
from pacegrid.sources import schemas
from test_golden import READING, reading


def seconds(n):
    return None if n is None else f"{n // 60}:{n % 60:02d}.900"


def lap_frame(spark, rows):
    """rows: (number, lap, pit, s1, s2, s3, flag), in file order."""
    data = []
    for i, (number, lap, pit, s1, s2, s3, flag) in enumerate(rows):
        d = {n: None for n in schemas.LAPS.names}
        d.update(NUMBER=number, LAP_NUMBER=lap, EVENT="E1", LOCATION="L1", LAP_TIME=90.0 + i, ELAPSED="12:30.5")
        d.update(zip(SECTORS, map(seconds, (pit, s1, s2, s3))), CROSSING_FINISH_LINE_IN_PIT=flag, TEAM="?", KPH=None)
        data.append(tuple(d[n] for n in schemas.LAPS.names) + (i,))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schemas.LAPS.fields)
    return spark.createDataFrame(data, f"{fields}, _seq int")


def actual(spark, rows, **options):
    clocked = laps.clock_laps(lap_frame(spark, rows), ["_seq"], **options).orderBy("NUMBER", "ROW_N", "LAP_NUMBER")
    return [[r[f"{s}_ACTUAL"] for s in SECTORS] for r in clocked.collect()]


def test_first_lap_loses_its_pit_time_even_below_zero(spark):
    assert actual(spark, [(1, 1, 50, 30, 20, 20, None), (1, 2, 0, 30, 20, 20, None)])[0] == [50, -20, 20, 20]


def test_later_lap_loses_pit_time_only_if_something_remains(spark):
    rows = [
        (1, 1, 0, 30, 20, 20, None),
        (1, 2, 10, 30, 20, 20, None),
        (1, 3, 30, 30, 20, 20, None),
        (1, 4, 40, 30, 20, 20, None),
        (1, 5, 10, 30, 20, 20, None),
    ]
    assert [r[1] for r in actual(spark, rows)] == [30, 20, 30, 30, 30]


def test_crossing_in_pit_takes_the_next_pit_time_off_s3(spark):
    rows = [
        (1, 1, 0, 30, 20, 25, "B"),
        (1, 2, 10, 30, 20, 25, "B"),
        (1, 3, 25, 30, 20, 25, "B"),
        (1, 4, 40, 30, 20, 25, None),
        (1, 5, 10, 30, 20, 25, "B"),
    ]
    assert [r[3] for r in actual(spark, rows)] == [15, 25, 25, 25, 25]


def test_minute_zero_and_missing_sector(spark):
    clocked = laps.clock_laps(lap_frame(spark, [(1, 1, 0, None, 59, 2, None)]), ["_seq"]).first()
    assert [clocked[f"{s}_MIN"] for s in SECTORS] == [0, 0, 1, 2]


def test_second_session_continues_unless_reset(spark):
    rows = [(1, 1, 0, 50, 50, 50, None), (1, 1, 0, 50, 50, 50, None)]
    frame = lap_frame(spark, rows)
    ends = [r["S3_LARGE_CUML"] for r in laps.clock_laps(frame, ["_seq"]).orderBy("ROW_N").collect()]
    assert ends == [150, 300]
    reset = laps.clock_laps(frame, ["_seq"], reset_per_session=True).orderBy("ROW_N").collect()
    assert [r["S3_LARGE_CUML"] for r in reset] == [150, 150]


def test_sector_rows(spark):
    rows = [(1, 1, 5, 30, 20, 25, None), (1, 2, 7, 3500, 20, 25, None)]
    long = laps.sector_clock(lap_frame(spark, rows), ["_seq"]).orderBy("LAP_NUMBER", "SESSION").collect()
    assert [(r["SESSION"], r["PREV_TM"], r["NXT_TM"]) for r in long[:5]] == [
        ("PIT_TIME", 0, 30),
        ("S1_LARGE", 5, 20),
        ("S2_LARGE", 30, 25),
        ("S3_LARGE", 20, 7),
        ("PIT_TIME", 25, 3500),
    ]
    assert all(r["CUML_TM_MIN"] <= 60 for r in long)
    assert long[1]["ACTUAL_TIME"] == 25 and long[1]["TIME"] == "0:30.900"


def test_team_repair(spark):
    frame = lap_frame(spark, [(4, 1, 0, 1, 1, 1, None), (71, 1, 0, 1, 1, 1, None), (3, 1, 0, 1, 1, 1, None)])
    teams = {r["NUMBER"]: r["TEAM"] for r in laps.repair_team(frame).collect()}
    assert teams == {4: "EVR", 71: "ROK", 3: None}


@pytest.fixture(scope="module")
def race(spark):
    feed = [reading(f"1/7/2021 10:{m:02d}", air=20.0 + m, wind="3,75", rain="0,5") for m in range(0, 50, 7)]
    series = weather.minute_weather(spark.createDataFrame(feed, READING))
    cars = [(n, lap, 9 * lap % 40, 30 + n, 25 + lap, 28, "B" if lap == 2 else None) for n in (4, 5) for lap in range(1, 6)]
    # nothing is driven before S1 of car 6, so its pit row falls into minute 0
    cars += [(6, 1, 0, 30, 20, 20, None), (6, 2, 10, 3700, 20, 20, None)]
    frame = laps.repair_team(lap_frame(spark, cars)).withColumn("tr", F.when(F.col("NUMBER") == 5, "TEST").otherwise("TRAIN"))
    return settle(laps.clock_laps(frame, ["_seq"], ["tr"])), settle(series)


def test_half_matched_lap_gives_two_rows(spark, race):
    wide = features.wide_features(*race, ["tr"])
    rows = wide.where("NUMBER = 6 and LAP_NUMBER = 1").orderBy(F.col("TIME_UTC_DATE").asc_nulls_last()).collect()
    assert [r["TIME_UTC_DATE"] is None for r in rows] == [False, True]
    assert rows[0]["AIR_TEMP_PIT_TIME"] is None and rows[0]["AIR_TEMP_S1_LARGE"] is not None
    assert all(rows[1][c] is None for c in CELLS)
    assert rows[0]["S1_LARGE"] == rows[1]["S1_LARGE"] == 30
    late = wide.where("NUMBER = 6 and LAP_NUMBER = 2").collect()
    assert [(r["PIT_TIME"], r["S1_LARGE"]) for r in late] == [(10, None)]


def test_both_ways_to_the_wide_frame_agree(spark, race, monkeypatch):
    clocked, series = race
    nameless = [df.unionByName(df.withColumn("EVENT", F.lit(None).cast("string"))) for df in (clocked, series)]
    race = nameless[0], nameless[1]
    by_lookup = features.wide_features(*race, ["tr"]).collect()
    monkeypatch.setattr(features, "fits_broadcast", lambda *a, **k: False)
    by_shuffle = features.wide_features(*race, ["tr"]).collect()
    assert sorted(map(str, by_lookup)) == sorted(map(str, by_shuffle))
    assert len(by_lookup) > 12


@pytest.mark.parametrize("variant", [RESIDUAL, SEARCHED, PLAIN], ids=lambda v: v.name)
def test_variants(spark, race, variant):
    clocked, series = race
    wide = features.wide_features(clocked, series, ["tr"], variant.carried, variant.cutoff)
    final = features.finalize_features(wide, variant)
    names = final.columns
    assert ("RAIN_S1_LARGE" in names) == (not variant.drop_rain)
    assert not {"ROW_N", "TIME_UTC_DATE", "ELAPSED", "DRIVER_NAME"} & set(names)
    rows = final.collect()
    assert len({r["LAP_KEY"] for r in rows}) == len(rows)
    if variant.carried:
        assert {r["GROUP"] for r in rows} == {0.0} and {r["POWER"] for r in rows} == {150.0}
        assert {r["EVENT"] for r in rows} == {"E"}
    if variant.sentinel:
        assert all(r[c] is not None for r in rows for c in CELLS)
    if variant.fill:
        assert all(r["S1_LARGE"] is not None for r in rows)


def test_carried_columns(spark, race):
    wide = features.wide_features(*race, ["tr"])
    assert wide.columns == ["tr", *LAP_KEYS, "LAP_TIME", *CARRIED, "TIME_UTC_DATE", *CELLS, *SECTORS]
