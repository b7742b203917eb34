"""Weather: repair the readings, number the sessions, and put them on a complete minute grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pacegrid.functions import clock, numbers, text
from pacegrid.operators import reshape
from pacegrid.operators.joins import grid_join
from pacegrid.operators.ordered import Ordered
from pacegrid.operators.sets import union_by_name
from pacegrid.operators.skew import Profile
from pacegrid.operators.stats import session_bounds
from pacegrid.session import settle_sized

PLACE = ["EVENT", "LOCATION"]
MEASURES = ["AIR_TEMP", "TRACK_TEMP", "HUMIDITY", "PRESSURE_2", "WIND_SPEED", "WIND_DIRECTION", "RAIN"]


def harmonise(train: DataFrame, test: DataFrame) -> DataFrame:
    """One weather frame from two feeds that name the event differently and type rain differently."""
    test = test.withColumnRenamed("EVENTS", "EVENT")
    return union_by_name(*[df.withColumn("RAIN", F.col("RAIN").cast("string")) for df in (train, test)])


def clean_weather(weather: DataFrame) -> DataFrame:
    """Numbers of the right magnitude and a real timestamp."""
    wind = F.substring(text.decimal_comma(F.col("WIND_SPEED").cast("string")), 1, 4)
    return weather.withColumns(
        {
            "WIND_SPEED": text.to_number(wind),
            "RAIN": text.decimal_comma(F.col("RAIN")),
            "AIR_TEMP": text.leading_digits(F.col("AIR_TEMP")),
            "TRACK_TEMP": text.leading_digits(F.col("TRACK_TEMP")).cast("double"),
            "HUMIDITY": text.leading_digits(F.col("HUMIDITY")).cast("double"),
            "PRESSURE_2": numbers.range_rescale(F.col("PRESSURE")),
            "TIME_UTC_STR": clock.parse_timestamp(F.col("TIME_UTC_STR")),
        }
    ).drop("PRESSURE")


def with_session_date(weather: DataFrame) -> DataFrame:
    """Date and minute from the clock text of an uncleaned feed."""
    stamp = F.col("TIME_UTC_STR")
    return weather.withColumns(
        {"TIME_UTC_DATE": clock.parse_date(text.part(stamp, " ", 0)), "TIME_UTC_STR": clock.parse_timestamp(stamp)}
    )


def session_calendar(weather: DataFrame) -> DataFrame:
    """Bounds, length and ordinal of each session, with the number of sessions of its place."""
    bounds = session_bounds(with_session_date(weather), [*PLACE, "TIME_UTC_DATE"], "TIME_UTC_SECONDS")
    # one row per calendar day in a group
    place = Window.partitionBy(*PLACE)
    return bounds.withColumns(
        {
            "RACES": F.count(F.lit(1)).over(place),
            "ROW_N": F.row_number().over(place.orderBy(F.col("TIME_UTC_DATE").asc_nulls_last())),
        }
    )


def minute_grid(weather: DataFrame, index_by: str = "date") -> DataFrame:
    """60 minutes from the first reading of each session."""
    return reshape.minute_grid(with_session_date(weather), PLACE, "TIME_UTC_DATE", "TIME_UTC_STR", 60, index_by)


def weather_on_grid(
    grid: DataFrame, clean: DataFrame, sequence: Sequence[str] = (), known: Profile | None = None
) -> DataFrame:
    """Every grid minute with its readings; gaps take the place's mean or the reading before.

    Readings sharing a minute all stay; ``sequence`` then names what orders them. ``known`` tells of the
    readings' keys.
    """
    # read for the group sizes and for the windows
    joined, size = settle_sized(grid_join(grid, clean, [*PLACE, "TIME_UTC_STR"], known))
    order = ["ROW_N", "TIME_UTC_STR", "TIME_UTC_SECONDS", *sequence]
    filled = (
        Ordered(joined, PLACE, order, known=Profile({(): size.rows}))
        .impute_mean(["AIR_TEMP", "TRACK_TEMP", "HUMIDITY", "PRESSURE_2"])
        .fill(["WIND_SPEED", "WIND_DIRECTION", "RAIN"], "down")
        .frame
    )
    seconds = F.coalesce("TIME_UTC_SECONDS", clock.epoch_seconds(F.col("TIME_UTC_STR")))
    return filled.withColumns({"TIME_UTC_SECONDS": seconds, "T_SEC": F.col("T_IDX") * 60})


def minute_weather(
    weather: DataFrame, index_by: str = "date", sequence: Sequence[str] = (), known: Profile | None = None
) -> DataFrame:
    """From raw feed to the filled minute series; ``sequence`` orders readings of one minute and second.

    ``known`` tells of the feed's keys, as cleaning keeps its rows.
    """
    return weather_on_grid(minute_grid(weather, index_by), clean_weather(weather), sequence, known)
