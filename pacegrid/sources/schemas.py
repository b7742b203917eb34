"""Schemas of the two input feeds. Dirty numbers are read as text and converted by the plans."""

from pyspark.sql import types as T


def _schema(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])


_TEXT, _INT, _DOUBLE = T.StringType(), T.IntegerType(), T.DoubleType()

LAPS = _schema(
    NUMBER=_INT,
    DRIVER_NAME=_TEXT,
    LAP_NUMBER=_INT,
    LAP_TIME=_DOUBLE,
    LAP_IMPROVEMENT=_INT,
    CROSSING_FINISH_LINE_IN_PIT=_TEXT,
    S1=_TEXT,
    S1_IMPROVEMENT=_INT,
    S2=_TEXT,
    S2_IMPROVEMENT=_INT,
    S3=_TEXT,
    S3_IMPROVEMENT=_INT,
    KPH=_DOUBLE,
    ELAPSED=_TEXT,
    S1_LARGE=_TEXT,
    S2_LARGE=_TEXT,
    S3_LARGE=_TEXT,
    PIT_TIME=_TEXT,
    GROUP=_DOUBLE,
    TEAM=_TEXT,
    POWER=_DOUBLE,
    LOCATION=_TEXT,
    EVENT=_TEXT,
)


def weather(event_column: str = "EVENT") -> T.StructType:
    """One row a minute; the test feed calls its event column ``EVENTS``."""
    return _schema(
        TIME_UTC_SECONDS=_DOUBLE,
        TIME_UTC_STR=_TEXT,
        AIR_TEMP=_DOUBLE,
        TRACK_TEMP=_DOUBLE,
        HUMIDITY=_DOUBLE,
        PRESSURE=_DOUBLE,
        WIND_SPEED=_TEXT,
        WIND_DIRECTION=_DOUBLE,
        RAIN=_TEXT,
        LOCATION=_TEXT,
        **{event_column: _TEXT},
    )
