"""Clock text, timestamps and minute buckets. Session time zone is UTC."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Day-first clock texts, tried in turn.
DAY_FIRST_MINUTES = ("d/M/yyyy H:mm", "d-M-yyyy H:mm", "d.M.yyyy H:mm", "d/M/yy H:mm")
DAY_FIRST_DATES = ("d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "d/M/yy")


def parse_timestamp(c: Column, patterns: Sequence[str] = DAY_FIRST_MINUTES) -> Column:
    """First pattern that fits, null if none does."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(p)) for p in patterns])


def parse_date(c: Column, patterns: Sequence[str] = DAY_FIRST_DATES) -> Column:
    return F.to_date(parse_timestamp(c, patterns))


def clock_interval(hours: Column, minutes: Column) -> Column:
    return F.make_dt_interval(F.lit(0), hours, minutes, F.lit(0))


def minute_bucket(seconds: Column) -> Column:
    """Running minute that holds a second count: 1-60 s are minute 1, and 0 s is minute 0."""
    return F.ceil(seconds / 60).cast("int")


def epoch_seconds(ts: Column) -> Column:
    return F.unix_timestamp(ts).cast("double")
