"""Column expressions that repair text and numbers typed as text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_number(c: Column) -> Column:
    """Double, or null where the text is not a number."""
    return c.try_cast("double")


def to_whole(c: Column) -> Column:
    """Int with the fraction cut off (23.9 -> 23), or null."""
    return c.try_cast("double").try_cast("int")


def decimal_comma(c: Column) -> Column:
    """Turn the first comma into a dot; later commas stay."""
    return F.regexp_replace(c, r"^([^,]*),", "$1.")


def strip_digits(c: Column) -> Column:
    return F.regexp_replace(c, "[0-9]", "")


def part(c: Column, separator: str, index: int) -> Column:
    """Piece ``index`` (from 0) of the text split on a literal separator, null if there is none."""
    return F.get(F.split(c, re.escape(separator)), F.lit(index))


def duration_seconds(c: Column, parts: int = 2) -> Column:
    """Whole seconds of an ``m:ss.fff`` text, the fraction cut off.

    With ``parts=2`` pieces after the second are ignored, so ``00:02:13`` reads as 2 s;
    ``parts=3`` reads three-piece texts as hours, minutes and seconds instead.
    """
    first, second = to_whole(part(c, ":", 0)), to_whole(part(c, ":", 1))
    two = first * 60 + second
    if parts == 2:
        return two
    third = to_whole(part(c, ":", 2))
    return F.when(third.isNotNull(), two * 60 + third).otherwise(two)


def leading_digits(c: Column, n: int = 2) -> Column:
    """First ``n`` characters of the number rounded half-even: 235 and 2350 both give 23."""
    rounded = F.bround(c.cast("double"), 0).try_cast("bigint").cast("string")
    return F.substring(rounded, 1, n).try_cast("int")
