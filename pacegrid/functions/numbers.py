"""Numeric column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Open lower bound, open upper bound, divisor; the first range that fits wins.
PRESSURE_RANGES = (
    (770000, 777000, 1000),
    (100000, 120000, 100),
    (10000, 11000, 10),
    (77000, 777000, 100),
)


def range_rescale(c: Column, ranges: Sequence[tuple[float, float, float]] = PRESSURE_RANGES) -> Column:
    """Bring a whole-number reading of the wrong magnitude back by the range it falls in."""
    whole = F.floor(c).cast("double")
    scaled = whole
    for low, high, divisor in reversed(ranges):
        scaled = F.when((whole > low) & (whole < high), whole / divisor).otherwise(scaled)
    return scaled


def missing(c: Column, floating: bool) -> Column:
    """Null, or NaN for floating columns."""
    return c.isNull() | F.isnan(c) if floating else c.isNull()


def to_step(c: Column, digits: int) -> Column:
    """Nearest multiple of 10^-digits by plain arithmetic, far cheaper per value than decimal rounding."""
    scale = float(10**digits)
    return F.floor(c * scale + 0.5) / scale


def rounded(c: Column, digits: int) -> Column:
    """Round for output; a negative zero becomes zero."""
    return F.round(c.cast("double"), digits) + F.lit(0.0)
