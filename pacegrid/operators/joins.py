"""Joins: small lookups, hot keys, complete grids, minute buckets, alignment by position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pacegrid.operators.ordered import global_ordinal
from pacegrid.operators.skew import Profile, large_groups, limits, same_keys
from pacegrid.session import Size

LOOKUP_ROWS = 100_000
LOOKUP_BYTES = 64 * 1024 * 1024


def fits_broadcast(df: DataFrame, rows: int = LOOKUP_ROWS, size: int = LOOKUP_BYTES, known: Size | None = None) -> bool:
    """Whether the frame is really small: counted, not estimated. ``known`` is a bound counted before."""
    if known and known.rows <= rows and known.bytes <= size:
        return True
    seen = df.limit(rows + 1).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}))).alias("b")
    )
    n, b = seen.first()
    return n <= rows and (b or 0) <= size


def _equi(left: DataFrame, right: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    """Join on equal keys, null matching null; the keys come from the left side."""
    side = right.select(*[F.col(c).alias(f"__r_{c}") if c in on else F.col(c) for c in right.columns])
    joined = left.join(side, same_keys(left, side, on, "__r_"), how)
    return joined.drop(*[f"__r_{k}" for k in on])


def salted_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", hot: list | None = None
) -> DataFrame:
    """Left or inner join whose left side may have hot keys.

    Rows of a hot key are spread over as many salts as keep each share at the size of an average
    partition, and only the right rows of hot keys are repeated, once per salt. ``hot`` passes on what
    ``large_groups`` found before, as in a chain of joins on the same keys.
    """
    hot = large_groups(left, on) if hot is None else hot
    if not hot:
        return _equi(left, right, on, how)
    rows, parts = limits(left)
    limit = max(rows, sum(r["__n"] for r in hot) // parts)
    schema = left.select(*on).schema.add("__n", "long")
    names = left.sparkSession.createDataFrame(hot, schema)
    # at most `parts` rows
    names = F.broadcast(
        names.select(*[F.col(k).alias(f"__h_{k}") for k in on], F.ceil(F.col("__n") / limit).alias("__salts"))
    )
    gone = [f"__h_{k}" for k in on] + ["__salts"]
    spread = F.pmod(F.xxhash64(*left.columns, F.spark_partition_id()), F.col("__salts"))
    salted = left.join(names, same_keys(left, names, on, "__h_"), "left")
    salted = salted.withColumn("__salt", F.coalesce(spread, F.lit(0)).cast("int")).drop(*gone)
    copies = right.join(names, same_keys(right, names, on, "__h_"), "left")
    last = F.coalesce(F.col("__salts") - 1, F.lit(0)).cast("int")
    copies = copies.withColumn("__salt", F.explode(F.sequence(F.lit(0), last))).drop(*gone)
    return _equi(salted, copies, [*on, "__salt"], how).drop("__salt")


def lookup_join(
    left: DataFrame, lookup: DataFrame, on: Sequence[str], how: str = "left", known: Size | None = None
) -> DataFrame:
    """Join a lookup table: broadcast if counting shows it is small, else salted by the left side's keys."""
    if fits_broadcast(lookup, known=known):
        return _equi(left, F.broadcast(lookup), on, how)
    return salted_join(left, lookup, on, how)


def grid_join(grid: DataFrame, observed: DataFrame, on: Sequence[str], known: Profile | None = None) -> DataFrame:
    """All rows of a grid with unique keys, with the observations of the same key where there are any.

    A left join cannot divide a hot key of its right side; then matches and gaps are built apart.
    ``known`` tells of the observations' keys.
    """
    if not large_groups(observed, on, known):
        return _equi(grid, observed, on, "left")
    matched = salted_join(observed, grid, on, "inner")
    seen = observed.select(*[F.col(k).alias(f"__r_{k}") for k in on]).distinct()
    gaps = grid.join(seen, same_keys(grid, seen, on, "__r_"), "left_anti")
    names = [*grid.columns, *[c for c in observed.columns if c not in on]]
    return matched.unionByName(gaps, allowMissingColumns=True).select(*names)


def time_bucket_join(
    moments: DataFrame, grid: DataFrame, on: Sequence[str], bucket: tuple[str, str], known: Size | None = None
) -> DataFrame:
    """Give each moment the grid row of its running minute; ``bucket`` names the minute on both sides."""
    left_name, right_name = bucket
    renamed = grid.withColumn(left_name, F.col(right_name).cast("int")).drop(right_name)
    left = moments.withColumn(left_name, F.col(left_name).cast("int"))
    return lookup_join(left, renamed, [*on, left_name], known=known)


def align_by_ordinal(
    left: DataFrame, left_order: Sequence[str], right: DataFrame, right_order: Sequence[str]
) -> DataFrame:
    """Put two frames side by side by row position, each in its own order.

    Frames of unequal length do not belong together: that raises, before any row is given.
    """
    a = global_ordinal(left, left_order, "__row")
    b = global_ordinal(right, right_order, "__row")
    lengths = left.count(), right.count()
    if lengths[0] != lengths[1]:
        raise ValueError(f"frames of {lengths[0]} and {lengths[1]} rows cannot be put side by side")
    return a.join(b, "__row", "inner").drop("__row")
