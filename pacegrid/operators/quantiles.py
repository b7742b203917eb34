"""Exact order statistics by rounds of counts: nothing but counts of buckets leaves a task.

Each pass counts the values of every open interval in at most ``BUCKETS`` buckets of equal width, with
the least and greatest value met in each, and goes on with the bucket that holds the wanted rank,
until a bucket is one value. Where widths do not tell values apart, as in a column of very different
magnitudes, every few rounds a mergeable sketch says where in the interval the rank should be. What it
says is counted like anything else, and the whole interval is opened again where it is wrong.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 4096
#: Rounds from sketch to sketch, and how far to either side of a rank it is asked, as a share of the interval.
ROUNDS, REACH = 4, 0.002


@dataclass(frozen=True)
class Basics:
    """What one pass says of a column."""

    known: int
    missing: int
    minimum: float | None
    maximum: float | None
    mean: float | None
    below: int  # negative infinities
    above: int
    low: float | None  # least and greatest finite value
    high: float | None


def _values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each column as a double, NaN as null."""
    doubles = {f"c{i}": F.col(f"`{c}`").cast("double") for i, c in enumerate(columns)}
    return df.select(*[F.when(~F.isnan(v), v).alias(n) for n, v in doubles.items()])


def basics(values: DataFrame) -> list[Basics]:
    wanted = []
    for c in values.columns:
        v = F.col(c)
        finite = F.when((v > float("-inf")) & (v < float("inf")), v)
        wanted.append(
            F.struct(
                F.count(v).alias("known"),
                F.count_if(v.isNull()).alias("missing"),
                F.min(v).alias("minimum"),
                F.max(v).alias("maximum"),
                F.avg(v).alias("mean"),
                F.count_if(v == float("-inf")).alias("below"),
                F.count_if(v == float("inf")).alias("above"),
                F.min(finite).alias("low"),
                F.max(finite).alias("high"),
            ).alias(c)
        )
    row = values.agg(*wanted).first()
    return [Basics(**row[c].asDict()) for c in values.columns]


def _bucket(v: Column, low: float, high: float) -> Column:
    """Number of the bucket of a value from low to high; halves, so that no difference is too large."""
    share = (v / 2 - low / 2) / (high / 2 - low / 2) if high / 2 > low / 2 else F.when(v > low, 1.0).otherwise(0.0)
    return F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1)).cast("int")


@dataclass(frozen=True)
class Interval:
    """The ``size`` values of a column from low to high; ``before`` of the column are smaller.

    Of a sketched interval both are those of the one it lies in.
    """

    column: int
    low: float
    high: float
    before: int
    size: int
    outer: Interval | None = None


def _counts(values: DataFrame, intervals: Sequence[Interval]) -> dict[int, list]:
    """(bucket, rows, least, greatest) of every interval, in order; bucket -1 is what is smaller in the outer one."""
    entries: dict[int, list[Column]] = defaultdict(list)
    for i, part in enumerate(intervals):
        v = F.col(f"c{part.column}")
        bucket = F.when(v.between(part.low, part.high), _bucket(v, part.low, part.high))
        if part.outer:
            bucket = F.when((v >= part.outer.low) & (v < part.low), -1).otherwise(bucket)
        entries[part.column].append(F.when(bucket.isNotNull(), F.struct(F.lit(i).alias("t"), bucket.alias("b"), v.alias("v"))))
    # a branch for each column, which reads no other
    branches = []
    for own in entries.values():
        one = own[0] if len(own) == 1 else F.explode(F.array_compact(F.array(*own)))
        branches.append(values.select(one.alias("e")).where("e IS NOT NULL").select("e.*"))
    long = reduce(DataFrame.unionByName, branches)
    found = defaultdict(list)
    # at most BUCKETS rows for each interval, at most two intervals for each share and column
    for t, b, n, low, high in long.groupBy("t", "b").agg(F.count(F.lit(1)), F.min("v"), F.max("v")).collect():
        found[t].append((b, n, low, high))
    return {t: sorted(rows) for t, rows in found.items()}


def _sketched(values: DataFrame, waiting: Mapping[Interval, list[int]]) -> dict[Interval, list[int]]:
    """For each rank the part of its interval that should hold it."""
    wanted, order = [], [(part, rank) for part, ranks in waiting.items() for rank in ranks]
    for part, rank in order:
        v, share = F.col(f"c{part.column}"), (rank - part.before) / part.size
        points = [max(0.0, share - REACH), min(1.0, share + REACH)]
        wanted.append(F.percentile_approx(F.when(v.between(part.low, part.high), v), points))
    narrow = defaultdict(list)
    for (part, rank), (low, high) in zip(order, values.agg(*[w.alias(f"w{i}") for i, w in enumerate(wanted)]).first()):
        narrow[Interval(part.column, low, high, part.before, part.size, part)].append(rank)
    return narrow


def order_statistics(values: DataFrame, facts: Sequence[Basics], ranks: Mapping[int, Sequence[int]]) -> dict[tuple[int, int], float]:
    """{(column, rank): value}, ranks from 0."""
    found: dict[tuple[int, int], float] = {}
    waiting: dict[Interval, list[int]] = defaultdict(list)
    for column, wanted in ranks.items():
        b = facts[column]
        for rank in set(wanted):
            if rank < b.below or rank >= b.known - b.above:
                found[column, rank] = -math.inf if rank < b.below else math.inf
            else:
                waiting[Interval(column, b.low, b.high, b.below, b.known - b.below - b.above)].append(rank)
    rounds = 0
    while waiting:
        rounds += 1
        if rounds % ROUNDS == 0:
            waiting = _sketched(values, waiting)
        intervals = list(waiting)
        counted, still = _counts(values, intervals), defaultdict(list)
        for i, part in enumerate(intervals):
            rows = counted.get(i, [])
            start = part.before + sum(n for bucket, n, *_ in rows if bucket < 0)
            rows = [r for r in rows if r[0] >= 0]
            end = start + sum(n for _, n, *_ in rows)
            for rank in waiting[part]:
                if not start <= rank < end:
                    still[part.outer].append(rank)
                    continue
                upto = start
                for _, n, low, high in rows:
                    if rank < upto + n:
                        break
                    upto += n
                if low == high:
                    found[part.column, rank] = low
                else:
                    still[Interval(part.column, low, high, upto, n)].append(rank)
        waiting = still
    return found


def summaries(df: DataFrame, columns: Sequence[str], shares: Sequence[float]) -> list[tuple[Basics, list[float | None]]]:
    """For each column its totals and the values at the shares, interpolated between neighbouring ranks."""
    values = _values(df, columns)
    facts = basics(values)
    ranks = {i: [f((b.known - 1) * s) for s in shares for f in (math.floor, math.ceil)] for i, b in enumerate(facts) if b.known}
    found = order_statistics(values, facts, ranks)
    out = []
    for i, b in enumerate(facts):
        quantiles: list[float | None] = []
        for s in shares:
            at = (b.known - 1) * s
            low, high = (found.get((i, f(at))) for f in (math.floor, math.ceil))
            quantiles.append(low if low is None or low == high else low + (at - math.floor(at)) * (high - low))
        out.append((b, quantiles))
    return out
