"""Finding groups too large for one task, and cutting them into ordered pieces.

A window over ``keys`` sorts each whole group in one task, which breaks down once a single key
holds a large share of the table. Here a group counts as *large* when it holds more rows than an
average shuffle partition would (``rows / parts``), so there are never more than ``parts`` of them.
Large groups are cut at order values taken from a range partitioning of their rows, which gives at
most ``2 * parts`` pieces in total. The cut values are collected once and enter later plans as
literals: every branch of a plan, and every retried task, sees the same pieces.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

ROWS_SETTING = "pacegrid.split.rows"
PARTS_SETTING = "pacegrid.split.parts"
DEFAULT_ROWS = 2_000_000
#: Hash buckets for each part in the search for large groups.
BUCKETS = 64

PIECE = "__piece"
_CUTS = "__cuts"
_COARSE = "__coarse"
_STRIDE = 32


def limits(df: DataFrame) -> tuple[int, int]:
    """(rows a group may always hold, number of parts the table is thought of in)."""
    conf = df.sparkSession.conf
    rows = int(conf.get(ROWS_SETTING, str(DEFAULT_ROWS)))
    parts = int(conf.get(PARTS_SETTING, None) or conf.get("spark.sql.shuffle.partitions"))
    return rows, max(parts, 2)


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], prefix: str = "") -> Column:
    """Null-safe equality on every key; the right side's names may carry a prefix."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[prefix + k]) for k in keys])


@dataclass(frozen=True)
class Profile:
    """What is known of a frame's keys: no group of ``keys`` holds more rows than ``bounds[keys]``.

    It stays true for finer keys, for rows filtered out of the frame, and for frames that add columns
    to its rows or join at most one row to each. The empty key set stands for the whole table.
    """

    bounds: Mapping[tuple[str, ...], int]

    def most(self, keys: Sequence[str]) -> int | None:
        """The least known bound for groups of ``keys``."""
        return min((n for own, n in self.bounds.items() if set(own) <= set(keys)), default=None)


def _bucket(keys: Sequence[str], parts: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(BUCKETS * parts))


def profile(df: DataFrame, *key_sets: Sequence[str]) -> Profile:
    """Bounds for several key sets from one pass: rows per hash bucket of each, combined before the shuffle."""
    _, parts = limits(df)
    buckets = [F.struct(F.lit(i).alias("i"), _bucket(keys, parts).alias("b")) for i, keys in enumerate(key_sets)]
    counts = df.select(F.explode(F.array(*buckets)).alias("__h")).groupBy("__h").agg(F.count(F.lit(1)).alias("__n"))
    # one row per key set
    seen = counts.groupBy("__h.i").agg(F.max("__n").alias("most"), F.sum("__n").alias("rows")).collect()
    most = {r["i"]: r["most"] for r in seen}
    rows = max((r["rows"] for r in seen), default=0)
    return Profile({(): rows} | {tuple(keys): most.get(i, 0) for i, keys in enumerate(key_sets)})


def small_groups(df: DataFrame, keys: Sequence[str], known: Profile | None) -> bool:
    """Whether ``known`` rules out groups above the limit."""
    bound = known.most(keys) if known else None
    return bound is not None and bound <= limits(df)[0]


def large_groups(df: DataFrame, keys: Sequence[str], known: Profile | None = None) -> list:
    """Keys (with their row counts) of the groups above the limit; at most ``parts`` rows.

    One pass counts rows per hash bucket, combined before its shuffle. A group above the limit lies in
    a bucket above it, so only the keys of such buckets, if there are any, are counted one by one.
    Nothing is counted where ``known`` already rules such groups out.
    """
    rows, parts = limits(df)
    if small_groups(df, keys, known):
        return []
    bucket = _bucket(keys, parts)
    counts = df.groupBy(bucket.alias("__b")).agg(F.count(F.lit(1)).alias("__n"))
    total, most = counts.agg(F.sum("__n"), F.max("__n")).first()
    limit = max(rows, (total or 0) // parts)
    if (most or 0) <= limit:
        return []
    # fewer than `parts` buckets hold more than an average partition
    full = F.broadcast(counts.where(F.col("__n") > limit).select("__b"))
    counted = df.withColumn("__b", bucket).join(full, "__b", "left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    return counted.where(F.col("__n") > limit).collect()


def _order_value(order: Sequence[str]) -> Column:
    """The order columns as one comparable value, nulls after everything else."""
    fields = []
    for i, c in enumerate(order):
        fields += [F.col(c).isNull().alias(f"n{i}"), F.col(c).alias(f"v{i}")]
    return F.struct(*fields)


@dataclass(frozen=True)
class Groups:
    """How the groups of ``keys`` ordered by ``order`` are divided among tasks."""

    keys: tuple[str, ...]
    order: tuple[str, ...]
    cuts: DataFrame | None

    @property
    def split(self) -> bool:
        return self.cuts is not None

    def attach(self, df: DataFrame) -> DataFrame:
        """Add the piece number: 0 for a group kept whole, else 1, 2, ... in order."""
        if not self.split:
            return df
        if self.keys:
            side = self.cuts.select(*[F.col(k).alias(f"__k_{k}") for k in self.keys], _CUTS, _COARSE)
            # bounded by construction: at most `parts` rows and 2 * parts cut values
            df = df.join(F.broadcast(side), same_keys(df, side, self.keys, "__k_"), "left")
            df = df.drop(*[f"__k_{k}" for k in self.keys])
        else:
            df = df.withColumn(_CUTS, self.cuts.select(_CUTS).scalar())
            df = df.withColumn(_COARSE, self.cuts.select(_COARSE).scalar())
        here = _order_value(self.order)
        strides = F.size(F.filter(F.col(_COARSE), lambda cut: cut <= here)) * _STRIDE
        inner = F.slice(F.col(_CUTS), strides + 1, F.lit(_STRIDE))
        piece = 1 + strides + F.size(F.filter(inner, lambda cut: cut <= here))
        numbered = F.when(F.col(_CUTS).isNull(), F.lit(0)).otherwise(piece).cast("int")
        return df.withColumn(PIECE, numbered).drop(_CUTS, _COARSE)

    @property
    def partition(self) -> list[str]:
        return [*self.keys, PIECE] if self.split else list(self.keys)

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.partition).orderBy(*[F.col(c).asc_nulls_last() for c in self.order])

    def order_value(self) -> Column:
        return _order_value(self.order)


def plan_groups(df: DataFrame, keys: Sequence[str], order: Sequence[str], known: Profile | None = None) -> Groups:
    """Decide which groups need cutting. With no keys the whole table is one group."""
    keys, order = tuple(keys), tuple(order)
    most, parts = limits(df)
    if keys:
        large = large_groups(df, keys, known)
        if not large:
            return Groups(keys, order, None)
        names = df.sparkSession.createDataFrame(large, df.select(*keys).schema.add("__n", "long"))
        names = names.select(*[F.col(k).alias(f"__k_{k}") for k in keys])
        rows = df.join(F.broadcast(names), same_keys(df, names, keys, "__k_"), "left_semi")
    elif (known.most(()) if known and () in known.bounds else df.count()) <= most:
        return Groups(keys, order, None)
    else:
        rows = df
    ranged = rows.select(*keys, _order_value(order).alias("o")).repartitionByRange(parts, *keys, "o")
    lowest = ranged.groupBy(*keys, F.spark_partition_id().alias("p")).agg(F.min("o").alias("o")).drop("p")
    # at most one row per range partition and large group
    literal = df.sparkSession.createDataFrame(lowest.collect(), lowest.schema)
    gathered = literal.groupBy(*keys).agg(F.sort_array(F.collect_list("o")).alias(_CUTS))
    cuts = gathered.withColumn(
        _COARSE, F.filter(F.col(_CUTS), lambda cut, i: i % _STRIDE == F.lit(_STRIDE - 1))
    )
    return Groups(keys, order, cuts)
