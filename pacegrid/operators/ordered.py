"""Window operators over ordered groups: ordinals, running totals, shifts, fills, group means.

``Ordered(df, keys, order)`` looks once for groups too large for one task (see ``skew``). If there
are none, every method is the plain Spark window. Otherwise large groups are worked on piece by
piece, and a summary with one row per piece carries totals and last values from piece to piece.
The order must be total within a group (add a unique column as the last one).
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pacegrid.operators.skew import PIECE, Groups, Profile, limits, plan_groups, same_keys
from pacegrid.session import settle

#: Rows near cuts are broadcast up to this number.
BROADCAST_ROWS = 100_000


class Ordered:
    def __init__(
        self,
        df: DataFrame,
        keys: Sequence[str],
        order: Sequence[str],
        groups: Groups | None = None,
        known: Profile | None = None,
    ):
        self.groups = groups or plan_groups(df, keys, order, known)
        self.keys = list(self.groups.keys)
        self._df = df if PIECE in df.columns else self.groups.attach(df)

    @property
    def frame(self) -> DataFrame:
        return self._df.drop(PIECE)

    def _with(self, df: DataFrame) -> Ordered:
        return Ordered(df, self.groups.keys, self.groups.order, self.groups)

    def map(self, change) -> Ordered:
        """Apply a row-wise change (``DataFrame`` -> ``DataFrame``) that keeps key and order columns."""
        return self._with(change(self._df))

    def refine(self, keys: Sequence[str], order: Sequence[str], df: DataFrame | None = None) -> Ordered:
        """Other keys at least as fine, or another order: nothing to look for if no group was too large."""
        groups = None if self.groups.split else Groups(tuple(keys), tuple(order), None)
        return Ordered(self.frame if df is None else df, keys, order, groups)

    def _running(self):
        return self.groups.window().rowsBetween(Window.unboundedPreceding, 0)

    def _following(self):
        return self.groups.window().rowsBetween(0, Window.unboundedFollowing)

    def _whole(self):
        return Window.partitionBy(*self.groups.partition)

    def _carry(self, per_piece: Mapping[str, Column], across: Mapping[str, Column]) -> DataFrame:
        """Summarise each piece, then combine the summaries of a group in piece order."""
        pieces = self._df.where(F.col(PIECE) > 0).groupBy(*self.keys, PIECE)
        pieces = pieces.agg(*[c.alias(n) for n, c in per_piece.items()])
        return pieces.select(*self.keys, PIECE, *[c.alias(n) for n, c in across.items()])

    def _join_carry(self, carry: DataFrame) -> DataFrame:
        keys = [*self.keys, PIECE]
        side = carry.select(*[F.col(c).alias(f"__k_{c}") if c in keys else F.col(c) for c in carry.columns])
        # one row per piece, at most 2 * parts of them
        joined = self._df.join(F.broadcast(side), same_keys(self._df, side, keys, "__k_"), "left")
        return joined.drop(*[f"__k_{k}" for k in keys])

    def _pieces(self):
        return Window.partitionBy(*self.keys).orderBy(PIECE)

    def _earlier(self):
        return self._pieces().rowsBetween(Window.unboundedPreceding, -1)

    def _later(self):
        return self._pieces().rowsBetween(1, Window.unboundedFollowing)

    def _all_pieces(self):
        return Window.partitionBy(*self.keys)

    def number(self, out: str) -> Ordered:
        """1, 2, 3, ... within the group."""
        df = self._df
        local = F.row_number().over(self.groups.window()).cast("bigint")
        if self.groups.split:
            carry = self._carry({"__n": F.count(F.lit(1))}, {"__before": F.sum("__n").over(self._earlier())})
            df = self._join_carry(carry)
            local = local + F.coalesce(F.col("__before"), F.lit(0))
        return self._with(df.withColumn(out, local).drop("__before"))

    def size(self, out: str) -> Ordered:
        """Number of rows of the group, on each of its rows."""
        df = self._df
        local = F.count(F.lit(1)).over(self._whole())
        if self.groups.split:
            carry = self._carry({"__n": F.count(F.lit(1))}, {"__all": F.sum("__n").over(self._all_pieces())})
            df = self._join_carry(carry)
            local = F.coalesce(F.col("__all"), local)
        return self._with(df.withColumn(out, local).drop("__all"))

    def running_total(self, value: str, out: str) -> Ordered:
        """Sum of ``value`` from the start of the group to this row."""
        df = self._df
        local = F.sum(value).over(self._running())
        if self.groups.split:
            carry = self._carry({"__s": F.sum(value)}, {"__before": F.sum("__s").over(self._earlier())})
            df = self._join_carry(carry)
            before = F.col("__before")
            local = F.when(before.isNull(), local).otherwise(before + F.coalesce(local, F.lit(0)))
        return self._with(df.withColumn(out, local).drop("__before"))

    def shift(self, outs: Mapping[str, tuple[str, int]]) -> Ordered:
        """``{new: (column, n)}``: the value ``n`` rows earlier, or ``-n`` rows later if negative."""
        window = self.groups.window()
        if not self.groups.split:
            shifted = {o: F.lag(c, n).over(window) for o, (c, n) in outs.items()}
            return self._with(self._df.withColumns(shifted))
        reach = max(abs(n) for _, n in outs.values())
        df = self._df.withColumn("__pos", F.row_number().over(window))
        df = df.withColumn("__rest", F.count(F.lit(1)).over(self._whole()) - F.col("__pos"))
        df = df.withColumns({f"__l_{o}": F.lag(c, n).over(window) for o, (c, n) in outs.items()})
        # rows within reach of a cut: at most 2 * reach per piece
        near = df.where((F.col(PIECE) > 0) & ((F.col("__pos") <= reach) | (F.col("__rest") < reach)))
        edge = Window.partitionBy(*self.keys).orderBy(PIECE, "__pos")
        near = near.select(
            *[F.col(k).alias(f"__k_{k}") for k in self.keys],
            F.col(PIECE).alias("__k_piece"),
            F.col("__pos").alias("__k_pos"),
            *[F.lag(c, n).over(edge).alias(f"__e_{o}") for o, (c, n) in outs.items()],
        )
        on = (df[PIECE] == near["__k_piece"]) & (df["__pos"] == near["__k_pos"])
        if self.keys:
            on = on & same_keys(df, near, self.keys, "__k_")
        # at most 2 * reach rows for each of 2 * parts pieces
        bounded = 4 * reach * limits(df)[1] <= BROADCAST_ROWS
        df = df.join(F.broadcast(near) if bounded else near, on, "left")
        for o, (_, n) in outs.items():
            at_cut = (F.col("__pos") <= n) if n > 0 else (F.col("__rest") < -n)
            crossed = (F.col(PIECE) > 0) & at_cut
            df = df.withColumn(o, F.when(crossed, F.col(f"__e_{o}")).otherwise(F.col(f"__l_{o}")))
        helpers = [c for c in df.columns if c.startswith(("__k_", "__e_", "__l_"))]
        return self._with(df.drop("__pos", "__rest", *helpers))

    def fill(self, columns: Sequence[str], direction: str = "down") -> Ordered:
        """Replace nulls by the nearest earlier (down) or later (up) value; updown and downup try both."""
        steps = {"down": ["down"], "up": ["up"], "updown": ["up", "down"], "downup": ["down", "up"]}[direction]
        df, new = self._df, {}
        if self.groups.split:
            known = {c: F.when(F.col(c).isNotNull(), self.groups.order_value()) for c in columns}
            earlier, later, ends, across = self._earlier(), self._later(), {}, {}
            for i, c in enumerate(columns):
                if "down" in steps:
                    ends[f"__x{i}"] = F.max_by(F.col(c), known[c])
                    across[f"__down{i}"] = F.last(f"__x{i}", ignorenulls=True).over(earlier)
                if "up" in steps:
                    ends[f"__y{i}"] = F.min_by(F.col(c), known[c])
                    across[f"__up{i}"] = F.first(f"__y{i}", ignorenulls=True).over(later)
            df = self._join_carry(self._carry(ends, across))
        running, following = self._running(), self._following()
        for i, c in enumerate(columns):
            found = []
            for step in steps:
                if step == "down":
                    found.append(F.last(c, ignorenulls=True).over(running))
                else:
                    found.append(F.first(c, ignorenulls=True).over(following))
                if self.groups.split:
                    found.append(F.col(f"__{step}{i}"))
            new[c] = F.coalesce(*found)
        filled = df.withColumns(new)
        helpers = [c for c in filled.columns if c.startswith(("__down", "__up"))]
        return self._with(filled.drop(*helpers))

    def impute_mean(self, columns: Sequence[str]) -> Ordered:
        """Replace nulls by the mean of the group's known values."""
        if self.groups.split:
            # a mean needs no order: rows of one order value cannot be cut, but their sums can
            from pacegrid.operators.joins import salted_join

            means = self._df.groupBy(*self.keys).agg(
                *[F.avg(F.col(c).cast("double")).alias(f"__mean{i}") for i, c in enumerate(columns)]
            )
            df = salted_join(self._df, means, self.keys)
            mean = {c: F.col(f"__mean{i}") for i, c in enumerate(columns)}
        else:
            df = self._df
            mean = {c: F.avg(c).over(self._whole()) for c in columns}
        filled = df.withColumns({c: F.coalesce(F.col(c).cast("double"), mean[c]) for c in columns})
        return self._with(filled.drop(*[f"__mean{i}" for i in range(len(columns))]))


def global_ordinal(
    df: DataFrame, order: Sequence[str], out: str, known: Profile | None = None, drop: Sequence[str] = ()
) -> DataFrame:
    """Position of each row in the whole table, without the columns of ``drop``.

    A table beyond the bound is sorted by ranges and written once, each row with its place in its range;
    what comes before a range is a sum over one count per range. ``known`` is a bound counted before.
    """
    most, parts = limits(df)
    rows = known.most(()) if known else None
    rows = df.count() if rows is None else rows
    if rows <= most:
        return Ordered(df, (), order, Groups((), tuple(order), None)).number(out).frame.drop(*drop)
    by = [F.col(c).asc_nulls_last() for c in order]
    ranged = df.repartitionByRange(max(parts, math.ceil(rows / most)), *by).sortWithinPartitions(*by).drop(*drop)
    # the lower 33 bits count the rows of a partition
    local = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) + 1
    placed = settle(ranged.withColumns({out: local, "__range": F.spark_partition_id()}))
    counts = placed.groupBy("__range").agg(F.max(out).alias("__n"))
    # one row per range
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("__range", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    numbered = placed.join(F.broadcast(before), "__range")
    return numbered.withColumn(out, F.col(out) + F.col("__before")).drop("__range", "__before")
