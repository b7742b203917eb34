"""Stacking frames, tags and row blocks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pacegrid.operators.ordered import global_ordinal


def union_by_name(*frames: DataFrame) -> DataFrame:
    """Stack by column name; a column one frame lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def tagged_union(frames: Mapping[str, DataFrame], tag: str) -> DataFrame:
    """Stack frames, each row marked with the name of its frame."""
    return union_by_name(*[df.withColumn(tag, F.lit(name)) for name, df in frames.items()])


def of_tag(df: DataFrame, tag: str, name: str) -> DataFrame:
    return df.where(F.col(tag) == name)


def row_block(df: DataFrame, order: Sequence[str], block: int, blocks: int) -> DataFrame:
    """The ``block``-th (from 1) of ``blocks`` equal runs of rows in the given order."""
    numbered = global_ordinal(df, order, "row_no")
    size = df.agg((F.count(F.lit(1)) / blocks).alias("n")).scalar()
    low, high = F.floor(size * (block - 1)), F.floor(size * block)
    return numbered.where((F.col("row_no") > low) & (F.col("row_no") <= high))


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence, k: int, out: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group; each map task already drops all but ``k`` before the shuffle."""
    ranked = df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col(out) <= k)
