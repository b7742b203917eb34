"""Long and wide forms, minute grids, nested rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pacegrid.operators.ordered import Ordered


def unpivot_measures(
    df: DataFrame, ids: Sequence[str], measures: Sequence[str], name: str, value: str
) -> DataFrame:
    """One row per id and measure; rows with a null value stay."""
    return df.unpivot(list(ids), list(measures), name, value)


def pivot_measures(
    df: DataFrame, ids: Sequence[str], names_from: str, names: Sequence[str], values_from: Sequence[str]
) -> DataFrame:
    """One row per id; columns ``{value}_{name}``, or ``{name}`` alone for a single value column.

    The names are given, so no job is needed to find them, and a single aggregation combines on the
    map side. Where an id has several rows of one name the smallest value is taken.
    """
    single = len(values_from) == 1
    cells = [
        F.min(F.when(F.col(names_from) == n, F.col(v))).alias(n if single else f"{v}_{n}")
        for v in values_from
        for n in names
    ]
    return df.groupBy(*ids).agg(*cells)


def session_starts(df: DataFrame, keys: Sequence[str], day: str, clock: str) -> DataFrame:
    """First clock of each (keys, day) and the day's ordinal among the days of its keys."""
    starts = df.groupBy(*keys, day).agg(F.min(clock).alias("__start"))
    # one row per calendar day in a group
    by_day = Window.partitionBy(*keys).orderBy(F.col(day).asc_nulls_last())
    return starts.withColumn("ROW_N", F.row_number().over(by_day))


def minute_grid(
    df: DataFrame,
    keys: Sequence[str],
    day: str,
    clock: str,
    minutes: int = 60,
    index_by: str = "date",
) -> DataFrame:
    """A row for every minute of the first hour of each session, whether observed or not.

    ``T_IDX`` counts minutes within (keys, calendar date), so it starts anew past midnight;
    ``index_by="session"`` counts through.
    """
    return minutes_of(session_starts(df, keys, day, clock), keys, clock, minutes, index_by)


def minutes_of(
    starts: DataFrame, keys: Sequence[str], clock: str, minutes: int = 60, index_by: str = "date"
) -> DataFrame:
    """The grid of sessions whose starts are known, as ``session_starts`` gives them."""
    last = F.col("__start") + F.expr(f"INTERVAL {minutes - 1} MINUTES")
    ticks = F.sequence(F.col("__start"), last, F.expr("INTERVAL 1 MINUTE"))
    grid = starts.withColumn(clock, F.explode(ticks)).drop("__start")
    grid = grid.withColumn("DATE", F.to_date(clock))
    # at most the minutes of one calendar date, twice over
    within = [*keys, "DATE"] if index_by == "date" else [*keys, "ROW_N"]
    return grid.withColumn("T_IDX", F.row_number().over(Window.partitionBy(*within).orderBy("ROW_N", clock)))


def nest(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], out: str, block: int = 1000
) -> DataFrame:
    """Rows of a group as list cells of at most ``block`` elements, numbered by ``block``.

    A group of up to ``block`` rows is one list; a larger one continues in further rows, so that no
    list grows with the table.
    """
    numbered = Ordered(df, keys, order).number("__row").frame
    numbered = numbered.withColumn("block", F.floor((F.col("__row") - 1) / block).cast("int"))
    item = F.struct("__row", *columns)
    listed = numbered.groupBy(*keys, "block").agg(F.sort_array(F.collect_list(item)).alias(out))
    return listed.withColumn(out, F.transform(out, lambda x: x.dropFields("__row")))


def unnest(df: DataFrame, column: str) -> DataFrame:
    others = [c for c in df.columns if c != column]
    return df.select(*others, F.inline(column))
