"""Query registry and access to the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pacegrid.session import compile_whole, use_utc


class Tables:
    """``tables.orders`` is the Parquet table of that name; zoneless clocks become UTC timestamps."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        clocks = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
        return df.withColumns({c: F.col(c).cast("timestamp") for c in clocks})


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables)`` under a name, with the same result as SQL where SQL can say it."""

    def register(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            use_utc(spark)
            compile_whole(spark)
            return fn(Tables(spark, folder))

        REGISTRY[name] = Query(run, sql)
        return fn

    return register


def clock_text(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def day_text(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")
