"""Reading the given tables, and joining rows to per-group facts when one group is very large."""

from __future__ import annotations

import tempfile
from functools import lru_cache
from pathlib import Path
from zipfile import ZipFile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that Python's ``\s`` and the contracts' word rule have in common.
WHITE = r"\x20\x09-\x0D"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def parts(df: DataFrame) -> int:
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def attach_group(rows: DataFrame, groups: DataFrame, key: str, size: str, row_key: str) -> DataFrame:
    """Join ``rows`` to ``groups`` (one row per ``key`` with its row count ``size``), hot keys salted.

    Groups above an average partition are at most ``parts`` many; only those are repeated, and their
    rows are dealt over the repeats by the hash of ``row_key``. Every row of ``rows`` has its group.
    """
    n = parts(rows)
    limit = max(1, rows.count() // n)
    hot = groups.where(F.col(size) > limit).select(F.col(key).alias("__hot"))
    salt = F.when(F.col("__hot").isNotNull(), F.pmod(F.xxhash64(row_key), F.lit(n))).otherwise(F.lit(0))
    # at most n rows, by the choice of the limit
    rows = rows.join(F.broadcast(hot), F.col(key).eqNullSafe(F.col("__hot")), "left")
    rows = rows.withColumn("__salt", salt.cast("long")).drop("__hot")
    last = F.when(F.col(size) > limit, F.lit(n - 1)).otherwise(F.lit(0)).cast("long")
    groups = groups.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return rows.join(groups, [key, "__salt"]).drop("__salt")


def whole(docs: DataFrame) -> DataFrame:
    """Each row as the one column ``row``, so that no column of the caller meets one of an operator."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def ids_repeat(docs: DataFrame) -> bool:
    """Whether an id stands on several rows, which then have to be told apart by more than the id."""
    return not docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


@lru_cache(maxsize=2)
def _packed(application: str) -> str:
    """This package as a zip file, once for each Spark application."""
    top = Path(__file__).resolve().parents[1]
    name = f"{tempfile.mkdtemp(prefix='pacegrid-')}/pacegrid.zip"
    with ZipFile(name, "w") as out:
        for path in sorted(top.rglob("*.py")):
            out.write(path, path.relative_to(top.parent))
    return name


def ship(spark: SparkSession) -> None:
    """Python workers import the package, so Spark hands it to every executor."""
    context = spark.sparkContext
    name = _packed(context.applicationId)
    if not any(f.endswith("/pacegrid.zip") for f in context.listFiles):
        context.addPyFile(name)
