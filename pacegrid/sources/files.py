"""CSV in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_QUOTED = {"header": True, "quote": '"', "escape": '"'}


def read_csv(spark: SparkSession, path: str, schema: T.StructType, sequence: str | None = None) -> DataFrame:
    """CSV with a header; columns are found by their name there, whatever their order.

    Cells are quoted with quotes doubled. An empty cell or ``NA`` is null, and so is one that is not
    of its column's type. A column of the schema that no file has raises; others are left out.
    ``sequence`` names a column that orders rows as they stand in the files: by file, by block of the
    file, and by position in the block. It is only good for sorting, never as a stored key.
    """
    df = spark.read.options(**_QUOTED, nullValue="NA", enforceSchema=False).csv(path)
    absent = [c for c in schema.names if c not in df.columns]
    if absent:
        raise ValueError(f"{path} has no column {', '.join(absent)}; it has {', '.join(df.columns)}")
    place = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    known = {f.name: F.when(F.col(f"`{f.name}`") != "", F.col(f"`{f.name}`")) for f in schema.fields}
    cells = [known[f.name].try_cast(f.dataType).alias(f.name) for f in schema.fields]
    return df.select(*cells, *([place.alias(sequence)] if sequence else []))


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """Write with a header, quotes doubled. ``single`` makes one file and is for small final results only."""
    out = df.coalesce(1) if single else df
    out.write.mode("overwrite").options(**_QUOTED).csv(path)
