"""Session helpers: a local session for tests and the folder shared by executors."""

from __future__ import annotations

import tempfile
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def local_session(cores: str = "8", partitions: int = 8, name: str = "pacegrid") -> SparkSession:
    """Session for tests and benchmarks; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


_SCOPE: ContextVar[list[str] | None] = ContextVar("settled copies of the scope", default=None)


@contextmanager
def scratch(spark: SparkSession):
    """A scope for intermediate tables: those settled in it are deleted at its end.

    Results that read them have to be written or counted within it.
    """
    token = _SCOPE.set([])
    try:
        yield
    finally:
        paths = _SCOPE.get()
        _SCOPE.reset(token)
        for name in paths:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def use_utc(spark: SparkSession) -> None:
    """Clock text is UTC throughout, so parsing and printing must agree on it."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def compile_whole(spark: SparkSession) -> None:
    """Wide rows give generated methods above the 8,000 bytes that the JVM compiles; it would interpret them row by row.

    With this limit Spark runs such a stage as smaller pieces, which are compiled.
    """
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can read and write.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session without that setting gets a
    folder of its own; anywhere else executors would each write to their own disk, so that raises.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="pacegrid-")
        spark.sparkContext.setCheckpointDir(named)
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def shared_path(spark: SparkSession) -> str:
    """A new name in the shared folder; what is written there goes when the scope of ``scratch`` ends."""
    path = f"{shared_dir(spark)}/{uuid4().hex}"
    if (own := _SCOPE.get()) is not None:
        own.append(path)
    return path


def settle(df: DataFrame) -> DataFrame:
    """Compute an intermediate table once: write it to the shared folder and read it back.

    Later passes read only the columns they need, and a lost executor costs a re-read instead of the
    whole lineage. Within ``scratch`` the copy goes when the scope ends, else the folder's owner clears it.
    """
    spark = df.sparkSession
    path = shared_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@dataclass(frozen=True)
class Size:
    """Bounds of a table: it has no more rows and no more bytes."""

    rows: int
    bytes: int

    def times(self, factor: int, extra: int = 0) -> Size:
        """Bounds of a table with up to ``factor`` rows for each of these, each ``extra`` bytes wider."""
        return Size(self.rows * factor, (self.bytes + extra * self.rows) * factor)


def settle_sized(df: DataFrame) -> tuple[DataFrame, Size]:
    """``settle``, with rows and bytes observed while they are written: no pass of its own.

    A task that Spark runs twice may be observed twice, which leaves both numbers bounds from above.
    """
    seen = Observation()
    texts = (T.StringType, T.BinaryType)
    nested = (T.ArrayType, T.MapType, T.StructType, T.VariantType)
    # 16 bytes hold any single value and its null mark
    width = F.lit(16 * len(df.columns)).cast("bigint")
    for f in df.schema.fields:
        if isinstance(f.dataType, texts):
            width = width + F.coalesce(F.octet_length(f.name), F.lit(0))
        elif isinstance(f.dataType, nested):
            width = width + 8 * F.coalesce(F.octet_length(F.to_json(F.struct(f.name))), F.lit(0))
    settled = settle(df.observe(seen, F.count(F.lit(1)).alias("rows"), F.sum(width).alias("bytes")))
    return settled, Size(seen.get["rows"], seen.get["bytes"] or 0)
