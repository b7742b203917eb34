"""Fitted models by id in a shared folder, found again by any later session."""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from uuid import uuid4

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = "model_id string, score double, unscored bigint, settings string, path string, written bigint"


@dataclass(frozen=True)
class Entry:
    model_id: str
    model: PipelineModel
    score: float | None
    unscored: int = 0
    settings: str = ""


class Registry:
    """A folder of saved models, and a manifest with one row per model.

    Models are written first and then their rows, as a small table of their own, so a row stands for
    models that are whole, and writers at the same time never touch each other's files. An id that was
    written again means the later one.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def add(self, entries: Sequence[Entry]) -> None:
        rows = []
        for e in entries:
            path = f"{self.folder}/models/{uuid4().hex}"
            e.model.write().save(path)
            rows.append((e.model_id, e.score, e.unscored, e.settings, path, time.time_ns()))
        self.spark.createDataFrame(rows, KINDS).coalesce(1).write.parquet(f"{self.folder}/manifest/{uuid4().hex}")

    def table(self) -> DataFrame:
        """The latest row of each id, best score first, missing scores last."""
        names = [f.getPath().toString() for f in self._parts()]
        # a part without its mark is of a writer that was stopped, or is still at it
        done = [n for n in names if self._exists(f"{n}/_SUCCESS")]
        rows = self.spark.read.schema(KINDS).parquet(*done) if done else self.spark.createDataFrame([], KINDS)
        last = rows.groupBy("model_id").agg(F.max_by(F.struct(*rows.columns[1:]), "written").alias("r"))
        return last.select("model_id", "r.*").orderBy(F.asc_nulls_last("score"), "model_id")

    def fetch(self, model_id: str) -> PipelineModel:
        found = self.table().where(F.col("model_id") == model_id).first()
        if found is None:
            raise KeyError(model_id)
        return PipelineModel.load(found["path"])

    def fetch_all(self) -> Mapping[str, PipelineModel]:
        return {r["model_id"]: PipelineModel.load(r["path"]) for r in self.table().select("model_id", "path").collect()}

    def _files(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, name: str) -> bool:
        path, files = self._files(name)
        return files.exists(path)

    def _parts(self) -> list:
        path, files = self._files(f"{self.folder}/manifest")
        return list(files.listStatus(path)) if files.exists(path) else []
