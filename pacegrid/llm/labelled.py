"""Labelled rows for fitting a classifier: a bounded sample, and which rows are held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pacegrid.session import settle

#: Rows with this remainder of the id's crc32 are never learned from.
FOLDS, HELD = 5, 0
#: A classifier is fitted on at most so many rows of each label.
EACH = 1500


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from fitting; a row without an id is."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD, F.lit(True))


def sample(docs: DataFrame, labels: DataFrame, label: str, each: int = EACH) -> DataFrame:
    """``doc_id, text, y, fold`` of the rows to learn from, in a settled table.

    At most ``each`` rows of either label: those of the smallest hashes, so the same rows in every
    run. Rows without a label, held-out rows and labels without a document are left out; of several
    labels of one id the largest holds.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col("doc_id")))
    rows = rows.groupBy("doc_id").agg(F.max(label).alias("y")).withColumn("h", F.xxhash64(F.col("doc_id"), F.lit(label)))
    found = [rows.where(F.col("y") == y).orderBy("h", "doc_id").limit(each) for y in (0, 1)]
    chosen = settle(found[0].union(found[1]))
    texts = docs.select(F.col("doc_id").alias("__id"), F.coalesce("text", F.lit("")).alias("text"))
    # at most 2 * each rows
    rows = texts.join(F.broadcast(chosen), F.col("__id") == F.col("doc_id"))
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(5)).cast("int").alias("fold")
    return settle(rows.select("doc_id", "text", F.col("y").cast("int").alias("y"), fold))
