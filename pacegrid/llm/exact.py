"""Exact duplicates by a tree merge of sorted digest runs (method of the dealt operator 6).

Rows are dealt into runs by the hash of their id. A run keeps one entry per digest: the row that
stays and the number of equal rows. In each round the runs of a block of ``FAN`` neighbours are
merged, as in a binomial reduction, so an entry meets at most ``FAN`` others of its digest in a
task, however often a text is repeated. Afterwards the winners travel back down the same tree.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pacegrid.llm.tables import WHITE, ids_repeat, parts, whole
from pacegrid.session import settle

FAN = 16

#: What has to agree for texts to count as equal: the digest, verified by length and a second hash.
SAME = ["text_sha256", "n_bytes", "check"]


def normalised(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{WHITE}]", "")


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id``, code points of the original text, and what identifies the normalised text."""
    rows = docs.select("doc_id", F.char_length(F.coalesce("text", F.lit(""))).alias("points"), normalised(F.col("text")).alias("t"))
    return rows.select(
        "doc_id",
        "points",
        F.sha2(F.encode("t", "UTF-8"), 256).alias("text_sha256"),
        F.octet_length("t").alias("n_bytes"),
        F.xxhash64("t").alias("check"),
    )


def _best() -> Column:
    """The longest row, then the smallest id; a null id only if there is no other."""
    return F.min(F.struct((-F.col("points")).alias("p"), F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("id")))


def group_exact(docs: DataFrame, settled: DataFrame | None = None) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Null and white-space-only texts are all equal to the empty text. Of equal texts the one with the
    most code points stays, then the smallest ``doc_id`` (null last). If the row that stays is itself
    repeated, one of the repeats has ``kept``. Other columns are not read; an empty table gives none.
    """
    rows = settle(digests(docs)) if settled is None else settled
    leaves = FAN
    while leaves < parts(rows):
        leaves *= FAN
    # the run number has to be the same in every attempt of a task, so it comes from the id
    leaf = F.pmod(F.xxhash64("doc_id"), F.lit(leaves)).alias("run")
    rows = rows.select("*", leaf).repartition("run", *SAME)
    rows = rows.groupBy("run", *SAME, "doc_id", "points").agg(F.count(F.lit(1)).alias("times"))
    levels = [rows.groupBy("run", *SAME).agg(_best().alias("best"), F.sum("times").alias("size"))]
    while leaves > 1:
        up = levels[-1].withColumn("run", F.floor(F.col("run") / FAN))
        levels.append(up.groupBy("run", *SAME).agg(F.min("best").alias("best"), F.sum("size").alias("size")))
        leaves //= FAN

    def down(winners: DataFrame, below: DataFrame) -> DataFrame:
        own = below.select("run", *SAME, F.floor(F.col("run") / FAN).alias("up"))
        return own.join(winners.withColumnRenamed("run", "up"), ["up", *SAME]).drop("up")

    leaf_winners = reduce(down, reversed(levels[:-1]), levels[-1])
    found = rows.join(leaf_winners, ["run", *SAME])
    copy = F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy")
    found = found.select("doc_id", "points", "best", "size", "text_sha256", copy)
    kept = F.col("doc_id").eqNullSafe(F.col("best.id")) & (F.col("copy") == 1) & (F.col("points") == -F.col("best.p"))
    return found.select("doc_id", F.col("best.id").alias("keep_id"), F.col("size").alias("group_size"), kept.alias("kept"), "text_sha256")


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; a repeated row once."""
    kept = group_exact(docs).where("kept").select("keep_id", "text_sha256")
    own = F.sha2(F.encode(normalised(F.col("row.text")), "UTF-8"), 256)
    rows = whole(docs).withColumn("own", own)
    rows = rows.join(kept, F.col("row.doc_id").eqNullSafe(F.col("keep_id")) & (F.col("own") == F.col("text_sha256")), "left_semi")
    if ids_repeat(docs):
        # one id with several equal texts: the longest of them once
        text = F.coalesce("row.text", F.lit(""))
        longest = Window.partitionBy("row.doc_id", "own").orderBy(F.char_length(text).desc(), text)
        rows = rows.withColumn("place", F.row_number().over(longest)).where("place = 1")
    return rows.select("row.*")


SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
w AS (
  SELECT doc_id, text_sha256, first_value(doc_id) OVER o AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size, row_number() OVER o AS place
  FROM t WINDOW o AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM w
"""
