"""Mixing sources to target weights (method of the dealt operator 4).

Every document gets a hash-random key. Within a source, documents lie in key order over equal ranges
of keys; counts per range give each range the number of words before it, a running sum within the
range does the rest, and the source is cut at its exact budget. What goes beyond one pass over the
source is taken from the start of the same order again.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pacegrid.llm.tables import WHITE, ids_repeat, parts, whole
from pacegrid.operators.ordered import global_ordinal
from pacegrid.session import settle

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{WHITE}]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Add ``target`` to ``source, source_size``: the level every source is filled to, by weight.

    Sources by code point (null last) weigh ``weights`` in turn. The level solves
    sum(min(most * size, level * weight)) = share * sum(size). Its left side is concave and piecewise
    linear, so Newton's steps end at the exact level after a few sums over the sources.
    """
    sources = sources.withColumn("__null", F.col("source").isNull())
    ranked = settle(global_ordinal(sources, ["__null", "source"], "__rank"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("__rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = ranked.select("source", "source_size", weight.alias("w"), (F.col("source_size") * float(most)).alias("top"))
    budget, total = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)) * float(share), F.coalesce(F.sum("w"), F.lit(0.0))).first()
    rest, open_weight = float(budget), float(total)
    while open_weight:
        full = F.col("top") * F.lit(open_weight) <= F.col("w") * F.lit(rest)
        tops, weights_left = ranked.agg(
            F.coalesce(F.sum(F.when(full, F.col("top"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("w"))), F.lit(0.0))
        ).first()
        if weights_left == open_weight:
            break
        rest, open_weight = budget - tops, weights_left
    level = F.col("w") * F.lit(rest) / F.lit(open_weight) if open_weight else F.col("top")
    return ranked.select("source", "source_size", F.least(F.col("top"), level).alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for each row of ``docs``.

    A source's taken words sum up to its target rounded down; ``taken`` is at most ``ceil(most)``
    times ``size``. Null and empty texts have size 0 and give nothing; a null source is a source of
    its own. Rows of one id share a key and are ordered by size, equal ones any way round. The result
    is the same in every run. Other columns are not read; an empty table gives an empty result.
    """
    digits = max(2, math.ceil(math.log(4 * parts(docs), 16)))
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), key.alias("key"))
    rows = settle(rows.withColumns({"range": F.substring("key", 1, digits), "null": F.col("source").isNull(), "name": F.coalesce("source", F.lit(""))}))
    place = ["null", "name", "range"]
    ranges = settle(rows.groupBy(*place).agg(F.sum("size").alias("words")))
    name = F.when(~F.col("null"), F.col("name")).alias("source")
    wanted = targets(ranges.groupBy("null", "name").agg(F.sum("words").alias("source_size")).select(name, "source_size"), weights, share, most)
    wanted = wanted.select(F.col("source").isNull().alias("null"), F.coalesce("source", F.lit("")).alias("name"), "source_size", "target")
    # one row per source and key range: 16 ** digits rows of a source at most
    earlier = Window.partitionBy("null", "name").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = ranges.select(*place, F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("before"))
    before = before.join(wanted, ["null", "name"])
    here = Window.partitionBy(*place).orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("within", F.coalesce(F.sum("size").over(here), F.lit(0))).join(before, place)
    start = F.col("before") + F.col("within")
    budget = F.floor("target")
    taken = F.lit(0).cast("long")
    for epoch in range(math.ceil(most)):
        taken += F.greatest(F.lit(0), F.least(F.col("size"), budget - F.col("source_size") * epoch - start))
    return rows.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as rows of ``docs``: a document once for each time it is taken, the one at the cut cut.

    Rows that repeat an id are told apart by their size; equal ones share what is taken evenly enough
    that the sums stand. ``n_chars`` follows a cut text where there is such a column.
    """
    taken = mix(docs, **options).select("doc_id", "size", "taken")
    rows = whole(docs)
    same = F.col("row.doc_id").eqNullSafe(F.col("doc_id"))
    if ids_repeat(docs):
        taken = taken.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "size").orderBy(F.desc("taken"))))
        rows = rows.withColumn("own", n_words(F.col("row.text")))
        rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("row.doc_id", "own").orderBy("row.text")))
        same = same & (F.col("own") == F.col("size")) & (F.col("n") == F.col("nth"))
    rows = rows.join(taken.where("taken > 0"), same)
    passes = F.sequence(F.lit(1).cast("long"), F.ceil(F.col("taken") / F.col("size")))
    rows = rows.select("row", "size", "taken", F.explode(passes).alias("pass"))
    words = F.least(F.col("size"), F.col("taken") - (F.col("pass") - 1) * F.col("size"))
    runs = F.regexp_extract_all("row.text", F.lit(f"[^{WHITE}]+[{WHITE}]*"), F.lit(0))
    cut = F.rtrim(F.array_join(F.slice(runs, F.lit(1), words.cast("int")), ""))
    rows = rows.select("row.*", F.when(words < F.col("size"), cut).alias("__cut"))
    changed = {"text": F.coalesce("__cut", "text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed["n_chars"] = F.coalesce(F.char_length("__cut").cast(kind), F.col("n_chars"))
    return rows.withColumns(changed).select(*docs.columns)


SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '')) AS key,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w
  FROM d GROUP BY source),
r AS (
  SELECT *, 2.0::DOUBLE * source_size AS top,
         1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2.0::DOUBLE * source_size) OVER (
           ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(w) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w
  FROM s),
l AS (SELECT rest, open_w FROM r WHERE top * open_w > w * rest ORDER BY source_size / w, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, least(top, coalesce(w * (SELECT rest FROM l) / (SELECT open_w FROM l), top)) AS target FROM r),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(size, budget - start)) + greatest(0, least(size, budget - source_size - start)))::BIGINT AS taken
FROM p
"""
