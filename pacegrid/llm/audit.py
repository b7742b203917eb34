"""What each filter removes in every order of filters (method of the dealt operator 12).

A document's failures are a mask of five bits. Documents are counted by part and mask, at most 32
counts a part, and the counts of a part become a decision diagram: one level a filter, a passing and
a failing branch, equal sub-diagrams kept once, and in every node the documents that reach it. The
diagram is taken through all orders by swaps of adjacent levels; in each order the path on which
every filter passes gives what the steps keep and remove.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pacegrid.llm.tables import WHITE, attach_group
from pacegrid.operators.joins import lookup_join
from pacegrid.session import settle

FILTERS = "ABCDE"
#: The last filter needs the whole table, the others the text alone.
REPEATED = 1 << FILTERS.index("E")
SUMS = ("n", "good", "toxic")


def text_failures(text: Column) -> Column:
    """Bits 0 to 3: under 200 words; few distinct words; many capitals; odd marks."""
    white = "".join(map(chr, (0x20, *range(0x09, 0x0E))))
    bare = F.btrim(text, F.lit(white))
    words = F.split(bare, f"[{WHITE}]+")
    n = F.when(bare == "", 0).otherwise(F.size(words))
    distinct = F.when(bare == "", 0).otherwise(F.size(F.array_distinct(words)))
    failures = [
        n < 200,
        100 * distinct < 50 * n,
        100 * F.regexp_count(text, F.lit("[A-Z]")) > 3 * F.char_length(text),
        text.rlike("[#$%&*|]"),
    ]
    return sum((f.cast("int") * (1 << i) for i, f in enumerate(failures)), F.lit(0))


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, n, good, toxic``: documents by the filters that they fail, and how many have the labels."""
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("t"))
    rows = rows.select("doc_id", "part", text_failures(F.col("t")).alias("mask"), F.unhex(F.sha2(F.encode("t", "UTF-8"), 256)).alias("digest"))
    # rows that repeat an id and its text are one from here on
    rows = settle(rows.groupBy("doc_id", "part", "mask", "digest").agg(F.count(F.lit(1)).alias("n")))
    marks = [F.max((F.col(c) == 1).cast("long")).alias(a) for c, a in (("quality", "good"), ("toxic", "toxic"))]
    known = labels.where("doc_id IS NOT NULL AND (quality = 1 OR toxic = 1)").groupBy("doc_id").agg(*marks)
    marked = lookup_join(rows, settle(known), ["doc_id"])
    marked = marked.withColumns({c: F.col("n") * F.coalesce(F.col(c), F.lit(0).cast("long")) for c in ("good", "toxic")})
    # a text is one group, whoever has it; the smallest id passes
    texts = marked.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows"))
    texts = settle(texts.where("rows > 1"))
    repeated = attach_group(marked, texts, "digest", "rows", "doc_id").where("doc_id > least")
    totals = [F.sum(c).alias(c) for c in SUMS]
    failing = settle(repeated.groupBy("part", "mask").agg(*totals))
    fewer = failing.select("part", "mask", *[(-F.col(c)).alias(c) for c in SUMS])
    more = failing.withColumn("mask", F.col("mask").bitwiseOR(F.lit(REPEATED)))
    every = marked.groupBy("part", "mask").agg(*totals).unionByName(fewer).unionByName(more)
    return every.groupBy("part", "mask").agg(*totals).where("n > 0")


class Diagram:
    """Failure masks with their counts, level by level in some order of the filters.

    A node is a number; ``child`` has its passing and its failing branch, ``weight`` the sums of the
    documents that reach it. Nodes of a level are told apart by their branches, so equal ones are one.
    """

    def __init__(self, counts: Mapping[int, tuple[int, ...]], filters: int = len(FILTERS)):
        self.order = list(range(filters))
        self.child: dict[int, tuple[int, int]] = {}
        self.weight: dict[int, tuple[int, ...]] = {}
        self.levels: list[list[int]] = [[] for _ in range(filters)]
        none, ends = (0,) * len(SUMS), {}

        def end(sums):
            if sums not in ends:
                ends[sums] = self._new(sums)
            return ends[sums]

        below = [end(tuple(counts.get(mask, none))) for mask in range(1 << filters)]
        for level in reversed(range(filters)):
            half, made = 1 << level, {}
            below = [self._node(level, below[m], below[m + half], made) for m in range(half)]
        self.root = below[0]

    def _new(self, sums: tuple[int, ...]) -> int:
        self.weight[len(self.weight)] = sums
        return len(self.weight) - 1

    def _node(self, level: int, passing: int, failing: int, made: dict) -> int:
        if (passing, failing) not in made:
            sums = tuple(a + b for a, b in zip(self.weight[passing], self.weight[failing]))
            made[passing, failing] = node = self._new(sums)
            self.child[node] = (passing, failing)
            self.levels[level].append(node)
        return made[passing, failing]

    def swap(self, level: int) -> None:
        """Exchange a level with the next. Nodes above keep what they are, and so do those below."""
        self.levels[level + 1], made = [], {}
        for node in self.levels[level]:
            passing, failing = self.child[node]
            (a, b), (c, d) = self.child[passing], self.child[failing]
            self.child[node] = (self._node(level + 1, a, c, made), self._node(level + 1, b, d, made))
        order = self.order
        order[level], order[level + 1] = order[level + 1], order[level]

    def steps(self) -> list[tuple[int, tuple[int, ...], tuple[int, ...]]]:
        """(filter, sums kept, sums removed) along the path on which every filter passes."""
        node, out = self.root, []
        for number in self.order:
            passing, failing = self.child[node]
            out.append((number, self.weight[passing], self.weight[failing]))
            node = passing
        return out

    def only(self, number: int) -> int:
        """Documents that fail this filter and no other."""
        node = self.root
        for level in self.order:
            node = self.child[node][level == number]
        return self.weight[node][0]


def adjacent_swaps(n: int) -> Iterator[int]:
    """Levels to exchange with the next, one after another, so that all orders of n levels come up."""
    if n < 2:
        return
    down = True
    inner = adjacent_swaps(n - 1)
    while True:
        yield from (range(n - 2, -1, -1) if down else range(n - 1))
        try:
            # the outermost level stands at the front after going down, so the others begin one later
            yield next(inner) + (1 if down else 0)
        except StopIteration:
            return
        down = not down


def part_steps(part: str, counts: Mapping[int, tuple[int, ...]]) -> pd.DataFrame:
    """Every step of every order of one part."""
    diagram, rows = Diagram(counts), []
    alone = [diagram.only(f) for f in range(len(FILTERS))]

    def note():
        name = "".join(FILTERS[f] for f in diagram.order)
        for at, (number, kept, removed) in enumerate(diagram.steps(), 1):
            rows.append((part, name, at, number, kept[0], *removed))

    note()
    for level in adjacent_swaps(len(FILTERS)):
        diagram.swap(level)
        note()
    out = pd.DataFrame(rows, columns=["part", "filter_order", "step", "filter", "kept", "removed", "good_lost", "toxic_lost"])
    by_filter = out.groupby("filter")["removed"]
    # what a filter removes as the first one is all that fails it
    out["redundant"] = by_filter.transform("max") - out["removed"]
    out["unique_fails"] = out["filter"].map(lambda f: alone[f])
    out["shapley"] = by_filter.transform("sum")
    return out.drop(columns="filter")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the five filters, and step.

    ``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley``. Null text is empty, null language the part of the empty string. A repeated row fails
    the filter on repeated texts only if a smaller id has the same text; a row without id never fails
    it and makes no other fail. A document counts as good or toxic if any label row of its id says so.
    Other columns are not read; an empty table gives no rows.
    """
    counts = mask_counts(docs, labels)
    kinds = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
    names = [k.split()[0] for k in kinds.split(", ")]

    def audit(rows: pd.DataFrame) -> pd.DataFrame:
        sums = {int(r.mask): tuple(int(getattr(r, c)) for c in SUMS) for r in rows.itertuples()}
        return part_steps(rows["part"].iloc[0], sums)[names]

    return counts.groupBy("part").applyInPandas(audit, kinds)


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d),
l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
         + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::INT
         + 8 * regexp_matches(t, '[#$%&*|]')::INT
         + 16 * coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false)::INT AS mask
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
m AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
x AS (SELECT unnest(range(5)) AS i),
o AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (
  SELECT o, array_to_string(list_transform(o, lambda i: substr('ABCDE', i + 1, 1)), '') AS filter_order, step,
         (1 << o[step])::INT AS bit, list_sum(list_transform(o[1:step - 1], lambda i: 1 << i)) AS before
  FROM o, (SELECT unnest(range(1, 6))::INT AS step)),
r AS (
  SELECT part, filter_order, step, bit,
         sum(CASE WHEN mask & (coalesce(before, 0)::INT | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
         sum(CASE WHEN mask & coalesce(before, 0)::INT = 0 AND mask & bit > 0 THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN mask & coalesce(before, 0)::INT > 0 AND mask & bit > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
         sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN mask & coalesce(before, 0)::INT = 0 AND mask & bit > 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
         sum(CASE WHEN mask & coalesce(before, 0)::INT = 0 AND mask & bit > 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM s, m GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM r
"""
