"""Nearest neighbours by a block matrix join (method of the dealt operator 8).

Vectors are rounded to int8 with a scale of their own; the length of the rounding error is kept.
Queries and candidates meet in tiles. A tile's int8 products give distances that are off by at most
the two error lengths, so only pairs that can still be among the nearest are computed again, in
double precision on the original vectors. Heaps merge the tiles' answers. The result is exact.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Queries of a block, candidates of a tile.
QUERIES, TILE = 1024, 8192
EVERY, NEAREST = 100, 10


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, embedding`` as doubles, of the rows that take part; a null id takes no part."""
    values = F.col("embedding")
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    good = (F.size(values) > 0) & ~F.exists(values, bad) & F.exists(values, lambda v: v != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.where(F.col("vec_id").isNotNull() & values.isNotNull() & good)


def rounded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, scale, and an upper bound of the error's length, for each row of a matrix."""
    scale = np.abs(x).max(1) / 127
    scale = np.where(scale > 0, scale, np.finfo(float).tiny)
    q = np.clip(np.rint(x / scale[:, None]), -127, 127)
    off = x - q * scale[:, None]
    return q.astype(np.int8), scale, np.sqrt((off * off).sum(1)) * (1 + 1e-9)


def tile(query_ids: np.ndarray, query: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int):
    """For each query its ``k`` nearest rows of the tile: ``[(score, vec_id), ...]``."""
    with np.errstate(over="ignore", invalid="ignore"):
        return _tile(query_ids, query, ids, x, k)


def _tile(query_ids, query, ids, x, k):
    (a, sa, ea), (b, sb, eb) = rounded(query), rounded(x)
    # products of int8 sum up exactly in a float32 to 1,040 dimensions, in a float64 beyond
    kind = np.float32 if query.shape[1] <= 1040 else np.float64
    dots = (a.astype(kind) @ b.astype(kind).T).astype(np.float64)
    na = (a.astype(np.float64) ** 2).sum(1) * sa**2
    nb = (b.astype(np.float64) ** 2).sum(1) * sb**2
    square = na[:, None] + nb[None, :] - 2 * dots * sa[:, None] * sb[None, :]
    # rounding of the sum itself, relative to its terms or at the least double
    loose = 1e-12 * (na[:, None] + nb[None, :]) + np.finfo(float).tiny * query.shape[1]
    near = np.sqrt(np.maximum(square, 0) + loose)
    low = np.sqrt(np.maximum(square - loose, 0)) - ea[:, None] - eb[None, :]
    high = near + ea[:, None] + eb[None, :]
    # squares beyond double say nothing: such pairs are computed again
    lost = ~np.isfinite(square) | np.isnan(low)
    low[lost], high[lost] = -np.inf, np.inf
    own = query_ids[:, None] == ids[None, :]
    high[own], low[own] = np.inf, np.inf
    answers = []
    for i in range(len(query_ids)):
        if len(ids) > k:
            bound = np.partition(high[i], k - 1)[k - 1]
            at = np.flatnonzero((low[i] <= bound) & ~own[i])
        else:
            at = np.flatnonzero(~own[i])
        total = np.zeros(len(at))
        for d in range(query.shape[1]):  # summed in order, as a plain loop would
            total += (x[at, d] - query[i, d]) ** 2
        answers.append(heapq.nsmallest(k, zip(np.sqrt(total).tolist(), ids[at].tolist())))
    return answers


def nearest(vectors: DataFrame, every: int = EVERY, k: int = NEAREST) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row whose id is divisible by ``every`` its ``k`` nearest.

    Score is the Euclidean distance; ties go to the smaller id. Vectors that are null, empty, zero or
    hold null or non-finite values, and rows without an id, are neither query nor candidate; a vector
    is compared with those of its own length. A repeated row is a candidate as often as it is there,
    but never for its own id; a repeated query id is answered once, from the smallest of its vectors.
    """
    rows = usable(vectors).withColumn("dim", F.size("embedding"))
    queries = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("dim", "embedding")).alias("q"))
    queries = queries.select("vec_id", "q.dim", "q.embedding")
    n = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("vec_id") % every == 0, 1))).first()
    tiles, blocks = max(1, n[0] // TILE), max(1, n[1] // QUERIES)
    long = lambda value: F.lit(value).cast("long")
    # a block of queries meets every tile; nothing else is repeated
    deal = F.xxhash64("vec_id", F.lit(1))
    queries = queries.withColumn("block", F.pmod(deal, long(blocks)))
    queries = queries.withColumn("tile", F.explode(F.sequence(long(0), long(tiles - 1))))
    candidates = rows.withColumn("tile", F.pmod(deal, long(tiles)))
    candidates = candidates.withColumn("block", F.explode(F.sequence(long(0), long(blocks - 1))))
    schema = T.StructType([T.StructField(c, t) for c, t in (("query_id", T.LongType()), ("score", T.DoubleType()), ("vec_id", T.LongType()))])

    def matrix(table):
        values = table.column("embedding").combine_chunks()
        flat = values.flatten().to_numpy(zero_copy_only=False)
        return table.column("vec_id").to_numpy(), flat.reshape(table.num_rows, -1)

    def meet(left, right):
        import pyarrow as pa

        found = []
        if left.num_rows and right.num_rows:
            query_ids, query = matrix(left)
            ids, x = matrix(right)
            for at in range(0, len(query_ids), 128):
                some = slice(at, at + 128)
                for q, best in zip(query_ids[some].tolist(), tile(query_ids[some], query[some], ids, x, k)):
                    found += [(q, s, v) for s, v in best]
        columns = list(zip(*found)) if found else [(), (), ()]
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.int64())], ["query_id", "score", "vec_id"])

    met = queries.groupBy("dim", "block", "tile").cogroup(candidates.groupBy("dim", "block", "tile")).applyInArrow(meet, schema)
    final = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])

    def merge(batches):
        """A partition has whole queries, sorted: one heap at a time."""
        import pyarrow as pa

        heap, query = [], None

        def rows_of(query, heap):
            best = sorted((-s, -v) for s, v in heap)
            return [(query, i + 1, v, s) for i, (s, v) in enumerate(best)]

        out = []
        for batch in batches:
            for q, s, v in zip(*(batch.column(c).to_pylist() for c in ("query_id", "score", "vec_id"))):
                if q != query:
                    out += rows_of(query, heap)
                    heap, query = [], q
                (heapq.heappush if len(heap) < k else heapq.heappushpop)(heap, (-s, -v))
            if out:
                yield batch_of(out, pa, final)
                out = []
        out += rows_of(query, heap)
        if out:
            yield batch_of(out, pa, final)

    return met.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(merge, final)


def batch_of(rows, pa, schema):
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], schema.names)


SQL = """
WITH e AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         sqrt(list_reduce(list_prepend(0.0::DOUBLE, list_transform(list_zip(q.v, c.v), lambda z: (z[2] - z[1]) * (z[2] - z[1]))), lambda a, b: a + b)) AS score
  FROM e q JOIN e c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
