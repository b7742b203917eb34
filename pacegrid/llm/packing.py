"""Packing documents into sequences by swap-based local search (method of the dealt operator 5).

Pieces are dealt at random into shards of some ten thousand, each packed in one task: best fit gives
the first packing, then pieces are moved and exchanged between underfull bins. Every change raises
the sum of squared fills, so the emptiest bins run dry, until no bin fewer can hold the pieces or no
change is left. A shard wastes less than a bin or so, whatever the size of the table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pacegrid.llm.memo import ids_of
from pacegrid.session import settle

SIZE = 4096
#: Pieces of a shard on average.
SHARD = 40_000


def pieces(docs: DataFrame, path: str, cutter: str = "words", end: int = 1, size: int = SIZE) -> DataFrame:
    """``doc_id, piece, start, length, ids`` (little-endian unsigned 32-bit), in a scan.

    A document is its token ids and the end id; only one longer than ``size`` is cut. Null and empty
    texts are the end id alone. Repeated rows and ids give pieces of their own.
    """
    rows = docs.select("doc_id", "text")
    fields = [rows.schema["doc_id"], *[T.StructField(n, t) for n, t in (("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids", T.BinaryType()))]]

    def cut(batches):
        import pyarrow as pa

        memo, last = ids_of(path, cutter), end.to_bytes(4, "little")

        def batch_of(found, kind):
            columns = list(zip(*found))
            kinds = [kind, pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            return pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids"])

        for batch in batches:
            found, held = [], 0
            kind = batch.schema.field("doc_id").type
            texts = (t.as_py() for t in batch.column("text"))
            for doc, raw in zip(batch.column("doc_id").to_pylist(), memo(texts)):
                raw += last
                held += len(raw)
                for n, at in enumerate(range(0, len(raw), 4 * size)):
                    ids = raw[at : at + 4 * size]
                    found.append((doc, n, at // 4, len(ids) // 4, ids))
                if held > 1 << 23:
                    yield batch_of(found, kind)
                    found, held = [], 0
            if found:
                yield batch_of(found, kind)

    return rows.mapInArrow(cut, T.StructType(fields))


def best_fit(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Bins of positions: longest first, each into the fullest bin it fits."""
    bins: list[list[int]] = []
    room: list[list[int]] = [[] for _ in range(size + 1)]
    some = 0  # bit r: a bin has r left
    sizes = lengths.tolist()
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = sizes[i]
        above = some >> n
        if above:
            left = n + (above & -above).bit_length() - 1
            b = room[left].pop()
            if not room[left]:
                some &= ~(1 << left)
            bins[b].append(i)
        else:
            left, b = size, len(bins)
            bins.append([i])
        left -= n
        if left:
            room[left].append(b)
            some |= 1 << left
    return bins


def local_search(bins: list[list[int]], lengths: np.ndarray, size: int, tries: int = 64) -> list[list[int]]:
    """Empty bins by moving one piece, or exchanging one or two for one, between underfull bins.

    The donor is the emptiest bin not tried since the last change of the bin count; it gives to fuller
    bins only, the change that fills one most, so squared fill always grows. ``tries`` donors in a
    row without emptying one end the search.
    """
    fewest = -(-int(lengths.sum()) // size)
    full = [b for b in bins if lengths[b].sum() == size]
    rest = sorted((b for b in bins if lengths[b].sum() != size), key=lambda b: int(lengths[b].sum()))
    failed = 0
    while len(full) + len(rest) > fewest and failed < min(tries, len(rest)):
        donor = rest.pop(failed)
        fill = np.array([lengths[b].sum() for b in rest], np.int64)
        items = np.concatenate([np.asarray(b, np.int64) for b in rest])
        home = np.repeat(np.arange(len(rest)), [len(b) for b in rest])
        own = list(donor)
        while own:
            have = int(lengths[own].sum())
            best = None  # gain, pieces given, bin that takes them, piece taken back (-1: none)
            for given in [(a,) for a in own] + [(a, b) for k, a in enumerate(own) for b in own[:k]]:
                n = int(lengths[list(given)].sum())
                if len(given) == 1:
                    fits = np.flatnonzero((fill + n <= size) & (fill + n > have))
                    if len(fits):
                        to = int(fits[np.argmax(fill[fits])])
                        best = max(best or (0,), (2 * size + int(fill[to]) + n, given, to, -1), key=lambda x: x[0])
                more = n - lengths[items]
                after = fill[home] + more
                good = np.flatnonzero((more > 0) & (after <= size) & (after > have))
                if len(good):
                    at = int(good[np.argmax(after[good])])
                    best = max(best or (0,), (int(after[at]), given, int(home[at]), at), key=lambda x: x[0])
            if best is None:
                break
            _, given, to, at = best
            for a in given:
                own.remove(a)
            if at >= 0:
                own.append(int(items[at]))
                fill[to] -= lengths[items[at]]
                keep = np.arange(len(items)) != at
                items, home = items[keep], home[keep]
            fill[to] += lengths[list(given)].sum()
            items = np.append(items, given)
            home = np.append(home, [to] * len(given))
        rest = [items[home == b].tolist() for b in range(len(rest))]
        if own:
            failed += 1
            rest.append(own)
        else:
            failed = 0
        full += [b for b in rest if lengths[b].sum() == size]
        rest = sorted((b for b in rest if lengths[b].sum() != size), key=lambda b: int(lengths[b].sum()))
    return full + rest


def pack(rows: DataFrame, size: int = SIZE, shard: int = SHARD) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with a ``length`` of 1 to ``size``.

    All other columns pass through, but for ones of these two names, which are replaced. Equal rows
    are packed like any others; no rows give no sequences.
    """
    rows = rows.drop("sequence_id", "offset")
    settled = settle(rows.withColumn("__deal", F.xxhash64(F.monotonically_increasing_id())))
    shards = max(1, settled.count() // shard)
    dealt = settled.withColumn("__deal", F.pmod("__deal", F.lit(shards)))
    schema = T.StructType([f for f in rows.schema] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    names = rows.columns

    def fill(key, table):
        import pyarrow as pa

        lengths = table.column("length").to_numpy()
        bins = local_search(best_fit(lengths, size), lengths, size)
        order = np.concatenate([np.asarray(b, np.int64) for b in bins])
        number = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
        ends = np.cumsum(lengths[order])
        opens = np.r_[True, number[1:] != number[:-1]]
        base = np.repeat((ends - lengths[order])[opens], np.diff(np.r_[np.flatnonzero(opens), len(order)]))
        sequence, offset = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        sequence[order] = number + (key[0].as_py() << 32)
        offset[order] = ends - lengths[order] - base
        return table.select(names).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return dealt.groupBy("__deal").applyInArrow(fill, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves, ``sequence_id, length, ids``, from packed pieces with their ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["ids"]))
    rows = packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), joined.alias("ids"))
    return rows


def packed_documents(docs: DataFrame, path: str, size: int = SIZE) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for all pieces of ``docs``."""
    digest = F.crc32("ids").alias("ids_crc32")
    rows = pieces(docs, path, size=size).select("doc_id", "piece", "start", "length", digest)
    return pack(rows, size)
