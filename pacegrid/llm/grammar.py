"""Token ids in files, compressed by grammars of pairs (method of the dealt operator 7).

Documents lie in ascending id order over shards; a shard is written as blocks of about a million
ids. In a block, rounds of pair replacement (Re-Pair) turn frequent neighbours into nonterminals; a
round takes many pairs at once, most frequent first. A block holds the rules, the number of ids each
rule expands to, the symbols, and where its documents end, so one document can be read without the
others. The files are a Parquet table, so any store that Spark writes to will do.
"""

from __future__ import annotations

from uuid import uuid4
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pacegrid.llm.memo import ids_of
from pacegrid.llm.tables import parts
from pacegrid.session import shared_dir

#: Ids of a block, rounds, rules of a round, uses that make a pair worth a rule.
BLOCK, ROUNDS, RULES, LEAST = 1 << 20, 5, 2048, 16
_SLOTS, _MIX = 17, 0x9E3779B97F4A7C15


def compress(ids: np.ndarray, rounds: int = ROUNDS, rules: int = RULES, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, int]:
    """Symbols, rules (pairs of symbols), and the number that the first rule has as a symbol."""
    first = int(ids.max()) + 1 if len(ids) else 0
    symbols, found, after = ids.astype(np.uint32), [], first
    for _ in range(rounds):
        if len(symbols) < 2:
            break
        # a pair is one number, of half the width while symbols are small: the largest is no pair
        kind, bits = (np.uint32, 16) if after < 1 << 16 else (np.uint64, 32)
        mix, low = kind(_MIX & np.iinfo(kind).max), kind((1 << bits) - 1)
        numbers = symbols.astype(kind, copy=False)
        pairs = numbers[:-1] << kind(bits) | numbers[1:]
        ordered = np.sort(pairs)
        starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
        counts = np.diff(np.r_[starts, len(ordered)])
        often = np.flatnonzero(counts >= least)
        if not len(often):
            break
        often = often[np.argsort(-counts[often], kind="stable")[:rules]]
        chosen = ordered[starts[often]]
        # a slot per pair: of pairs in one slot the most frequent is taken now, others in a later round
        slot = lambda keys: (keys * mix >> kind(2 * bits - _SLOTS)).astype(np.intp)
        table = np.full(1 << _SLOTS, np.iinfo(kind).max, kind)
        number = np.full(1 << _SLOTS, -1, np.int64)
        own = slot(chosen)[::-1]
        table[own], number[own] = chosen[::-1], np.arange(len(chosen))[::-1]
        at = slot(pairs)
        hits = np.flatnonzero(table[at] == pairs)
        # of overlapping hits every second one counts, from the left
        opens = np.r_[True, np.diff(hits) != 1]
        place = np.arange(len(hits)) - np.flatnonzero(opens)[np.cumsum(opens) - 1]
        hits = hits[place % 2 == 0]
        which = number[at[hits]]
        uses = np.bincount(which, minlength=len(chosen))
        worth = uses >= 3  # a rule costs two symbols
        if not worth.any():
            break
        hits, which = hits[worth[which]], which[worth[which]]
        renamed = np.cumsum(worth) - 1
        found.append(np.stack([chosen[worth] >> kind(bits), chosen[worth] & low], 1).astype(np.int64))
        symbols[hits] = after + renamed[which]
        after += int(worth.sum())
        gone = np.zeros(len(symbols), bool)
        gone[hits + 1] = True
        symbols = symbols[~gone]
    rules = np.concatenate(found) if found else np.empty((0, 2), np.int64)
    return symbols.astype(np.int64), rules, first


def expanded(rules: np.ndarray, first: int) -> np.ndarray:
    """Number of ids that each rule stands for."""
    sizes = np.ones(len(rules), np.int64)
    for i, (a, b) in enumerate(rules.tolist()):
        sizes[i] = (sizes[a - first] if a >= first else 1) + (sizes[b - first] if b >= first else 1)
    return sizes


def expand(symbols: np.ndarray, rules: np.ndarray, first: int) -> np.ndarray:
    """The ids that symbols stand for: each rule is expanded once, unless there are fewer symbols than that would give ids."""
    sizes = expanded(rules, first)
    if not len(rules) or first + sizes.sum() > len(symbols):
        return _unfolded(symbols, rules, first)
    flat = np.r_[np.arange(first), _unfolded(np.arange(first, first + len(rules)), rules, first)]
    wide = np.r_[np.ones(first, np.int64), sizes]
    starts, wide = (np.cumsum(wide) - wide)[symbols], wide[symbols]
    ends = np.cumsum(wide)
    return flat[np.repeat(starts - ends + wide, wide) + np.arange(ends[-1])]


def _unfolded(symbols: np.ndarray, rules: np.ndarray, first: int) -> np.ndarray:
    """The ids that symbols stand for, one level of all rules after another."""
    while len(symbols):
        deep = symbols >= first
        if not deep.any():
            break
        wide = 1 + deep
        opens = (np.cumsum(wide) - wide)[deep]
        pair = rules[symbols[deep] - first]
        symbols = np.repeat(symbols, wide)
        symbols[opens], symbols[opens + 1] = pair[:, 0], pair[:, 1]
    return symbols


def between(symbols: np.ndarray, rules: np.ndarray, sizes: np.ndarray, first: int, start: int, end: int) -> np.ndarray:
    """Ids ``start`` to ``end`` of a block, expanding only the symbols that cover them."""
    wide = np.ones(len(symbols), np.int64)
    deep = symbols >= first
    wide[deep] = sizes[symbols[deep] - first]
    ends = np.cumsum(wide)
    a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, end, "left") + 1
    skipped = int(ends[a - 1]) if a else 0
    return expand(symbols[a:b], rules, first)[start - skipped : end - skipped]


def _packed(values: np.ndarray, width: int) -> bytes:
    return values.astype(f"<u{width}").tobytes()


def write(docs: DataFrame, path: str, folder: str | None = None, cutter: str = "spaced", end: int = 2, block: int = BLOCK) -> str:
    """Encode ``docs`` and write the files; returns their folder (a new one in the shared folder).

    Null and empty texts are the end id alone. Rows are in ascending ``doc_id`` order, null first,
    rows of one id by their text. Other columns are not read.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartitionByRange(parts(rows), "doc_id").sortWithinPartitions("doc_id", "text")
    rows = rows.withColumn("shard", F.spark_partition_id().cast("long"))
    binary, long = T.BinaryType(), T.LongType()
    schema = T.StructType(
        [T.StructField(n, t) for n, t in (("shard", long), ("start", long), ("n_ids", long), ("first", long), ("width", T.IntegerType()), ("rules", binary), ("sizes", binary), ("symbols", binary), ("ends", T.ArrayType(long)), ("doc_ids", T.ArrayType(rows.schema["doc_id"].dataType)))]
    )

    def encode(batches):
        import pyarrow as pa

        memo, last = ids_of(path, cutter), end.to_bytes(4, "little")
        start, shard, kind, docs_, raws, held = 0, None, None, [], [], 0

        def blocks():
            nonlocal start, docs_, raws, held
            ids = np.frombuffer(b"".join(raws), "<u4")
            ends = np.cumsum([len(r) // 4 for r in raws])
            symbols, rules, first = compress(ids)
            width = 2 if first + len(rules) < 1 << 16 else 4
            values = [shard, start, len(ids), first, width, _packed(rules, width), _packed(expanded(rules, first), 4), _packed(symbols, width), ends.tolist(), docs_]
            kinds = [pa.int64()] * 4 + [pa.int32()] + [pa.binary()] * 3 + [pa.list_(pa.int64()), pa.list_(kind)]
            start += len(ids)
            docs_, raws, held = [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], schema.names)

        for batch in batches:
            kind = batch.schema.field("doc_id").type
            ids, shards = batch.column("doc_id").to_pylist(), batch.column("shard")
            for i, (doc, raw) in enumerate(zip(ids, memo(t.as_py() for t in batch.column("text")))):
                if shard != shards[i].as_py():
                    if raws:
                        yield blocks()
                    start, shard = 0, shards[i].as_py()
                docs_.append(doc)
                raws.append(raw + last)
                held += len(raws[-1]) // 4
                if held >= block:
                    yield blocks()
        if raws:
            yield blocks()

    folder = folder or f"{shared_dir(docs.sparkSession)}/{uuid4().hex}"
    rows.mapInArrow(encode, schema).write.parquet(folder)
    return folder


def read(spark, folder: str, whole: bool = True) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32, ids`` of every document in the files (ids as 32-bit bytes).

    The checksum is taken of the ids as read, in the task that reads them; ``ids`` themselves are left
    out unless ``whole``.
    """
    files = spark.read.parquet(folder)
    # one row per shard: at most as many as there were partitions
    totals = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(F.col("shard").alias("__shard"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__before"))
    kind = files.schema["doc_ids"].dataType.elementType
    schema = T.StructType([T.StructField("shard", T.LongType()), T.StructField("doc_id", kind), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])
    schema = schema.add("ids", T.BinaryType()) if whole else schema

    def decode(batches):
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                width, first = f"<u{row['width']}", row["first"]
                rules = np.frombuffer(row["rules"], width).astype(np.int64).reshape(-1, 2)
                symbols = np.frombuffer(row["symbols"], width).astype(np.int64)
                ids = expand(symbols, rules, first).astype("<u4").tobytes()
                ends = np.asarray(row["ends"], np.int64)
                starts = np.r_[0, ends[:-1]]
                cuts = [ids[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist())]
                sums = pa.array(list(map(crc32, cuts)), pa.int64())
                kind_ = batch.schema.field("doc_ids").type.value_type
                arrays = [pa.array([row["shard"]] * len(cuts), pa.int64()), pa.array(row["doc_ids"], kind_), pa.array(starts + row["start"]), pa.array(ends - starts), sums]
                arrays += [pa.array(cuts, pa.binary())] if whole else []
                yield pa.RecordBatch.from_arrays(arrays, schema.names)

    rows = files.mapInArrow(decode, schema).join(F.broadcast(before), F.col("shard") == F.col("__shard"))
    return rows.select("doc_id", (F.col("start") + F.col("__before")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if whole else []))


def document(spark, folder: str, doc_id) -> DataFrame:
    """``doc_id, ids`` of one document: its block is found by its id, only its symbols are expanded."""
    files = spark.read.parquet(folder).where(F.array_contains("doc_ids", doc_id))
    kind = files.schema["doc_ids"].dataType.elementType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("ids", T.ArrayType(T.LongType()))])

    def decode(batches):
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                width, first = f"<u{row['width']}", row["first"]
                rules = np.frombuffer(row["rules"], width).astype(np.int64).reshape(-1, 2)
                symbols = np.frombuffer(row["symbols"], width).astype(np.int64)
                sizes = np.frombuffer(row["sizes"], "<u4").astype(np.int64)
                for i, doc in enumerate(row["doc_ids"]):
                    if doc == doc_id:
                        start, end_ = (row["ends"][i - 1] if i else 0), row["ends"][i]
                        ids = between(symbols, rules, sizes, first, start, end_).tolist()
                        kind_ = batch.schema.field("doc_ids").type.value_type
                        yield pa.RecordBatch.from_arrays([pa.array([doc], kind_), pa.array([ids], pa.list_(pa.int64()))], schema.names)

    return files.mapInArrow(decode, schema)
