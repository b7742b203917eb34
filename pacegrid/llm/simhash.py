"""Near-duplicates by SimHash and multi-index hashing (method of the dealt operator 11).

A fingerprint is cut into segments. If two fingerprints differ in at most ``DISTANCE`` bits, they
differ in some segment by no more than its radius, where the radii add up to ``DISTANCE`` less the
number of segments plus one (all above their radius would be too many bits). So each distinct
fingerprint stands in one table per segment under its own value, and asks the tables for all values
of a small Hamming ball around it. Of two values the smaller asks for the larger, so a pair is asked
for from one side only. Sorted by bucket, members pass a task as a stream, and complete distances are
verified within a bucket. Where a bucket is large, its members are cut into blocks, and blocks meet
in pairs. What leaves a bucket is a tie per fingerprint to its part, never a row per pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pacegrid.llm.graph import connected
from pacegrid.llm.tables import attach_group
from pacegrid.session import settle

BITS, WORDS, SEED, DISTANCE = 64, 4, 42, 4
#: Three segments give buckets of 21 bits. Beyond so many distinct fingerprints two of 32 bits cost less.
MANY = 1 << 32
#: Members of a block of a large bucket; shingles, and pairs, that are held at once.
BLOCK, AT_ONCE, PAIRS = 1024, 1 << 16, 1 << 20


def fingerprint(text: str | None, width: int = WORDS) -> int:
    """Majority of the bits of the hashes of all runs of ``width`` words, as a signed 64-bit number.

    A-Z are lower-cased, words split at ASCII white space. Fewer words are one run, none give 0.
    """
    from xxhash import xxh64_digest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n, width = max(1, len(words) - width + 1), min(width, len(words))
    last = ends[width - 1 :].tolist()
    first = [0, *(ends[: n - 1] + 1).tolist()]
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, AT_ONCE):
        some = slice(at, at + AT_ONCE)
        raw = b"".join([xxh64_digest(flat[a:b], SEED) for a, b in zip(first[some], last[some])])
        ones += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, width: int = WORDS) -> DataFrame:
    """``doc_id, fp`` of every row."""
    rows = docs.select("doc_id", "text")
    schema = T.StructType([rows.schema["doc_id"], T.StructField("fp", T.LongType())])

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            found = [fingerprint(t.as_py(), width) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.int64())], schema.names)

    return rows.mapInArrow(read, schema)


def segment_plan(segments: int, distance: int = DISTANCE) -> list[tuple[int, int, int]]:
    """(lowest bit, bits, radius) of each segment; the wider segments come last, with the smaller radii."""
    widths = [(BITS + s) // segments for s in range(segments)]
    spare = distance - segments + 1
    radii = [max(0, (spare + segments - 1 - s) // segments) for s in range(segments)] if spare >= 0 else [0] * segments
    lows = [sum(widths[:s]) for s in range(segments)]
    return list(zip(lows, widths, radii))


def asked(fps: np.ndarray, plan: list[tuple[int, int, int]]) -> Iterator[tuple[np.ndarray, bool, np.ndarray]]:
    """(bucket, whether it asks, fingerprint): a place in each table, and the values of the balls."""
    unsigned = fps.view(np.uint64)
    for s, (low, bits, radius) in enumerate(plan):
        value = ((unsigned >> np.uint64(low)) & np.uint64((1 << bits) - 1)).astype(np.int64)
        own = np.int64(s) << np.int64(40)
        yield own | value, False, fps
        for flipped in range(1, radius + 1):
            masks = np.array([sum(1 << b for b in pick) for pick in combinations(range(bits), flipped)], np.int64)
            for at in range(0, len(masks), 64):
                other = value[:, None] ^ masks[None, at : at + 64]
                larger = other > value[:, None]
                yield own | other[larger], True, np.broadcast_to(fps[:, None], other.shape)[larger]


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ties of the same connected parts as ``a, b``: each node to the least of its part."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def close(fps: np.ndarray, starts: np.ndarray, lefts: np.ndarray, skip: np.ndarray, rights: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ties between each group's first ``lefts`` fingerprints and the ``rights`` ones after ``skip``."""
    pairs = lefts * rights
    for g in np.flatnonzero(pairs > PAIRS // 64):
        right = fps[starts[g] + skip[g] :][: rights[g]]
        rows = max(1, PAIRS // len(right))
        for at in range(0, lefts[g], rows):
            left = fps[starts[g] + at : starts[g] + min(at + rows, lefts[g])]
            off = left[:, None] ^ right[None, :]
            i, j = np.nonzero((np.bitwise_count(off.view(np.uint64)) <= distance) & (off != 0))
            if len(i):
                yield spanning(left[i], right[j])
    small = np.flatnonzero((pairs > 0) & (pairs <= PAIRS // 64))
    upto = np.cumsum(pairs[small])
    at = 0
    while at < len(small):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")))
        some = small[at:end]
        g = np.repeat(some, pairs[some])
        place = np.arange(len(g)) - np.repeat(np.cumsum(pairs[some]) - pairs[some], pairs[some])
        left = fps[starts[g] + place // rights[g]]
        right = fps[starts[g] + skip[g] + place % rights[g]]
        off = left ^ right
        near = (np.bitwise_count(off.view(np.uint64)) <= distance) & (off != 0)
        if near.any():
            yield spanning(left[near], right[near])
        at = end


#: A member of a group is compared as a left one, as both, or as a right one.
LEFT, BOTH, RIGHT = 0, 1, 2


def _blocks(places: DataFrame, large: DataFrame) -> DataFrame:
    """Members of large buckets, copied to the pairs of blocks that they take part in."""
    met = attach_group(places, large, "bucket", "members", "fp")
    rows, columns = F.ceil(F.col("held") / BLOCK).cast("long"), F.ceil(F.col("members") / BLOCK).cast("long")
    met = met.withColumns({"own": F.xxhash64("fp", F.lit(3)), "rows": rows, "columns": columns})
    every = {n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)) for n in ("rows", "columns")}
    left = met.where(~F.col("asks")).select("bucket", F.pmod("own", "rows").alias("i"), every["columns"].alias("j"), F.lit(LEFT).alias("side"), "fp")
    right = met.select("bucket", every["rows"].alias("i"), F.pmod("own", "columns").alias("j"), F.lit(RIGHT).alias("side"), "fp")
    return left.unionByName(right)


def ties(fps: DataFrame, distance: int = DISTANCE, segments: int | None = None) -> DataFrame:
    """``a, b``: links that connect what all links of the distinct ``fps`` connect."""
    segments = segments or (3 if fps.count() <= MANY else 2)
    plan = segment_plan(segments, distance)

    def ask(batches):
        import pyarrow as pa

        for batch in batches:
            for bucket, asks, fp in asked(batch.column("fp").to_numpy(), plan):
                yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(np.full(len(fp), asks)), pa.array(fp)], ["bucket", "asks", "fp"])

    places = settle(fps.select("fp").mapInArrow(ask, "bucket long, asks boolean, fp long"))
    counts = places.groupBy("bucket").agg(F.count_if(~F.col("asks")).alias("held"), F.count(F.lit(1)).alias("members"))
    large = settle(counts.where(F.col("members") > BLOCK))
    none = F.lit(0).cast("long")
    side = F.when(F.col("asks"), RIGHT).otherwise(BOTH).alias("side")
    if large.isEmpty():
        dealt = places.select("bucket", none.alias("i"), none.alias("j"), side, "fp")
    else:
        rest = places.join(large, "bucket", "left_anti")
        dealt = rest.select("bucket", none.alias("i"), none.alias("j"), side, "fp").unionByName(_blocks(places, large.where("held > 0")))
    dealt = dealt.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "side")

    def compare(batches):
        import pyarrow as pa

        kept = None
        for batch in chain(batches, [None]):
            if batch is not None:
                parts = [batch.column(c).to_numpy() for c in ("bucket", "i", "j", "side", "fp")]
                kept = parts if kept is None else [np.concatenate(p) for p in zip(kept, parts)]
            if kept is None or not len(kept[0]):
                continue
            new = np.ones(len(kept[0]), bool)
            new[1:] = (kept[0][1:] != kept[0][:-1]) | (kept[1][1:] != kept[1][:-1]) | (kept[2][1:] != kept[2][:-1])
            starts = np.flatnonzero(new)
            whole = len(kept[0]) if batch is None else starts[-1]  # the last group may go on
            starts = starts[starts < whole]
            if len(starts):
                sizes = np.diff(np.append(starts, whole))
                only_left, only_right = (np.add.reduceat((kept[3][:whole] == s).astype(np.int64), starts) for s in (LEFT, RIGHT))
                for a, b in close(kept[4], starts, sizes - only_right, only_left, sizes - only_left, distance):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
            kept = [p[whole:] for p in kept]

    return settle(dealt.mapInArrow(compare, "a long, b long"))


def near_components(docs: DataFrame, distance: int = DISTANCE, segments: int | None = None, width: int = WORDS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for each row of ``docs``.

    Fingerprints link at ``distance`` or fewer differing bits; ``component_id`` is the smallest id of
    all rows reached over links, the row's own included. Null, empty and blank texts have fingerprint
    zero, which links like any other. A null id stands for a component only if it has no other.
    Repeated rows stay repeated. Other columns are not read; no rows give no rows.
    """
    rows = settle(fingerprints(docs, width))
    classes = settle(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")))
    labels = connected(ties(classes, distance, segments))
    known = classes.join(labels.withColumnRenamed("node", "fp"), "fp", "left")
    known = settle(known.withColumn("label", F.coalesce("label", "fp")))
    heads = known.groupBy("label").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("classes"))
    # a component may hold a third of all fingerprints, a fingerprint a third of all rows
    placed = attach_group(known, heads, "label", "classes", "fp").select("fp", "copies", "component_id")
    out = attach_group(rows, placed, "fp", "copies", "doc_id")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
