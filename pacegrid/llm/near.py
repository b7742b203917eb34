"""Near-duplicate documents by n-gram Jaccard (method of the dealt operator 1).

Documents with the same set of word shingles form a copy class; everything after works on classes.
A MinHash LSH forest proposes pairs: each of its trees is a prefix trie of signatures of ``LONGEST``
hashes. A leaf is one number whose leading bits stand for the shortest prefix that can be needed and
whose last digits stand for one further hash each, so leaves sort as the trie does and the prefix
that two classes share is read off their difference.

Matching starts at whole signatures. The pairs that meet there are verified by the exact Jaccard
index of their shingle sets, and the similarities found say which recall this prefix length has in
the data at hand (``shortened``); while it misses the target the prefix is shortened and only pairs
that first meet below are verified. A table of nearly equal copies ends at long prefixes, one with
pairs at the threshold goes down to ``matched_depth``, beyond which no pair needs to be looked for.

A pair belongs to the tree in which it shares most, so it is worked on once. Nodes of many classes,
or of many shingles, are cut by set size and into blocks; blocks of sizes that allow the threshold
meet in pairs in tasks of their own. A task returns a row per class, never a row per pair.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pacegrid.llm.graph import connected as components
from pacegrid.llm.memo import Memo, held
from pacegrid.llm.tables import attach_group, ids_repeat, whole
from pacegrid.session import settle

WORDS, THRESHOLD = 5, 0.8
TREES, LONGEST, RECALL = 24, 8, 0.9999
#: Bits that a leaf keeps of each hash beyond the shortest prefix.
DIGIT = 4
#: Similarities are counted in this many bands, the lowest of which lie this far below the threshold.
BANDS, MARGIN = 25, 0.05
#: Classes and shingles of a block of a large node; features multiplied at once.
BLOCK, SHINGLES, AT_ONCE = 512, 2_000_000, 4096
_RUN = re.compile("[^\x20\x09-\x0d]+")


def meeting(similarity: float, depth: int, trees: int = TREES) -> float:
    """How likely a pair of this similarity shares ``depth`` hashes in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def matched_depth(threshold: float = THRESHOLD, trees: int = TREES, longest: int = LONGEST, recall: float = RECALL) -> int:
    """The longest prefix at which a pair at the threshold meets in one of the trees often enough."""
    depth = longest
    while depth > 1 and meeting(threshold, depth, trees) < recall:
        depth -= 1
    return depth


def band_edges(threshold: float = THRESHOLD) -> np.ndarray:
    """Lower ends of the bands in which similarities are counted; the last band holds 1."""
    low = max(0.0, threshold - MARGIN)
    return low + (1 - low) / BANDS * np.arange(BANDS)


def shortened(counts: list[int], depth: int, threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL) -> int:
    """The prefix length to go on with, by the similarities of the pairs verified so far.

    ``counts`` are pairs found per band. Of a band's links a share ``meeting`` of its lower end is
    found, so that share is its estimated recall. The lowest band with pairs speaks for similarities
    down to ``MARGIN`` below it as well, not below the threshold. Without any pair there is nothing
    to estimate from, and the threshold itself has to be met.
    """
    seen = np.flatnonzero(counts)
    least = max(threshold, float(band_edges(threshold)[seen[0]]) - MARGIN) if len(seen) else threshold
    return min(depth, matched_depth(least, trees, depth, recall))


def _hashes() -> Memo:
    return held("hashes", make=_word_hashes)


def _word_hashes() -> Memo:
    """64-bit hash of each word of a text, remembered by word."""
    from xxhash import xxh3_64_digest

    def cut(text: str) -> list[str]:
        return _RUN.findall(text) if any(c in text for c in "\t\r\f\v") else text.replace("\n", " ").split(" ")

    def ask(word: str) -> bytes:
        return xxh3_64_digest(word.encode()) if word else b""

    return Memo(cut, ask, None, most=150_000)


_FACTORS = np.random.default_rng(7).integers(1, 1 << 63, 32, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(words: np.ndarray, size: int = WORDS) -> np.ndarray:
    """Sorted set of hashes of ``size`` words in a row; a shorter text is one shingle, an empty one none."""
    n = min(size, len(words))
    if not n:
        return np.empty(0, np.uint64)
    total = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        total += words[i : len(words) - n + 1 + i] * _FACTORS[i]
    total ^= total >> np.uint64(32)
    total *= _FACTORS[31]
    total ^= total >> np.uint64(29)
    return np.unique(total)


class Forest:
    """Leaves of a set's signature, one number a tree (see above)."""

    def __init__(self, trees: int, longest: int, shortest: int):
        draw = np.random.default_rng(11)
        self.trees, self.longest, self.shortest = trees, longest, shortest
        self.masks = draw.integers(0, 1 << 63, (trees * longest, 1), dtype=np.uint64)
        self.factors = draw.integers(0, 1 << 62, (trees * longest, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def leaves(self, found: np.ndarray) -> np.ndarray:
        least = None
        for at in range(0, len(found), 1024):
            some = ((found[None, at : at + 1024] ^ self.masks) * self.factors).min(1)
            least = some if least is None else np.minimum(least, some)
        path = least.reshape(self.trees, self.longest)
        total = np.zeros(self.trees, np.uint64)
        for d in range(self.shortest):
            total = (total ^ (path[:, d] >> np.uint64(7))) * _FACTORS[d] + path[:, d]
        digits = DIGIT * (self.longest - self.shortest)
        total = total >> np.uint64(digits) << np.uint64(digits)
        for d in range(self.shortest, self.longest):
            # a least hash is near zero in its high bits; the product spreads the low ones
            digit = path[:, d] * _FACTORS[d] >> np.uint64(64 - DIGIT)
            total |= digit << np.uint64(DIGIT * (self.longest - 1 - d))
        return total.view(np.int64)


def _sets(texts: Iterable[str | None]) -> Iterator[np.ndarray]:
    for raw in _hashes()(texts):
        yield shingles(np.frombuffer(raw, "<u8"))


def _digest(found: np.ndarray) -> bytes:
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(found.tobytes())


def _mark() -> Column:
    return F.xxhash64("text")


def signed(docs: DataFrame, trees: int = TREES, longest: int = LONGEST, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, mark, digest, n, paths``: the set's identity, its size, its leaf in every tree.

    A set so small that no other set can be within the threshold has no paths.
    """
    rows = docs.select("doc_id", _mark().alias("mark"), "text")
    shortest = matched_depth(threshold, trees, longest)
    schema = T.StructType([rows.schema["doc_id"], *[T.StructField(c, t) for c, t in (("mark", T.LongType()), ("digest", T.BinaryType()), ("n", T.IntegerType()), ("paths", T.ArrayType(T.LongType())))]])

    def sign(batches):
        import pyarrow as pa

        forest = Forest(trees, longest, shortest)
        for batch in batches:
            digests, sizes, paths = [], [], []
            for found in _sets(t.as_py() for t in batch.column("text")):
                digests.append(_digest(found))
                sizes.append(len(found))
                paths.append(forest.leaves(found) if len(found) / (len(found) + 1) >= threshold else [])
            arrays = [batch.column("doc_id"), batch.column("mark"), pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), pa.array(paths, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, schema.names)

    return rows.mapInArrow(sign, schema)


def met_here(a: np.ndarray, b: np.ndarray, tree: int, n_a: np.ndarray, n_b: np.ndarray, threshold: float, longest: int, shortest: int) -> np.ndarray:
    """Length of the prefix by which each pair belongs to this tree, 0 where it does not.

    A pair belongs to the first of the trees in which it shares most, if its sizes allow the threshold.
    """
    small, large = np.minimum(n_a[:, None], n_b[None, :]), np.maximum(n_a[:, None], n_b[None, :])
    a, b = a.view(np.uint64), b.view(np.uint64)
    off = a[:, tree, None] ^ b[None, :, tree]
    # a pair that shares d hashes differs by less than ends[longest - d]
    ends = np.uint64(1) << np.uint64(DIGIT) * np.arange(longest - shortest + 1, dtype=np.uint64)
    lacking = np.searchsorted(ends, off.ravel(), "right").reshape(off.shape)
    new = (small >= threshold * large) & (lacking < len(ends))
    end = ends[np.minimum(lacking, len(ends) - 1)]
    if off.size * a.shape[1] <= 1 << 18:
        other = a[:, None, :] ^ b[None, :, :]
        new &= (other[:, :, :tree] >= end[:, :, None]).all(2) & (other[:, :, tree + 1 :] >= (end >> np.uint64(DIGIT))[:, :, None]).all(2)
    else:
        for t in [t for t in range(a.shape[1]) if t != tree]:
            if not new.any():
                break
            new &= (a[:, t, None] ^ b[None, :, t]) >= (end if t < tree else end >> np.uint64(DIGIT))
    return np.where(new, longest - lacking, 0)


def _group(table):
    """Columns of a block pair: own block flag, digests, sizes, paths."""
    paths = table.column("paths").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
    return table.column("left").to_numpy(zero_copy_only=False), table.column("digest").to_pylist(), table.column("n").to_numpy(), paths


def _sides(left: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the two blocks; one block meets itself."""
    every = np.arange(len(left))
    return (every, every) if same else (every[left], every[~left])


def common(a: list[np.ndarray], b: list[np.ndarray], wanted: np.ndarray) -> np.ndarray:
    """Sizes of the wanted intersections of sorted sets, zero elsewhere."""
    out = np.zeros(wanted.shape, np.int64)
    rows, columns = np.nonzero(wanted)
    total = sum(map(len, a)) + sum(map(len, b))
    pairwise = sum((len(a[i]) + len(b[j])) for i, j in zip(rows[:2000], columns[:2000])) * max(1, len(rows) / 2000)
    if len(rows) * 2000 + 15 * pairwise < 40 * total + wanted.size * total / max(1, len(a) + len(b)):
        for i, j in zip(rows.tolist(), columns.tolist()):
            both = np.concatenate([a[i], b[j]])
            both.sort()
            out[i, j] = (both[1:] == both[:-1]).sum()
        return out
    flat = [np.concatenate(side) if side else np.empty(0, np.uint64) for side in (a, b)]
    owner = [np.repeat(np.arange(len(side)), list(map(len, side))) for side in (a, b)]
    shared = np.intersect1d(np.unique(flat[0]), np.unique(flat[1]), assume_unique=True)
    places = []
    for values, own in zip(flat, owner):
        at = np.searchsorted(shared, values)
        at[at == len(shared)] = 0
        hit = shared[at] == values if len(shared) else np.zeros(len(values), bool)
        order = np.argsort(at[hit], kind="stable")
        places.append((at[hit][order], own[hit][order]))
    product = np.zeros(wanted.shape, np.float32)  # exact: a count of shingles stays below 2 ** 24
    exact = max(map(len, [*a, *b])) < 1 << 24
    product = product if exact else product.astype(np.float64)
    for start in range(0, len(shared), AT_ONCE):
        blocks = []
        for (at, own), side in zip(places, (a, b)):
            some = slice(*np.searchsorted(at, [start, start + AT_ONCE]))
            block = np.zeros((len(side), min(AT_ONCE, len(shared) - start)), product.dtype)
            block[own[some], at[some] - start] = 1
            blocks.append(block)
        product += blocks[0] @ blocks[1].T
    out[wanted] = product[wanted].astype(np.int64)
    return out


def _roots(near: np.ndarray, rows: np.ndarray, columns: np.ndarray, n: int) -> np.ndarray:
    """For each of n members the first member of its connected part."""
    label = np.arange(n)
    i, j = np.nonzero(near)
    i, j = rows[i], columns[j]
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _cells(nodes: DataFrame, threshold: float, block: int, shingles_: int) -> DataFrame:
    """``node, tree, digest, i, j, left``: members of nodes with company, per pair of blocks.

    A large node is cut into bands of set sizes, so wide that sizes within the threshold lie in one
    band or in two next to each other, and a band into blocks. A member is copied to the pairs of
    blocks in which it can have a link.
    """
    width = max(math.log(1 / threshold), 0.01) * (1 + 1e-9)
    nodes = nodes.withColumn("band", F.floor(F.log("n") / width))
    sizes = nodes.groupBy("node", "band").agg(F.count(F.lit(1)).alias("c"), F.sum(F.col("n").cast("long")).alias("s"))
    cuts = F.greatest(F.ceil(F.col("c") / block), F.ceil(F.col("s") / shingles_)).cast("long")
    # one entry per band: a few dozen whatever the table
    shared = sizes.groupBy("node").agg(F.sum("c").alias("members"), F.sum("s").alias("total"), F.map_from_entries(F.collect_list(F.struct("band", cuts))).alias("cuts"))
    large = (F.col("members") > block) | (F.col("total") > shingles_)
    shared = settle(shared.where("members > 1").select("node", "members", F.when(large, F.col("cuts")).alias("cuts")))
    met = attach_group(nodes, shared, "node", "members", "digest")
    own = F.pmod(F.xxhash64("digest", F.lit(3)), F.col("cuts")[F.col("band")])

    def code(band: Column, at: Column) -> Column:
        return band * F.lit(1 << 40) + at

    def pairs(step: int, cell) -> Column:
        there = F.col("cuts")[F.col("band") + step]
        cells = F.transform(F.sequence(F.lit(0).cast("long"), there - 1), lambda q: F.struct(*[c.alias(n) for c, n in zip(cell(q), ("i", "j", "left"))]))
        return F.when(there.isNotNull(), cells).otherwise(F.array().cast("array<struct<i:bigint,j:bigint,left:boolean>>"))

    band = F.col("band")
    same = pairs(0, lambda q: (code(band, F.least(own, q)), code(band, F.greatest(own, q)), own <= q))
    above = pairs(1, lambda q: (code(band, own), code(band + 1, q), F.lit(True)))
    below = pairs(-1, lambda q: (code(band - 1, q), code(band, own), F.lit(False)))
    zero = F.lit(0).cast("long")
    one = F.array(F.struct(zero.alias("i"), zero.alias("j"), F.lit(True).alias("left")))
    cells = F.when(F.col("cuts").isNull(), one).otherwise(F.concat(same, above, below))
    return met.select("node", "tree", "digest", F.inline(cells))


def links(classes: DataFrame, docs: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, longest: int = LONGEST, recall: float = RECALL) -> tuple[DataFrame, list[tuple[int, list[int]]]]:
    """``digest, root, links`` from every task that found a class a link: summed up they are all links.

    With them, for each prefix length that was used, the pairs counted per band of similarity there.
    """
    shortest = matched_depth(threshold, trees, longest)
    paths = classes.where(F.size("paths") > 0)
    nodes = paths.select("digest", "n", F.posexplode("paths").alias("tree", "path"))
    shift = DIGIT * (longest - shortest)
    nodes = nodes.select("digest", "n", "tree", F.xxhash64("tree", F.shiftright("path", shift)).alias("node"))
    met = _cells(nodes, threshold, BLOCK, SHINGLES).join(paths.select("digest", "n", "paths"), "digest")
    fields = {"node": T.LongType(), "i": T.LongType(), "j": T.LongType(), "tree": T.IntegerType(), "left": T.BooleanType(), "digest": T.BinaryType()}
    needed_schema = T.StructType([T.StructField(c, t) for c, t in fields.items()]).add("depths", T.IntegerType())

    def needed(key, table):
        """Members with a pair that belongs here, with a bit for every prefix length of such pairs."""
        import pyarrow as pa

        left, _, n, found = _group(table)
        a, b = _sides(left, key[1] == key[2])
        here = met_here(found[a], found[b], table.column("tree")[0].as_py(), n[a], n[b], threshold, longest, shortest)
        if key[1] == key[2]:
            np.fill_diagonal(here, 0)
        depths = np.zeros(len(n), np.int32)
        bits = np.where(here > 0, 1 << here, 0)
        depths[a] |= np.bitwise_or.reduce(bits, 1, initial=0).astype(np.int32)
        depths[b] |= np.bitwise_or.reduce(bits, 0, initial=0).astype(np.int32)
        return table.select(list(fields)).append_column("depths", pa.array(depths)).filter(pa.array(depths > 0))

    needed_rows = settle(met.groupBy("node", "i", "j").applyInArrow(needed, needed_schema))
    wanted = needed_rows.select("digest").distinct().join(classes.select("digest", "rep"), "digest")
    wanted = wanted.select("digest", F.col("rep.doc_id").alias("__id"), F.col("rep.mark").alias("__mark"))
    texts = docs.select("doc_id", _mark().alias("mark"), "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("mark") == F.col("__mark")))
    set_schema = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("set", T.BinaryType())])

    def read_sets(batches):
        import pyarrow as pa

        for batch in batches:
            found = [s.tobytes() for s in _sets(t.as_py() for t in batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(found, pa.binary())], ["digest", "set"])

    sets = texts.select("digest", "text").mapInArrow(read_sets, set_schema).dropDuplicates(["digest"])
    full = settle(sets.join(paths.select("digest", "n", "paths"), "digest"))
    schema = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("root", T.BinaryType()), T.StructField("links", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def verified(least: int, most: int) -> DataFrame:
        """Work on the pairs that share ``least`` to ``most`` hashes."""
        edges = band_edges(threshold)

        def verify(key, table):
            import pyarrow as pa

            left, digests, n, found = _group(table)
            same = key[1] == key[2]
            a, b = _sides(left, same)
            here = met_here(found[a], found[b], table.column("tree")[0].as_py(), n[a], n[b], threshold, longest, shortest)
            new = (here >= least) & (here <= most)
            if same:
                new = np.triu(new, 1)
            sets = [np.frombuffer(s, "<u8") for s in table.column("set").to_pylist()]
            both = common([sets[i] for i in a], [sets[i] for i in b], new)
            either = n[a][:, None] + n[b][None, :] - both
            near = new & (both >= threshold * either * (1 - 1e-12))
            times = np.zeros(len(n), np.int64)
            np.add.at(times, a, near.sum(1))
            np.add.at(times, b, near.sum(0))
            root = _roots(near, a, b, len(n))
            # each pair is counted once, at its left member
            rows, columns = np.nonzero(new)
            band = np.searchsorted(edges, both[rows, columns] / np.maximum(either[rows, columns], 1) + 1e-12, "right") - 1
            counted = band >= 0
            bands = np.zeros((len(n), BANDS), np.int64)
            np.add.at(bands, (a[rows[counted]], band[counted]), 1)
            some = np.flatnonzero((times > 0) | bands.any(1))
            return pa.table([pa.array([digests[i] for i in some], pa.binary()), pa.array([digests[root[i]] for i in some], pa.binary()), pa.array(times[some]), pa.array(bands[some].tolist(), pa.list_(pa.int64()))], schema.names)

        bits = sum(1 << d for d in range(least, most + 1))
        ready = needed_rows.where(F.col("depths").bitwiseAND(F.lit(bits)) != 0).drop("depths").join(full, "digest")
        return settle(ready.groupBy("node", "i", "j").applyInArrow(verify, schema))

    depth, done, counts, steps, found = longest, longest + 1, np.zeros(BANDS, np.int64), [], None
    while depth < done:
        now = verified(depth, done - 1)
        sums = now.select([F.sum(F.col("bands")[k]).alias(f"b{k}") for k in range(BANDS)]).first()
        counts = counts + np.array([v or 0 for v in sums])
        steps.append((depth, counts.tolist()))
        found = now if found is None else found.unionByName(now)
        done, depth = depth, shortened(counts, depth, threshold, trees, recall)
    return found.where("links > 0").drop("bands"), steps


def _grouped(docs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    rows = settle(signed(docs, threshold=threshold))
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("mark").alias("mark"))).alias("rep")
    classes = settle(rows.groupBy("digest").agg(rep, F.count(F.lit(1)).alias("copies"), F.max("n").alias("n"), F.max("paths").alias("paths")))
    found, _ = links(classes, docs, threshold)
    counts = found.groupBy("digest").agg(F.sum("links").alias("n_links"))
    labels = components(found.select(F.col("digest").alias("a"), F.col("root").alias("b")).where("a <> b"))
    known = classes.select("digest", "rep", "copies").join(counts, "digest", "left").join(labels.withColumnRenamed("node", "digest"), "digest", "left")
    known = settle(known.withColumn("label", F.coalesce("label", "digest")))
    heads = known.groupBy("label").agg(F.min("rep").alias("head"), F.sum("copies").alias("group_size"), F.count(F.lit(1)).alias("classes"))
    # a group may hold a third of all classes
    placed = attach_group(known, heads, "label", "classes", "digest")
    return rows, placed.select("digest", "rep", "copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), "head", "group_size")


def near_groups(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, class_id, n_links, copy_id, copies, group_size`` for each row of ``docs``.

    ``copy_id`` is the smallest id of the rows with the same shingle set, ``copies`` their number;
    ``n_links`` is the number of other shingle sets within the threshold; ``class_id`` is the
    smallest id of all rows reached over links, ``group_size`` their number. Words are split at
    ASCII white space and compared as they are. A text under five words is one shingle; null, empty
    and blank texts are one copy class. Null ids come last, so they stand for a class only if it has
    no other. Repeated rows count as copies. Other columns are not read; no rows give no rows.
    """
    rows, placed = _grouped(docs, threshold)
    out = attach_group(rows.select("doc_id", "digest", "mark"), placed, "digest", "copies", "doc_id")
    return out.select("doc_id", F.col("head.doc_id").alias("class_id"), "n_links", F.col("rep.doc_id").alias("copy_id"), "copies", "group_size")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that stand for their class, with all their columns; a repeated row once."""
    _, placed = _grouped(docs, threshold)
    heads = placed.select(F.col("head.doc_id").alias("id"), F.col("head.mark").alias("mark")).distinct()
    rows = whole(docs).withColumn("own", F.xxhash64("row.text"))
    rows = rows.join(heads, F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.col("own") == F.col("mark")), "left_semi")
    if ids_repeat(docs):
        again = Window.partitionBy("row.doc_id", "own").orderBy(F.lit(0))
        rows = rows.withColumn("place", F.row_number().over(again)).where("place = 1")
    return rows.select("row.*")
