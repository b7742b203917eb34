"""The trie of conversation prefixes, with a skeleton of splitters (method of the dealt operator 13).

A conversation is the bytes of its turns' digests, so byte order is the order of the trie and a
prefix is a prefix. Equal conversations are one path. Paths are cut into ranges at splitters taken
from a bounded sample; the trie of the splitters, the skeleton, is known to every task. A node that
is no prefix of a splitter has all its paths in one range, where one pass over the sorted paths
finishes it, holding only the open nodes of the current path. Of a skeleton node each range gives a
partial aggregate; these are reduced, and added up along the skeleton, whose size is bounded.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pacegrid.llm.tables import WHITE, parts
from pacegrid.session import settle

#: Conversations that share an opening; the longest opening is one turn less than ``OPENINGS``.
FAMILY, OPENINGS = 20, 4
#: Bytes of a turn in a path: digest of role and text, and the text's words, big-endian.
DIGEST, STEP = 16, 20
#: At most so many ranges; sampled paths for each range and in all; turns of a splitter.
RANGES, SAMPLED, SAMPLE, DEEPEST = 8192, 16, 1 << 15, 32
#: Ids that are joined to one text at a time; rows handed back to Spark at a time.
PIECE, BATCH = 1 << 14, 1 << 12


def paths(conversations: DataFrame) -> DataFrame:
    """``conv_id, path`` of every rebuilt conversation.

    Turns are in the order of ``turn``, null first, equal ones by the digest of role and text. The
    first ``crc32(conv_id) % 4`` turns are those of the conversation ``conv_id - conv_id % 20``.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    words = F.regexp_count(text, F.lit(f"[^{WHITE}]+"))
    digest = F.sha2(F.encode(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), "UTF-8"), 256)
    step = F.concat(F.substring(digest, 1, 2 * DIGEST), F.lpad(F.hex(words), 2 * (STEP - DIGEST), "0"))
    turns = conversations.where("conv_id IS NOT NULL").select("conv_id", "turn", step.alias("step"))
    own = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "step"))).getField("step").alias("own"))
    own = settle(own)
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    opening = F.slice("own", 1, OPENINGS - 1).alias("opening")
    first = own.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("base"), opening)
    taken = (F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % OPENINGS).cast("int")
    rebuilt = own.withColumn("base", base).join(first, "base", "left").withColumn("h", taken)
    opened = F.slice(F.coalesce("opening", F.array().cast("array<string>")), F.lit(1), F.col("h"))
    steps = F.concat(opened, F.slice("own", F.col("h") + 1, F.size("own")))
    return settle(rebuilt.select("conv_id", F.unhex(F.array_join(steps, "")).alias("path")))


def path_ends(convs: DataFrame) -> DataFrame:
    """``first, n, ends``: of each distinct path its smallest id, its number of ids, and their SHA-256.

    The ids of a path may be very many. Sorted ranges of them are joined to short texts side by side;
    then one task reads a path's texts in order, holding one at a time.
    """
    n = parts(convs)
    key = F.unhex(F.sha2("path", 256)).alias("key")
    ids = convs.select(key, "conv_id").repartitionByRange(n, "key", "conv_id").sortWithinPartitions("key", "conv_id")

    def join(batches):
        import pyarrow as pa

        for batch in batches:
            keys, found = batch.column("key").to_pylist(), batch.column("conv_id").to_pylist()
            rows, at = [], 0
            while at < len(keys):
                end = at + 1
                while end < len(keys) and keys[end] == keys[at] and end - at < PIECE:
                    end += 1
                rows.append((keys[at], found[at], end - at, ",".join(map(str, found[at:end]))))
                at = end
            yield pa.RecordBatch.from_pylist([dict(zip(("key", "at", "n", "ids"), r)) for r in rows], pieces_schema)

    import pyarrow as pa

    pieces_schema = pa.schema([("key", pa.binary()), ("at", pa.int64()), ("n", pa.int64()), ("ids", pa.string())])
    pieces = ids.mapInArrow(join, "key binary, at long, n long, ids string")
    pieces = settle(pieces).repartition(n, "key").sortWithinPartitions("key", "at")

    def digest(batches):
        from hashlib import sha256

        import pyarrow as pa

        key, first, n, state, out = None, None, 0, None, []
        for batch in batches:
            for own, at, more, ids in zip(*(batch.column(c).to_pylist() for c in ("key", "at", "n", "ids"))):
                if own != key:
                    if state:
                        out.append((first, n, state.hexdigest()))
                    key, first, n, state = own, at, 0, sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
                n += more
            yield _batch(out, ends_schema)
            out = []
        if state:
            yield _batch([(first, n, state.hexdigest())], ends_schema)

    ends_schema = pa.schema([("first", pa.int64()), ("n", pa.int64()), ("ends", pa.string())])
    return pieces.mapInArrow(digest, "first long, n long, ends string")


def _batch(rows: list[tuple], schema):
    import pyarrow as pa

    columns = zip(*rows) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


class Skeleton:
    """The trie of the splitters. Node 0 is the root; each has a parent and the steps that lead to it."""

    def __init__(self, splitters: list[bytes]):
        self.child: dict[tuple[int, bytes], int] = {}
        self.parent, self.words, self.depth = [-1], [0], [0]
        for splitter in splitters:
            node = 0
            for at in range(0, len(splitter), STEP):
                step = splitter[at : at + STEP]
                if (node, step) not in self.child:
                    self.child[node, step] = len(self.parent)
                    self.parent.append(node)
                    self.words.append(int.from_bytes(step[DIGEST:], "big"))
                    self.depth.append(self.depth[node] + 1)
                node = self.child[node, step]

    def rows(self) -> list[tuple]:
        """(node, parent, words, its children in the skeleton, its ancestors and itself) of every node."""
        children = [0] * len(self.parent)
        above: list[list[int]] = []
        for node, parent in enumerate(self.parent):
            above.append([*(above[parent] if parent >= 0 else []), node])
            if parent >= 0:
                children[parent] += 1
        return list(zip(range(len(above)), self.parent, self.words, children, above))


def splitters_of(classes: DataFrame, ranges: int) -> list[bytes]:
    """Sorted paths, cut to ``DEEPEST`` turns, that cut a sample into equal ranges."""
    some = classes.select(F.col("path").substr(1, STEP * DEEPEST).alias("path"), F.xxhash64("path").alias("h"))
    found = sorted(r["path"] for r in some.orderBy("h").limit(min(SAMPLE, SAMPLED * ranges)).collect())
    found = [bytes(p) for p in found]
    return sorted({found[i * len(found) // ranges] for i in range(1, ranges)} - {b""}) if found else []


def finished(rows: Iterator[tuple[bytes, int, int, str]], skeleton: Skeleton) -> Iterator[tuple]:
    """Nodes of the trie of sorted distinct paths, children before parents.

    ``rows`` are (path, smallest id, ids, hash of the ids); a node is (skeleton node or -1, depth,
    smallest member, members, children, leaves, saved tokens, hash of the ids that end here). What a
    skeleton node has of leaves and tokens is that of the nodes below it that are not of the skeleton.
    """
    SKELETON, WORDS, LEAST, MEMBERS, CHILDREN, LEAVES, SAVED, ENDS = range(8)
    open_nodes: list[list] = []
    previous = b""

    def shut():
        node = open_nodes.pop()
        parent = open_nodes[-1] if open_nodes else None
        if node[SKELETON] < 0:
            node[LEAVES] += node[CHILDREN] == 0
            node[SAVED] += (node[MEMBERS] - 1) * node[WORDS]
            parent[CHILDREN] += 1
            parent[LEAVES] += node[LEAVES]
            parent[SAVED] += node[SAVED]
        if parent:
            parent[MEMBERS] += node[MEMBERS]
            parent[LEAST] = node[LEAST] if parent[LEAST] is None else min(parent[LEAST], node[LEAST])
        return (node[SKELETON], len(open_nodes), *node[LEAST:])

    for path, first, n, ends in rows:
        length, same = len(path) // STEP, 0
        if not open_nodes:
            open_nodes.append([0, 0, None, 0, 0, 0, 0, None])
        shared = min(length, len(open_nodes) - 1)
        while same < shared and path[same * STEP : (same + 1) * STEP] == previous[same * STEP : (same + 1) * STEP]:
            same += 1
        while len(open_nodes) > same + 1:
            yield shut()
        for d in range(same, length):
            step = path[d * STEP : (d + 1) * STEP]
            above = open_nodes[-1][SKELETON]
            known = skeleton.child.get((above, step), -1) if above >= 0 else -1
            open_nodes.append([known, int.from_bytes(step[DIGEST:], "big"), None, 0, 0, 0, 0, None])
        node = open_nodes[-1]
        node[MEMBERS] += n
        node[LEAST] = first if node[LEAST] is None else min(node[LEAST], first)
        node[ENDS] = ends
        previous = path
    while open_nodes:
        yield shut()


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations.

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null at the root), ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``. Null roles and texts are empty.
    Repeated rows are turns of their own. Rows without a conversation id belong to no conversation.
    Other columns are not read; an empty table gives no rows, not even a root.

    A conversation is one row of 20 bytes a turn while it is sorted, and at most ``RANGES`` splitters
    of ``DEEPEST`` turns are sent to every task, whatever the table. Ranges that more turns than that
    would be needed to cut stay whole: their task takes longer, and no more memory.
    """
    spark = conversations.sparkSession
    convs = paths(conversations)
    classes = settle(convs.join(path_ends(convs), F.col("conv_id") == F.col("first")).select("path", "first", "n", "ends"))
    ranges = min(parts(classes), RANGES)
    splitters = splitters_of(classes, ranges)
    skeleton = Skeleton(splitters)

    def place(batches):
        import pyarrow as pa

        for batch in batches:
            found = [bisect_right(splitters, p) for p in batch.column("path").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), *batch.columns], ["shard", *batch.schema.names])

    placed = classes.mapInArrow(place, "shard int, path binary, first long, n long, ends string")
    placed = placed.repartitionById(ranges, "shard").sortWithinPartitions("path")
    kinds = "skeleton int, depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string"

    def finish(batches):
        import pyarrow as pa

        schema = pa.schema([("place", pa.int64()), *_arrow(kinds)])
        rows = chain.from_iterable(zip(*(b.column(c).to_pylist() for c in ("path", "first", "n", "ends"))) for b in batches)
        out = []
        for at, node in enumerate(finished(rows, skeleton)):
            out.append((at, *node))
            if len(out) == BATCH:
                yield _batch(out, schema)
                out = []
        yield _batch(out, schema)

    # read backwards, a node comes after its parent
    nodes = placed.mapInArrow(finish, f"place long, {kinds}").sortWithinPartitions(F.desc("place")).drop("place")

    def adopt(batches):
        import pyarrow as pa

        schema = pa.schema([*_arrow(kinds), ("parent_conv_id", pa.int64()), ("parent", pa.int32())])
        last: list[tuple[int, int]] = []
        for batch in batches:
            ids, known = [], []
            for number, depth, conv in zip(*(batch.column(c).to_pylist() for c in ("skeleton", "depth", "conv_id"))):
                del last[depth:]
                above = last[-1] if last else (0, None)
                ids.append(above[1] if above[0] < 0 else None)
                known.append(above[0] if above[0] >= 0 else None)
                last.append((number, conv))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.int64()), pa.array(known, pa.int32())], schema=schema)

    nodes = settle(nodes.mapInArrow(adopt, f"{kinds}, parent_conv_id long, parent int"))
    info = spark.createDataFrame(skeleton.rows(), "skeleton int, parent int, words long, more int, above array<int>")
    total = nodes.where("skeleton >= 0").groupBy("skeleton").agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("ends").alias("ends"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
    )
    # from here on tables of the skeleton's size
    total = total.join(F.broadcast(info), "skeleton").withColumn("n_children", F.col("n_children") + F.col("more"))
    total = total.withColumn("n_leaves", F.col("n_leaves") + (F.col("n_children") == 0).cast("long"))
    total = settle(total.withColumn("saved_tokens", F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("words")))
    summed = total.select(F.explode("above").alias("skeleton"), "n_leaves", "saved_tokens")
    summed = summed.groupBy("skeleton").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    names = F.broadcast(total.select(F.col("skeleton").alias("parent"), F.col("conv_id").alias("named")))
    top = total.drop("n_leaves", "saved_tokens").join(F.broadcast(summed), "skeleton").join(names, "parent", "left")
    below = nodes.where("skeleton < 0").join(names, "parent", "left").withColumn("named", F.coalesce("parent_conv_id", "named"))
    empty = F.sha2(F.lit(b""), 256)
    columns = ["conv_id", "depth", F.col("named").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens"]
    columns.append(F.coalesce("ends", empty).alias("ends_sha256"))
    return top.select(*columns).unionByName(below.select(*columns))


def _arrow(kinds: str) -> list:
    import pyarrow as pa

    of = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
    return [(name, of[kind]) for name, kind in (k.split() for k in kinds.split(", "))]


SQL = r"""
WITH t AS (
  SELECT conv_id, turn, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS step,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT conv_id, list({'step': step, 'words': words} ORDER BY turn NULLS FIRST, step) AS turns,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, strlen(conv_id::VARCHAR) + 1),
           lambda i: ascii(substr(conv_id::VARCHAR, i::INT, 1))::BIGINT)),
           lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)),
             lambda x, bit: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 4 AS h
  FROM t GROUP BY conv_id),
c AS (
  SELECT a.conv_id, list_concat(coalesce(b.turns, [])[1:a.h], a.turns[a.h + 1:]) AS turns
  FROM own a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 20),
p AS (
  SELECT conv_id, d, len(turns) AS size, turns[d].words AS words,
         md5(array_to_string(list_transform(turns[1:d], lambda x: x.step), '')) AS key,
         md5(array_to_string(list_transform(turns[1:d - 1], lambda x: x.step), '')) AS above
  FROM c, unnest(range(0, len(turns) + 1)) AS u(d)),
n AS (
  SELECT d, key, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(any_value(words), 0) AS words,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (size = d), '')) AS ends_sha256
  FROM p GROUP BY d, key),
k AS (SELECT d - 1 AS d, above AS key, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k ON k.d = n.d AND k.key = n.key),
s AS (
  SELECT p.d, p.key, sum((m.n_children = 0)::INT)::BIGINT AS n_leaves, sum((m.n_convs - 1) * m.words)::BIGINT AS saved_tokens
  FROM m JOIN p ON p.conv_id = m.conv_id AND p.d <= m.d GROUP BY ALL)
SELECT m.conv_id, m.d::BIGINT AS depth, u.conv_id AS parent_conv_id, m.n_convs, m.n_children, s.n_leaves, s.saved_tokens, m.ends_sha256
FROM m JOIN s ON s.d = m.d AND s.key = m.key LEFT JOIN m u ON m.d > 0 AND u.d = m.d - 1 AND u.key = m.above
"""
