"""Fingerprint components, filter orders and the prefix trie against brute force."""

import hashlib
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from compare import connect, differences
from conftest import FOLDER
from force import shipped  # noqa: F401
from pyspark.sql import functions as F

import duckdb
from pacegrid.llm import audit, simhash, trie
from pacegrid.llm.graph import connected
from pacegrid.llm.queries import QUERIES
from pacegrid.llm.tables import table

RUN = "[^\x20\x09-\x0d]+"
A_TO_Z = {c: c + 32 for c in range(65, 91)}


def slow_fingerprint(text):
    from xxhash import xxh64_intdigest

    words = re.findall(RUN, (text or "").translate(A_TO_Z))
    runs = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxh64_intdigest(r.encode(), seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows):
    """(id, fingerprint) to the smallest id reachable."""
    parent = {f: f for _, f in rows}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    fps = list(parent)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 4:
                parent[root(a)] = root(b)
    least = {}
    for i, f in rows:
        if i is not None:
            least[root(f)] = min(i, least.get(root(f), i))
    return Counter((i, f"{f:016x}", least.get(root(f))) for i, f in rows)


def test_components_of_the_table(spark):
    rows = table(spark, FOLDER, "documents").select("doc_id", "text").collect()
    got = QUERIES["op11_simhash"](spark, FOLDER).collect()
    assert Counter(map(tuple, got)) == slow_components([(r["doc_id"], slow_fingerprint(r["text"])) for r in rows])


@pytest.mark.parametrize("segments", [2, 3, 4])
@pytest.mark.parametrize("block", [8, 1024])
def test_links_of_planted_fingerprints(spark, monkeypatch, segments, block):
    """Chains at every distance, a dense group, and pairs that differ in each segment by its most."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    draw = np.random.default_rng(segments)
    fps = draw.integers(0, 1 << 64, 60, dtype=np.uint64).tolist()
    for f in fps[:40]:
        bits = draw.permutation(64)[: int(draw.integers(1, 7))]
        fps.append(f ^ sum(1 << int(b) for b in bits))
    fps += [fps[0] ^ (1 << b) ^ (1 << c) for b in range(0, 64, 3) for c in range(1, 64, 9) if b != c]
    fps += [0, 1, 3, 0b1111, 0b11111 << 30]
    signed = [(int(np.uint64(f).astype(np.int64)),) for f in dict.fromkeys(fps)]
    ties = simhash.ties(spark.createDataFrame(signed, "fp long"), segments=segments)
    labels = {r["node"]: r["label"] for r in connected(ties).collect()}
    groups = [labels.get(f, f) & (2**64 - 1) for (f,) in signed]
    expected = slow_components([(i, f & (2**64 - 1)) for i, (f,) in enumerate(signed)])
    least = {}
    for i, g in enumerate(groups):
        least.setdefault(g, i)
    assert Counter((i, f"{f & (2**64 - 1):016x}", least[g]) for i, ((f,), g) in enumerate(zip(signed, groups))) == expected


@pytest.mark.parametrize(("segments", "distance"), [(1, 4), (2, 4), (3, 4), (4, 4), (6, 4), (3, 7)])
def test_radii_leave_no_pair_out(segments, distance):
    plan = simhash.segment_plan(segments, distance)
    assert sum(w for _, w, _ in plan) == 64 and sum(r + 1 for *_, r in plan) > distance


def test_components_with_hubs(spark):
    """A hub with most of the edges, and a chain, on four partitions."""
    ties = [(0, i) for i in range(1, 3000)] + [(i, i + 1) for i in range(5000, 5040)] + [(7000, 7000)]
    got = connected(spark.createDataFrame(ties, "a long, b long")).collect()
    assert {r["node"]: r["label"] for r in got} == {i: 0 for i in range(3000)} | {i: 5000 for i in range(5000, 5041)}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


TEXTS = [None, "", " \t\n", "one two", "ONE  two ", "a b c d e f g h", "a b c d e f g h", "a b　c\x1cd", "é́ 日本語 😀\r\nx", "word " * 30_000, "ABCDE $", "x " * 250, " ".join(map(str, range(300)))]
DOCS = [(i, t, None if i % 3 else "en", f"s{i % 3}", 7) for i, t in enumerate(TEXTS)]
DOCS += [(3, "one two", "en", "s0", 7), (3, "one two", "fr", "s0", 7), (None, "one two", "en", "s1", 7), (None, "x " * 250, None, None, None), (6, "another text of the same id", None, None, 27)]
LABELS = [(i, i % 2, int(i % 3 == 0)) for i in range(14)] + [(None, 1, 1), (7, None, None), (5, None, 1), (99, 1, 1)]
CLASH = "fp bucket asks held members own rows columns label node copies least part mask digest t n good words step path first ends base opening h shard key at ids skeleton".split()


def with_clashes(df):
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASH if c not in df.columns}).repartition(3)


def test_components_of_odd_rows(spark):
    docs = with_clashes(spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string, n_chars long"))
    expected = slow_components([(i, slow_fingerprint(t)) for i, t, *_ in DOCS])
    assert Counter(map(tuple, simhash.near_components(docs).collect())) == expected
    none = simhash.near_components(docs.limit(0))
    assert none.count() == 0 and none.columns == ["doc_id", "fingerprint", "component_id"]


def slow_audit(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, t, *_ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    seen = []
    for i, t, lang, *_ in docs:
        t, words = t or "", re.findall(RUN, t or "")
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and least[t] < i,
        }
        seen.append((lang or "", {f for f, bad in fails.items() if bad}, i in good, i in toxic))
    rows, removals = [], Counter()
    for part in {p for p, *_ in seen}:
        for order in permutations("ABCDE"):
            left = [s for s in seen if s[0] == part]
            every = left
            for step, f in enumerate(order, 1):
                gone = [s for s in left if f in s[1]]
                left = [s for s in left if f not in s[1]]
                removals[part, f] += len(gone)
                fails = sum(f in s[1] for s in every)
                rows.append((part, f, "".join(order), step, len(left), len(gone), fails - len(gone), sum(s[1] == {f} for s in every), sum(s[2] for s in gone), sum(s[3] for s in gone)))
    return Counter((p, *rest, removals[p, f]) for p, f, *rest in rows)


def test_audit_of_odd_rows(spark):
    docs = with_clashes(spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string, n_chars long"))
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = audit.filter_audit(docs, labels)
    assert Counter(map(tuple, got.collect())) == slow_audit(DOCS, LABELS)
    assert audit.filter_audit(docs.limit(0), labels).count() == 0
    unlabelled = audit.filter_audit(docs, labels.limit(0))
    assert Counter(map(tuple, unlabelled.collect())) == slow_audit(DOCS, [])
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", DOCS)
    con.execute("CREATE TABLE labels (doc_id BIGINT, quality INTEGER, toxic INTEGER)")
    con.executemany("INSERT INTO labels VALUES (?, ?, ?)", LABELS)
    assert differences("audit", got, con, audit.SQL) == []


def test_swapped_diagram_is_the_diagram_built_in_that_order():
    draw = np.random.default_rng(3)
    counts = {int(m): tuple(map(int, draw.integers(0, 9, 3))) for m in draw.permutation(32)[:20]}
    diagram = audit.Diagram(counts)
    size = {}
    for level in audit.adjacent_swaps(5):
        diagram.swap(level)
        moved = {sum(1 << at for at, f in enumerate(diagram.order) if m >> f & 1): s for m, s in counts.items()}
        fresh = audit.Diagram(moved)
        assert [(k, r) for _, k, r in diagram.steps()] == [(k, r) for _, k, r in fresh.steps()]
        size[tuple(diagram.order)] = sum(map(len, diagram.levels))
        assert size[tuple(diagram.order)] == sum(map(len, fresh.levels))
    assert len(size) == 119


def slow_trie(rows):
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            step = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            turns.setdefault(c, []).append((turn is not None, turn or 0, step, role, text))
    own = {c: [(role, text) for *_, role, text in sorted(t)] for c, t in turns.items()}
    rebuilt = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = tuple(own.get(c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20)), [])[:h] + mine[h:])
    members = {}
    for c, path in rebuilt.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    kids = {}
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)

    def below(node):
        leaves = saved = 0
        for other in members:
            if other[: len(node)] == node:
                leaves += other not in kids
                saved += (len(members[other]) - 1) * len(re.findall(RUN, other[-1][1])) if other else 0
        return leaves, saved

    out = Counter()
    for node, ids in members.items():
        ends = ",".join(map(str, sorted(c for c in ids if rebuilt[c] == node)))
        above = min(members[node[:-1]]) if node else None
        out[min(ids), len(node), above, len(ids), len(kids.get(node, [])), *below(node), hashlib.sha256(ends.encode()).hexdigest()] += 1
    return out


def odd_turns():
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"text {t % 3} of {c % 3}") for c in range(45) for t in range(c % 5)]
    rows += [(None, 0, "user", "nobody's"), (60, None, None, None), (60, 0, "", ""), (60, 0, "user", "tie b"), (60, 0, "user", "tie a"), (61, 3, "user", None), (61, 3, "user", None)]
    rows += [(c, t, "user", "deep") for c in range(100, 103) for t in range(40 + c % 3)]
    rows += [(c, 0, "user", "a turn of many") for c in range(200, 240)] + [(-7, 0, "user", "below zero"), (-20, 0, "user", "x y z"), (-20, 1, "user", "w")]
    return rows + [(300, 0, "us", "er:one"), (301, 0, "user", ":one"), (302, 0, "user", "long " * 5000), (320, 1, "user", "ü 日本\x1c語 é"), (7, 99, "user", "last")]


@pytest.mark.parametrize("parts", ["2", "4", "40"])
def test_trie_of_odd_rows(spark, parts):
    rows = odd_turns()
    turns = with_clashes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = trie.prefix_trie(turns)
        assert Counter(map(tuple, got.collect())) == slow_trie(rows)
        assert trie.prefix_trie(turns.limit(0)).count() == 0
        assert trie.prefix_trie(turns.where("conv_id = 61")).count() == len(slow_trie([r for r in rows if r[0] == 61]))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert differences("trie", got, con, trie.SQL) == []


def test_trie_with_many_ids_of_one_path(spark, monkeypatch):
    """The ids that end at a node are put together from pieces, and shallow splitters change nothing."""
    monkeypatch.setattr(trie, "PIECE", 3)
    monkeypatch.setattr(trie, "DEEPEST", 1)
    rows = odd_turns()
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert Counter(map(tuple, trie.prefix_trie(turns).collect())) == slow_trie(rows)


def test_trie_sql_on_the_larger_table(spark):
    folder = FOLDER.replace("sf0.001", "sf0.01")
    assert differences("trie", QUERIES["op13_prefix_trie"](spark, folder), connect(folder), trie.SQL) == []
