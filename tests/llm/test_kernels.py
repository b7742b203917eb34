"""The parts of the operators, on small inputs made for them."""

import random

import numpy as np
import pytest
from force import near_by_force, shipped  # noqa: F401

from pacegrid.llm import exact, grammar, licence, near, nearest, packing
from pacegrid.llm.tables import attach_group


def test_depth_reaches_the_recall():
    depth = near.matched_depth(0.8, 24, 8, 0.9999)
    assert 1 - (1 - 0.8**depth) ** 24 >= 0.9999 > 1 - (1 - 0.8 ** (depth + 1)) ** 24


@pytest.mark.parametrize("at_once", [3, 4096])
def test_common_both_ways(monkeypatch, at_once):
    monkeypatch.setattr(near, "AT_ONCE", at_once)
    draw = np.random.default_rng(1)
    for n, m, width in ((3, 4, 5), (60, 40, 12), (1, 1, 0)):
        a = [np.unique(draw.integers(0, 50, width)).astype(np.uint64) for _ in range(n)]
        b = [np.unique(draw.integers(0, 50, width)).astype(np.uint64) for _ in range(m)]
        for share in (0.05, 1.0):
            wanted = draw.random((n, m)) <= share
            expected = [[len(set(x.tolist()) & set(y.tolist())) if w else 0 for y, w in zip(b, row)] for x, row in zip(a, wanted)]
            assert near.common(a, b, wanted).tolist() == expected


def test_large_near_group_is_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 8)
    draw = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(70):
        words = list(base)
        for _ in range(draw.randrange(0, 3)):
            words[draw.randrange(60)] = f"x{draw.randrange(1000)}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, " ".join(f"y{draw.randrange(10**6)}" for _ in range(30))) for i in range(20)]
    got = near.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"], r["copy_id"], r["copies"]) for r in got} == near_by_force(rows)


def test_components_of_a_chain(spark):
    ties = [(bytes([i + 1]), bytes([i])) for i in range(40)] + [(b"\xf0", b"\xf1")]
    labels = near.components(spark.createDataFrame(ties, "a binary, b binary")).collect()
    assert {bytes(r["node"]): bytes(r["label"]) for r in labels} == {bytes([i]): b"\0" for i in range(41)} | {b"\xf0": b"\xf0", b"\xf1": b"\xf0"}


def test_hot_groups_are_salted_whole(spark):
    rows = spark.range(3000).selectExpr("id", "if(id % 3 = 0, 'hot', cast(id as string)) AS g")
    groups = rows.groupBy("g").count()
    out = attach_group(rows, groups, "g", "count", "id")
    assert out.count() == 3000 and out.where("g = 'hot' AND count = 1000").count() == 1000


def test_tree_merge_equals_one_grouping(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"t{i % 40}", "s") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = exact.group_exact(df).collect()
    best = {}
    for i, t, _ in rows:
        best.setdefault(t, []).append(i)
    assert {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in got} == {i: (min(best[t]), len(best[t])) for i, t, _ in rows}


def test_local_search_empties_bins():
    lengths = np.array([6, 6, 5, 5, 4, 4, 3, 3, 2, 2])  # 40 in bins of 10
    poor = [[0], [1], [2], [3], [4, 5], [6, 7], [8, 9]]
    good = packing.local_search(poor, lengths, 10)
    assert len(good) <= 5 and sorted(i for b in good for i in b) == list(range(10))
    assert all(lengths[b].sum() <= 10 for b in good)
    # one for one: the 5 gives way to the 4 + 1, and the bin of the 4 runs dry
    lengths = np.array([5, 4, 4, 1, 6])
    assert len(packing.local_search([[0, 1], [2, 4], [3]], lengths, 10)) == 2


def test_packing_is_tight():
    draw = np.random.default_rng(5)
    lengths = np.minimum(4096, draw.lognormal(6.5, 1.2, 5000).astype(int) + 1)
    bins = packing.local_search(packing.best_fit(lengths, 4096), lengths, 4096)
    assert all(lengths[b].sum() <= 4096 for b in bins) and len(bins) <= -(-lengths.sum() // 4096) + 1


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 20_000])
def test_grammar_round_trip(n):
    draw = np.random.default_rng(n)
    ids = np.concatenate([draw.integers(0, 30, n), np.zeros(n // 2, int), np.tile([1, 2, 3], n // 3)]).astype(np.uint32)
    symbols, rules, first = grammar.compress(ids)
    assert (grammar.expand(symbols, rules, first) == ids).all()
    sizes = grammar.expanded(rules, first)
    assert len(symbols) + 2 * len(rules) <= max(len(ids), 1)
    for start, end in ((0, len(ids)), (len(ids) // 3, len(ids) // 2), (len(ids), len(ids))):
        assert (grammar.between(symbols, rules, sizes, first, start, end) == ids[start:end]).all()


def test_error_bounds_hold():
    draw = np.random.default_rng(2)
    x = draw.normal(size=(300, 16)) * draw.lognormal(size=(300, 1))
    q, scale, error = nearest.rounded(x)
    assert (np.linalg.norm(x - q * scale[:, None], axis=1) <= error).all()
    got = nearest.tile(np.arange(5), x[:5], np.arange(300), x, 7)
    for i in range(5):
        far = np.linalg.norm(x - x[i], axis=1)
        far[i] = np.inf
        assert [v for _, v in got[i]] == np.argsort(far, kind="stable")[:7].tolist()


def test_anchors_are_needed_by_every_template():
    words = licence.anchors()
    for notices in licence.TEMPLATES.values():
        for notice in notices:
            pairs = licence._pairs(notice)
            left = [p for p in pairs if not any(w in p for w in words)]
            assert len(left) < licence.CONFIRM * len(pairs)


def test_tile_with_squares_beyond_double():
    """Vectors whose squares overflow, or vanish, still have their nearest, as a plain loop finds them."""
    from pacegrid.llm.nearest import tile

    rng = np.random.default_rng(5)
    for scale in (1e200, 1e154, 1e-170):
        x = rng.normal(size=(60, 8))
        x[:40] *= scale
        ids = np.arange(60)
        with np.errstate(over="ignore"):
            plain = np.sqrt(sum((x[None, :, d] - x[:5, None, d]) ** 2 for d in range(8)))
        for i, found in enumerate(tile(ids[:5], x[:5], ids, x, 10)):
            assert found == sorted((s, v) for s, v in zip(plain[i].tolist(), ids.tolist()) if v != i)[:10]
