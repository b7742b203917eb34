"""The MinHash forest: how far prefixes are shortened, what that finds, who works on a pair."""

import random

import numpy as np
from force import near_by_force, shipped  # noqa: F401
from pyspark.sql import functions as F

from pacegrid.llm import near


def _altered(draw, words, changes):
    out = list(words)
    for at in draw.sample(range(len(out)), changes):
        out[at] = f"x{draw.randrange(10**9)}"
    return " ".join(out)


def _family(draw, start, size, length, changes):
    words = [f"w{draw.randrange(10**9)}" for _ in range(length)]
    return [(start + i, _altered(draw, words, changes)) for i in range(size)]


def _steps(spark, rows, **settings):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    signed = near.signed(docs)
    rep = F.min(F.struct(F.col("doc_id").alias("doc_id"), F.col("mark").alias("mark"))).alias("rep")
    classes = signed.groupBy("digest").agg(rep, F.max("n").alias("n"), F.max("paths").alias("paths"))
    found, steps = near.links(classes, docs, **settings)
    return sum(r["links"] for r in found.collect()), steps


def _links(rows):
    return sum(links for _, links, first, _ in near_by_force(rows).values())


def test_nearly_equal_copies_end_at_a_long_prefix(spark):
    draw = random.Random(1)
    rows = [r for k in range(30) for r in _family(draw, 100 * k, 4, 800, 1)]
    links, steps = _steps(spark, rows)
    assert [d for d, _ in steps] == [near.LONGEST]
    assert links == _links(rows) == 30 * 12


def test_pairs_at_the_threshold_go_down_to_the_shortest_prefix(spark):
    draw = random.Random(2)
    rows = []
    for k in range(150):
        words = [f"w{draw.randrange(10**9)}" for _ in range(300)]
        rows += [(10 * k, " ".join(words)), (10 * k + 1, _altered(draw, words, 6))]
    links, steps = _steps(spark, rows)
    assert [d for d, _ in steps][0] == near.LONGEST and steps[-1][0] == near.matched_depth() == 5
    every = _links(rows)
    assert every > 100 and links == every
    # each step counts what was found up to there, and later steps only add
    sums = [sum(c) for _, c in steps]
    assert sums == sorted(sums)


def test_a_lower_target_ends_earlier(spark):
    draw = random.Random(3)
    rows = [r for k in range(60) for r in _family(draw, 10 * k, 2, 300, 3)]
    deep = _steps(spark, rows)[1]
    assert _steps(spark, rows, recall=0.5)[1][-1][0] > deep[-1][0]


def test_what_was_found_sets_the_prefix():
    none = [0] * near.BANDS
    assert near.shortened(none, 8) == near.matched_depth()
    only = lambda s: [int(i == np.searchsorted(near.band_edges(), s, "right") - 1) for i in range(near.BANDS)]
    assert near.shortened(only(0.999), 8) == 8
    assert near.shortened(only(0.76), 8) == near.shortened(only(0.81), 8) == near.matched_depth()
    depths = [near.shortened(only(s), 8) for s in (0.82, 0.86, 0.9, 0.95, 0.999)]
    assert depths == sorted(depths)


def test_a_pair_belongs_to_one_tree_by_its_longest_prefix():
    draw = np.random.default_rng(5)
    longest, shortest, trees = 8, 5, 6
    digits = near.DIGIT * (longest - shortest)

    def made(n):
        heads = draw.integers(0, 2, (n, trees)) << digits
        return heads | draw.integers(0, 2, (n, trees)) << (digits - near.DIGIT) | draw.integers(0, 2, (n, trees))

    for n, m in ((3, 4), (300, 200)):
        a, b = made(n), made(m)
        one, other = np.full(n, 10), np.full(m, 10)
        got = np.stack([near.met_here(a, b, t, one, other, 0.8, longest, shortest) for t in range(trees)])

        def shares(x, y):
            if x >> digits != y >> digits:
                return 0
            return next((d for d in range(longest, shortest, -1) if x >> near.DIGIT * (longest - d) == y >> near.DIGIT * (longest - d)), shortest)

        for i in range(0, n, max(1, n // 20)):
            for j in range(0, m, max(1, m // 20)):
                each = [shares(int(x), int(y)) for x, y in zip(a[i], b[j])]
                expected = [max(each) if t == each.index(max(each)) else 0 for t in range(trees)]
                assert got[:, i, j].tolist() == expected
    assert not near.met_here(a, b, 0, one, other * 2, 0.8, longest, shortest).any()


def test_large_nodes_of_different_sizes_lose_no_link(spark, monkeypatch):
    """Blocks by set size, by classes and by shingles: links across bands stay."""
    draw = random.Random(7)
    words = [f"w{i}" for i in range(130)]
    rows = [(i, " ".join(words[: draw.randrange(70, 130)])) for i in range(80)]
    rows += [(100 + i, _altered(draw, words, draw.randrange(0, 3))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = near_by_force(rows)
    for block, shingles in ((8, 2_000_000), (512, 1000)):
        monkeypatch.setattr(near, "BLOCK", block)
        monkeypatch.setattr(near, "SHINGLES", shingles)
        got = near.near_groups(docs).collect()
        assert {r["doc_id"]: (r["class_id"], r["n_links"], r["copy_id"], r["copies"]) for r in got} == expected
