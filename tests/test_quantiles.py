"""Exact quartiles by rounds of counts, on columns that make the rounds hard."""

import math
import struct

import numpy as np
import pytest

from pacegrid.operators import quantiles
from pacegrid.operators.stats import column_summary

SHARES = (0.25, 0.5, 0.75)


def expected(values):
    known = sorted(v for v in values if v is not None and not math.isnan(v))
    if not known:
        return [None] * len(SHARES)
    out = []
    for s in SHARES:
        at = (len(known) - 1) * s
        low, high = known[math.floor(at)], known[math.ceil(at)]
        out.append(low if low == high else low + (at - math.floor(at)) * (high - low))
    return out


def columns():
    draw = np.random.default_rng(5)
    n = 4001
    bits = [struct.unpack("d", struct.pack("Q", int(b)))[0] for b in draw.integers(0, 1 << 64, n, dtype=np.uint64)]
    near = np.float64(1.0)
    neighbours = []
    for _ in range(n):
        neighbours.append(float(near))
        near = np.nextafter(near, 2.0)
    return {
        "normal": draw.normal(0, 1, n).tolist(),
        "heavy": (10.0 ** draw.uniform(-300, 300, n)).tolist(),
        "any bits": [b if not math.isnan(b) else None for b in bits],
        "neighbours": neighbours,
        "few values": draw.integers(0, 3, n).astype(float).tolist(),
        "one value": [7.25] * n,
        "mostly infinite": [math.inf if i % 3 else -math.inf if i % 2 else float(i) for i in range(n)],
        "gaps": [None if i % 2 else math.nan if i % 3 == 0 else float(i % 97) for i in range(n)],
        "nothing": [None] * n,
        "extremes": [-1.7e308 if i % 2 else 1.7e308 for i in range(n)],
    }


@pytest.mark.parametrize(("buckets", "rounds"), [(16, 3), (4096, 1), (4096, 4)])
def test_quartiles_are_exact(spark, monkeypatch, buckets, rounds):
    monkeypatch.setattr(quantiles, "BUCKETS", buckets)
    monkeypatch.setattr(quantiles, "ROUNDS", rounds)
    data = columns()
    df = spark.createDataFrame(list(zip(*data.values())), ", ".join(f"`{c}` double" for c in data)).repartition(3)
    found = quantiles.summaries(df, list(data), SHARES)
    for (c, v), (facts, got) in zip(data.items(), found):
        assert got == expected(v), c
        assert facts.known + facts.missing == len(v)


def test_a_wrong_sketch_costs_a_pass_and_no_result(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "ROUNDS", 2)
    monkeypatch.setattr(quantiles, "BUCKETS", 16)
    df = spark.range(5000).selectExpr("CAST(id * 7919 % 5000 AS DOUBLE) AS v")
    asked = []

    def wrong(values, waiting):
        asked.append(len(waiting))
        return {quantiles.Interval(p.column, p.low, p.low, p.before, p.size, p): r for p, r in waiting.items()}

    monkeypatch.setattr(quantiles, "_sketched", wrong)
    assert quantiles.summaries(df, ["v"], SHARES)[0][1] == expected([float(i) for i in range(5000)]) and asked


def test_nothing_but_counts_is_shuffled(spark, monkeypatch):
    """Rows of one pass that leave a task are bounded by the buckets, not by the values."""
    monkeypatch.setattr(quantiles, "BUCKETS", 8)
    df = spark.range(10_000, numPartitions=2).selectExpr("CAST(id AS DOUBLE) AS c0")
    whole = quantiles.Interval(0, 0.0, 9999.0, 0, 10_000)
    counted = quantiles._counts(df, [whole, quantiles.Interval(0, 100.0, 200.0, 0, 10_000, whole)])
    assert [n for _, n, *_ in counted[0]] == [1250] * 8 and [b for b, *_ in counted[1]] == [-1, *range(8)]
    empty = column_summary(df.limit(0), ["c0"]).first()
    assert empty["median"] is None and empty["missing"] == 0
