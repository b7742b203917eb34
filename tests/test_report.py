"""Density curves against the kernel sum itself, and splits of an exact size."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pacegrid.plans import models as M
from pacegrid.plans import report


def test_density_curve(spark):
    values = {"a": [float(i * i % 97) for i in range(200)], "b": [5.0] * 30, None: [1.0, 2.0, 4.0], "c": [0.0]}
    rows = [(g, v) for g, all_ in values.items() for v in all_] + [("a", None), ("d", None), ("a", float("nan"))]
    got = report.density_curve(spark.createDataFrame(rows, "model string, p double"), "p", points=256).collect()
    assert {r["model"] for r in got} == set(values) and len(got) == 4 * 256
    for g, all_ in values.items():
        v = np.array(all_)
        curve = sorted((r["x"], r["density"]) for r in got if r["model"] == g)
        x, y = map(np.array, zip(*curve))
        deviation = v.std(ddof=1) if len(v) > 1 else 0.0
        q1, q3 = np.quantile(v, [0.25, 0.75])
        width = 0.9 * (min(deviation, (q3 - q1) / 1.34) or deviation or abs(v.min()) or 1.0) * len(v) ** -0.2
        whole = np.exp(-(((x[:, None] - v) / width) ** 2) / 2).sum(1) / (len(v) * width * math.sqrt(2 * math.pi))
        # sharing a value between two grid points smooths a little
        assert np.abs(y - whole).max() < 0.01 * whole.max() and (np.diff(x) > 0).all()
        assert np.trapezoid(y, x) == pytest.approx(1, abs=0.01)
    assert report.density_curve(spark.createDataFrame([], "model string, p double"), "p").count() == 0


@pytest.mark.parametrize("share", [0.0, 0.25, 0.8, 1.0])
def test_split_has_its_exact_size(spark, share):
    """Distinct keys, and one key on half the rows."""
    for key in (F.col("id"), F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id"))):
        df = spark.range(1001).select(key.alias("k"), F.col("id").alias("v"))
        split = M.exact_split(df, ["k"], share, "part")
        assert split.where("part = 'train'").count() == math.floor(share * 1001 + 0.5) and split.count() == 1001
        assert split.columns == ["k", "v", "part"]
    assert M.exact_split(df.limit(0), ["k"], share, "part").count() == 0
