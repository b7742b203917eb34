"""Groups cut into pieces give the same as whole groups, whatever the skew."""

import pytest
from pyspark.sql import functions as F

from pacegrid.operators import joins, skew
from pacegrid.operators.ordered import Ordered, global_ordinal


@pytest.fixture(scope="module")
def skewed(spark):
    """600 rows; a third share key 'hot', one key is null, and readings have gaps longer than a piece."""
    n = F.col("id")
    key = F.when(n % 3 == 0, "hot").when(n % 7 == 1, None).otherwise(F.concat(F.lit("k"), (n % 40).cast("string")))
    df = spark.range(600).select(
        key.alias("k"),
        ((n * 37) % 101).alias("minute"),
        F.when(n % 50 == 9, None).otherwise((n * 53) % 17).cast("int").alias("late"),
        n.alias("id"),
        F.when((n * 11) % 23 == 0, n.cast("double")).alias("reading"),
        ((n * 29) % 97 - 40).alias("step"),
    )
    return df.cache()


def everything(df, order):
    ordered = Ordered(df, ["k"], order)
    ordered = ordered.number("n").size("all").running_total("step", "sum")
    ordered = ordered.shift({"b1": ("step", 1), "a1": ("step", -1), "b4": ("id", 4), "a4": ("id", -4)})
    copies = {c: F.col("reading") for c in ("down", "up", "updown", "downup", "mean")}
    ordered = ordered.map(lambda d: d.withColumns(copies))
    ordered = ordered.fill(["down"], "down").fill(["up"], "up").fill(["updown"], "updown").fill(["downup"], "downup")
    frame = ordered.impute_mean(["mean"]).frame.withColumn("mean", F.round("mean", 9))
    return ordered.groups.split, sorted(frame.select(sorted(frame.columns)).collect(), key=lambda r: r["id"])


@pytest.mark.parametrize("order", [["minute", "id"], ["late", "minute", "id"]])
def test_cut_equals_whole(spark, skewed, order, request):
    split, whole = everything(skewed, order)
    assert not split
    request.getfixturevalue("splitting")
    split, cut = everything(skewed, order)
    assert split
    assert cut == whole


def test_pieces_are_bounded(spark, skewed, splitting):
    groups = skew.plan_groups(skewed, ["k"], ["minute", "id"])
    sizes = groups.attach(skewed).where(f"{skew.PIECE} > 0").groupBy("k", skew.PIECE).count().collect()
    assert max(r["count"] for r in sizes if r["k"] == "hot") < 200
    assert len(sizes) <= 2 * 6 + 1
    assert {r["k"] for r in sizes} >= {"hot"}


def test_global_ordinal(spark, skewed, splitting):
    rows = global_ordinal(skewed, ["minute", "id"], "n").orderBy("minute", "id").select("n").collect()
    assert [r["n"] for r in rows] == list(range(1, 601))


@pytest.mark.parametrize("how", ["left", "inner"])
def test_salted_join_equals_plain(spark, skewed, splitting, how):
    right = skewed.select("k", F.col("step").alias("other")).distinct().where("other > 30 or k is null")
    assert skew.large_groups(skewed, ["k"])
    joined = joins.salted_join(skewed.select("k", "id"), right, ["k"], how)
    keep = "LEFT" if how == "left" else "INNER"
    skewed.createOrReplaceTempView("l")
    right.createOrReplaceTempView("r")
    plain = spark.sql(f"SELECT l.k, l.id, r.other FROM l {keep} JOIN r ON l.k <=> r.k")
    key = lambda r: (str(r["k"]), r["id"], r["other"] if r["other"] is not None else -999)
    assert sorted(joined.select("k", "id", "other").collect(), key=key) == sorted(plain.collect(), key=key)


def test_copies_of_one_row_survive_the_salt(spark, splitting):
    copies = spark.range(0, 300, 1, 8).select(F.lit("x").alias("k"), F.lit(1).alias("v"))
    right = spark.createDataFrame([("x", 5), ("y", 6)], "k string, w int")
    joined = joins.salted_join(copies, right, ["k"])
    assert joined.groupBy("k", "v", "w").count().collect() == [("x", 1, 5, 300)]


def test_grid_join_keeps_gaps_when_a_minute_is_hot(spark, splitting):
    grid = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "m int, g string")
    seen = spark.range(100).select(F.lit(1).alias("m"), F.col("id").alias("x"))
    joined = joins.grid_join(grid, seen, ["m"])
    counts = {r["g"]: (r["n"], r["x"]) for r in joined.groupBy("g").agg(
        F.count(F.lit(1)).alias("n"), F.count("x").alias("x")).collect()}
    assert counts == {"a": (100, 100), "b": (1, 0), "c": (1, 0)}


def test_lookup_beyond_the_bound_is_not_broadcast(spark, skewed):
    small = spark.createDataFrame([("hot", 1)], "k string, w int")
    assert joins.fits_broadcast(small)
    assert not joins.fits_broadcast(skewed, rows=10)
    assert not joins.fits_broadcast(skewed, size=10)


def test_ordinal_of_a_large_table_looks_up_no_cuts(spark, skewed, splitting):
    """Ranges are sorted once: no row is compared with lists of cut values, and nulls come last."""
    numbered = global_ordinal(skewed, ["late", "id"], "n", drop=["reading"])
    assert numbered.columns == [*[c for c in skewed.columns if c != "reading"], "n"]
    assert "lambda" not in numbered._jdf.queryExecution().optimizedPlan().toString()
    rows = numbered.select("late", "id", "n").collect()
    expected = sorted(rows, key=lambda r: (r["late"] is None, r["late"] or 0, r["id"]))
    assert [r["n"] for r in expected] == list(range(1, 601))
