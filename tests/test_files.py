"""CSV sources and sinks, and small reshaping properties."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pacegrid.operators import reshape, sets
from pacegrid.operators.columns import names_between, names_containing, names_except
from pacegrid.sources import schemas
from pacegrid.sources.files import read_csv, write_csv
from pacegrid.sources.teams import TEAMS, team_lookup


def test_csv_missing_values_and_order(spark, tmp_path):
    path = tmp_path / "laps.csv"
    path.write_text("a,b\nx,1\n,2\nNA,NA\nz,oops\n")
    schema = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.IntegerType())])
    rows = read_csv(spark, str(path), schema, sequence="_seq").orderBy("_seq").collect()
    assert [(r["a"], r["b"]) for r in rows] == [("x", 1), (None, 2), (None, None), ("z", None)]


def test_csv_columns_are_found_by_name(spark, tmp_path):
    path = tmp_path / "feed.csv"
    path.write_text('b,extra,a\n2,x,"say ""hi"", ok"\n,y,"two\tcells, one"\n')
    schema = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.IntegerType())])
    rows = read_csv(spark, str(path), schema).collect()
    assert [(r["a"], r["b"]) for r in rows] == [('say "hi", ok', 2), ("two\tcells, one", None)]
    with pytest.raises(ValueError, match="has no column c"):
        read_csv(spark, str(path), schema.add("c", T.IntegerType()))


def test_csv_quotes_come_back(spark, tmp_path):
    df = spark.createDataFrame([('say "hi", ok', 1), ("plain", 2), ("a\\b", 3)], "a string, b int")
    write_csv(df, str(tmp_path / "out"))
    assert '""hi""' in "".join(p.read_text() for p in (tmp_path / "out").glob("*.csv"))
    assert sorted(read_csv(spark, str(tmp_path / "out"), df.schema).collect()) == sorted(df.collect())


def test_single_file(spark, tmp_path):
    write_csv(spark.range(10).repartition(4), str(tmp_path / "out"), single=True)
    assert len(list((tmp_path / "out").glob("*.csv"))) == 1


def test_schemas_and_teams(spark):
    assert "EVENTS" in schemas.weather("EVENTS").names
    assert {"S1_LARGE", "PIT_TIME", "ELAPSED"} <= set(schemas.LAPS.names)
    assert len(TEAMS) == 12 and team_lookup(spark).select("NUMBER").distinct().count() == 24


def test_unpivot_then_pivot_is_identity(spark):
    df = spark.createDataFrame([(1, 2.0, None), (2, None, None), (3, 4.0, 5.0)], "id int, a double, b double")
    long = reshape.unpivot_measures(df, ["id"], ["a", "b"], "name", "value")
    assert long.count() == 6
    back = reshape.pivot_measures(long, ["id"], "name", ["a", "b"], ["value"])
    assert sorted(back.collect()) == sorted(df.collect())


def test_nest_keeps_every_row(spark):
    df = spark.range(25).select((F.col("id") % 2).alias("k"), "id")
    nested = reshape.nest(df, ["k"], ["id"], ["id"], "rows", block=5)
    assert nested.agg(F.max(F.size("rows"))).first()[0] == 5
    assert sorted(r["id"] for r in reshape.unnest(nested, "rows").collect()) == list(range(25))


def test_tagged_union_loses_nothing(spark):
    both = sets.tagged_union({"TRAIN": spark.range(5), "TEST": spark.range(3).withColumn("x", F.lit(1))}, "tr")
    assert sets.of_tag(both, "tr", "TRAIN").count() == 5 and sets.of_tag(both, "tr", "TEST").count() == 3
    assert sets.of_tag(both, "tr", "TRAIN").where("x is null").count() == 5


def test_names(spark):
    df = spark.createDataFrame([], "AIR_A int, b int, WIND_C int, d int")
    assert names_containing(df, "air", "wind") == ["AIR_A", "WIND_C"]
    assert names_between(df, "b", "d") == ["b", "WIND_C", "d"]
    assert names_except(df, ["b"], ["d"]) == ["AIR_A", "WIND_C"]
