"""Stages of wide rows are not left to the JVM's interpreter."""

from conftest import FOLDER

from pacegrid.queries import REGISTRY


def test_queries_keep_generated_methods_small_enough_to_compile(spark):
    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    REGISTRY["param_grid"].run(spark, FOLDER)
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
