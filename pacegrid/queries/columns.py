"""Choosing columns, filtering, casting and defaults."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from pacegrid.operators import columns as C
from pacegrid.operators.stats import category_code as coded
from pacegrid.queries.base import query


@query(
    "select_matching",
    """
    SELECT l_orderkey, l_extendedprice, l_discount, l_tax, l_returnflag
    FROM lineitem
    """,
)
def select_matching(t):
    df = t.lineitem
    matching = [*C.names_containing(df, "PRICE", "disc"), *C.names_starting(df, "L_TAX", "l_ret")]
    return df.select("l_orderkey", *matching)


@query("select_except", "SELECT * EXCLUDE (o_orderdate, o_totalprice) FROM orders")
def select_except(t):
    df = t.orders
    return df.select(C.names_except(df, ["o_orderdate"], ["o_totalprice", "absent"]))


@query(
    "filter_range",
    """
    SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice <= 60000
    """,
)
def filter_range(t):
    return t.orders.where(F.col("o_totalprice") <= 60000).select("o_orderkey", "o_totalprice")


@query(
    "filter_not_pair",
    """
    SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders
    WHERE NOT (o_orderstatus = 'F' AND o_orderpriority = '5-LOW')
    """,
)
def filter_not_pair(t):
    pair = (F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "5-LOW")
    return t.orders.where(~pair).select("o_orderkey", "o_orderstatus", "o_orderpriority")


GAPS_SQL = """
    SELECT c_custkey, CASE WHEN c_acctbal >= 1000 THEN c_acctbal END AS balance,
           CASE WHEN c_mktsegment <> 'MACHINERY' THEN c_mktsegment END AS segment,
           CASE WHEN c_nationkey >= 5 THEN c_nationkey END AS nation
    FROM customer
"""


def with_gaps(t):
    return t.customer.select(
        "c_custkey",
        F.when(F.col("c_acctbal") >= 1000, F.col("c_acctbal")).alias("balance"),
        F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_mktsegment")).alias("segment"),
        F.when(F.col("c_nationkey") >= 5, F.col("c_nationkey")).alias("nation"),
    )


@query("dropna_subset", f"SELECT * FROM ({GAPS_SQL}) g WHERE balance IS NOT NULL AND nation IS NOT NULL")
def dropna_subset(t):
    return with_gaps(t).dropna(subset=["balance", "nation"])


@query(
    "dropna_any",
    f"SELECT * FROM ({GAPS_SQL}) g WHERE balance IS NOT NULL AND nation IS NOT NULL AND segment IS NOT NULL",
)
def dropna_any(t):
    return with_gaps(t).dropna("any")


@query(
    "fillna_per_column",
    f"""
    SELECT c_custkey, coalesce(balance, 150) AS balance, coalesce(segment, 'NONE') AS segment,
           coalesce(nation, 0) AS nation
    FROM ({GAPS_SQL}) g
    """,
)
def fillna_per_column(t):
    return C.fill_defaults(with_gaps(t), {"balance": 150, "segment": "NONE", "nation": 0})


@query(
    "fillna_sentinel",
    f"""
    SELECT c_custkey, coalesce(balance, -999) AS balance, segment, coalesce(nation, -999) AS nation
    FROM ({GAPS_SQL}) g
    """,
)
def fillna_sentinel(t):
    return C.fill_sentinel(with_gaps(t))


@query(
    "map_by_type",
    """
    SELECT p_partkey, upper(p_name) AS p_name, upper(p_brand) AS p_brand, upper(p_type) AS p_type, p_size,
           p_retailprice
    FROM part
    """,
)
def map_by_type(t):
    return C.map_by_type(t.part, T.StringType, F.upper)


@query("distinct_values", "SELECT DISTINCT floor(o_totalprice) AS price FROM orders")
def distinct_values(t):
    return t.orders.select(F.floor("o_totalprice").cast("double").alias("price")).distinct()


@query(
    "category_code",
    """
    SELECT p_partkey, p_brand, p_size, CAST(dense_rank() OVER (ORDER BY p_brand) AS BIGINT) AS brand_code,
           CAST(dense_rank() OVER (ORDER BY p_size) AS BIGINT) AS size_code
    FROM part
    """,
)
def category_code(t):
    df = t.part.select("p_partkey", "p_brand", "p_size")
    return coded(coded(df, "p_brand", "brand_code"), "p_size", "size_code")
