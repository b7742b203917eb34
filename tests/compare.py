"""Run a query on Spark and its SQL twin on DuckDB, and compare the row multisets."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        path = f"{folder}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(v):
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return v + 0.0
    return v


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(r[i]) for i in order) for r in rows)


SPARK_KINDS = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "float": "FLOAT"}


def differences(name: str, df, con, sql: str) -> list[str]:
    relation = con.sql(sql)
    found = []
    if sorted(df.columns) != sorted(relation.columns):
        return [f"{name}: columns {sorted(df.columns)} != {sorted(relation.columns)}"]
    kinds = dict(zip(relation.columns, map(str, relation.types)))
    for column, kind in df.dtypes:
        if SPARK_KINDS.get(kind, kind) != kinds[column]:
            found.append(f"{name}: type of {column} is {kind}, {kinds[column]}")
    ours, theirs = rows_of(df.columns, df.collect()), rows_of(relation.columns, relation.fetchall())
    if ours != theirs:
        extra, lacking = list((ours - theirs).items()), list((theirs - ours).items())
        found.append(
            f"{name}: {sum(ours.values())} rows against {sum(theirs.values())}; columns {sorted(df.columns)};"
            f" ours only {len(extra)} {extra[:3]}; theirs only {len(lacking)} {lacking[:3]}"
        )
    return found
