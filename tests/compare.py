"""Run a query on Spark and its SQL on DuckDB, and compare the rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def duck(sf_dir: str):
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def canonical(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    picked = [tuple((type(r[i]).__name__, canonical(r[i])) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(picked, key=repr)


TYPES = {"INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string"}


def difference(spark_df, con, sql: str) -> str | None:
    """None if both give the same columns, types of values and rows, else what differs."""
    ours = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    relation = con.sql(sql)
    theirs = rows_of(relation.columns, relation.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} against {theirs[0]}"
    spark_types = dict(spark_df.dtypes)
    duck_types = {c: TYPES.get(str(t), str(t)) for c, t in zip(relation.columns, relation.types)}
    if spark_types != duck_types:
        odd = {c: (spark_types[c], duck_types[c]) for c in duck_types if spark_types[c] != duck_types[c]}
        return f"types differ: {odd}"
    if len(ours[1]) != len(theirs[1]):
        return f"{len(ours[1])} rows against {len(theirs[1])}"
    wrong = [(a, b) for a, b in zip(ours[1], theirs[1]) if a != b]
    return f"{len(wrong)} rows differ, first {wrong[0]}" if wrong else None
