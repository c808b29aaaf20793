"""Runs registered queries and their SQL side by side and compares the rows."""

from __future__ import annotations

import math
import time

import duckdb
from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "\0null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return repr(v + 0.0)
    return repr(v) if isinstance(v, (int, str)) else str(v)


def _rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark: SparkSession, con, sf_dir: str, name: str, fn, sql: str | None) -> dict:
    t = time.time()
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    spark_s = time.time() - t
    out = {"name": name, "rows": len(got), "spark_s": round(spark_s, 2), "ok": True, "why": ""}
    plan = df._jdf.queryExecution().executedPlan().toString()
    if "CartesianProduct" in plan or "NestedLoopJoin" in plan:
        out.update(ok=False, why="pairs every row with every other")
        return out
    if sql is None:
        out["why"] = "rows only"
        return out
    t = time.time()
    res = con.execute(sql)
    cols = [d[0] for d in res.description]
    want = res.fetchall()
    out["sql_s"] = round(time.time() - t, 2)
    a, b = _rows(df.columns, got), _rows(cols, want)
    if sorted(df.columns) != sorted(cols):
        out.update(ok=False, why=f"columns {df.columns} vs {cols}")
    elif a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        out.update(ok=False, why=f"{len(a)} vs {len(b)} rows; e.g. {diff}")
    return out
