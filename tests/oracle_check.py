"""Spark-vs-DuckDB comparison used by the tests (mirrors the driver's gate).

Checks row count, column names, a type family per column and every value.
Values are compared exactly after normalisation (dates to ISO text, NaN/NULL to
None); ``rel`` allows a relative tolerance for diagnosis.
"""

from __future__ import annotations

import math
import os

import duckdb
import pandas as pd

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


def duck_connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _family_spark(dt: str) -> str:
    dt = dt.lower()
    if dt in ("double", "float"):
        return "float"
    if dt in ("int", "bigint", "smallint", "tinyint", "integer", "long"):
        return "int"
    if dt.startswith("decimal"):
        return "decimal"
    if dt in ("string",):
        return "str"
    if dt == "date":
        return "date"
    if dt.startswith("timestamp"):
        return "ts"
    if dt == "boolean":
        return "bool"
    return dt


def _family_duck(dt: str) -> str:
    dt = dt.upper()
    if dt in ("DOUBLE", "FLOAT", "REAL"):
        return "float"
    if dt in ("INTEGER", "BIGINT", "SMALLINT", "TINYINT", "HUGEINT", "UBIGINT", "UINTEGER"):
        return "int"
    if dt.startswith("DECIMAL"):
        return "decimal"
    if dt == "VARCHAR":
        return "str"
    if dt == "DATE":
        return "date"
    if dt.startswith("TIMESTAMP"):
        return "ts"
    if dt == "BOOLEAN":
        return "bool"
    return dt.lower()


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19]
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    try:
        if pd.isna(v):
            return None
    except (TypeError, ValueError):
        pass
    if hasattr(v, "item"):
        return v.item()
    return v


def _sort_key(row):
    return tuple((0, "") if x is None else (1, str(x)) for x in row)


def compare(spark_df, sql: str, con, rel: float = 0.0, max_report: int = 5) -> dict:
    s_schema = {f.name: _family_spark(f.dataType.simpleString()) for f in spark_df.schema.fields}
    rel_ = con.sql(sql)
    d_schema = {n: _family_duck(str(t)) for n, t in zip(rel_.columns, rel_.types)}
    out = {"ok": True, "problems": []}
    if sorted(s_schema) != sorted(d_schema):
        out["ok"] = False
        out["problems"].append(f"columns spark={sorted(s_schema)} duck={sorted(d_schema)}")
        return out
    for c in s_schema:
        if s_schema[c] != d_schema[c]:
            out["ok"] = False
            out["problems"].append(f"type {c}: spark={s_schema[c]} duck={d_schema[c]}")
    cols = sorted(s_schema)
    s_rows = [tuple(_norm(r[c]) for c in cols) for r in spark_df.select(*cols).collect()]
    d_rows = [tuple(_norm(x) for x in r) for r in con.sql(
        f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({sql}) q").fetchall()]
    out["rows"] = (len(s_rows), len(d_rows))
    if len(s_rows) != len(d_rows):
        out["ok"] = False
        out["problems"].append(f"row count spark={len(s_rows)} duck={len(d_rows)}")
        return out
    s_rows.sort(key=_sort_key)
    d_rows.sort(key=_sort_key)
    bad = 0
    for a, b in zip(s_rows, d_rows):
        if a != b and not _close(a, b, rel):
            bad += 1
            if bad <= max_report:
                diffs = [(cols[i], x, y) for i, (x, y) in enumerate(zip(a, b)) if x != y]
                out["problems"].append(f"row differs: {diffs[:6]}")
    if bad:
        out["ok"] = False
        out["problems"].append(f"{bad} differing rows of {len(s_rows)}")
    return out


def _close(a, b, rel):
    if rel <= 0:
        return False
    for x, y in zip(a, b):
        if x == y:
            continue
        if isinstance(x, float) and isinstance(y, float):
            if abs(x - y) <= rel * max(1.0, abs(x), abs(y)):
                continue
        return False
    return True
