"""Run a registered query and its DuckDB oracle side by side (tests and checks).

Outputs are made comparable the same way on both sides: column names sorted,
numbers as float64 rounded to 6 places, rows sorted; the result is a dict
with row counts, schema match and value match.
"""

from __future__ import annotations

import math
import os

from pyspark.sql import DataFrame
from pyspark.sql import types as T

DRIVER_VIEWS = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def canonical(df: DataFrame) -> DataFrame:
    """Cast to the comparison types: decimals/floats to double, integers to
    bigint, dates to ISO text; column metadata dropped."""
    from pyspark.sql import functions as F
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        t = f.dataType
        if isinstance(t, (T.DecimalType, T.FloatType)):
            c = c.cast("double")
        elif isinstance(t, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(t, T.DateType):
            c = c.cast("string")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "as_integer_ratio") and not isinstance(v, int):
        return round(float(v), 6)
    if hasattr(v, "isoformat"):
        return v.isoformat()[:10]
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


def duckdb_run(sql: str, sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for v in DRIVER_VIEWS + ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        p = os.path.join(sf_dir, f"{v}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {v} AS SELECT * FROM read_parquet('{p}')")
    rel = con.execute(sql)
    cols = [d[0] for d in rel.description]
    return cols, rel.fetchall()


def compare(df: DataFrame, sql: str | None, sf_dir: str) -> dict:
    sdf = canonical(df)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    res = {"spark_rows": len(s_rows), "spark_cols": sorted(s_cols)}
    if sql is None:
        return res
    d_cols, d_rows = duckdb_run(sql, sf_dir)
    res["oracle_rows"] = len(d_rows)
    res["schema_match"] = sorted(s_cols) == sorted(d_cols)
    if not res["schema_match"]:
        res["oracle_cols"] = sorted(d_cols)
        res["value_match"] = False
        return res
    a, b = _rows(s_cols, s_rows), _rows(d_cols, d_rows)
    res["value_match"] = a == b
    if a != b:
        sa, sb = set(a), set(b)
        res["only_spark"] = sorted(sa - sb, key=str)[:5]
        res["only_oracle"] = sorted(sb - sa, key=str)[:5]
    return res
