"""Side-by-side check of a registered query against its DuckDB oracle.

Mirrors the driver's gate: same column names (sorted), same row count, same
order-insensitive multiset of values.
"""

from __future__ import annotations

import datetime
import math
import os
import sys

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NULL"
        return repr(float(v))
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (int,)):
        return str(int(v))
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    if hasattr(v, "item"):
        return _norm(v.item())
    return str(v)


def rows_of(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cols = [columns[i] for i in order]
    out = sorted(tuple(_norm(r[i]) for i in order) for r in rows)
    return cols, out


def compare(spark, name: str, fn, sql: str, sf_dir: str, con=None) -> dict:
    df = fn(spark, sf_dir)
    s_cols = df.columns
    s_rows = [tuple(r) for r in df.collect()]
    con = con or duck(sf_dir)
    res = con.execute(sql)
    d_cols = [c[0] for c in res.description]
    d_rows = res.fetchall()
    sc, sr = rows_of(s_cols, s_rows)
    dc, dr = rows_of(d_cols, d_rows)
    out = {"query": name, "spark_rows": len(sr), "oracle_rows": len(dr), "columns_match": sc == dc,
           "values_match": sr == dr}
    if sc != dc:
        out["spark_columns"], out["oracle_columns"] = sc, dc
    elif sr != dr:
        ss, ds = set(sr), set(dr)
        out["only_spark"] = sorted(ss - ds)[:5]
        out["only_oracle"] = sorted(ds - ss)[:5]
    out["ok"] = out["columns_match"] and out["values_match"]
    return out


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "float": "FLOAT"}


def type_diff(spark_df, con, sql: str) -> dict:
    """Columns whose Spark type does not correspond to the oracle's DuckDB type."""
    st = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString())
          for f in spark_df.schema.fields}
    rel = con.sql(sql)
    dt = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    return {c: (st.get(c), dt.get(c)) for c in set(st) | set(dt) if st.get(c) != dt.get(c)}


if __name__ == "__main__":
    import json

    from recordaudit.session import local_session

    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:] or None
    spark = local_session()
    con = duck(sf)
    qs, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if only and name not in only:
            continue
        if name not in oracles:
            n = fn(spark, sf).count()
            print(json.dumps({"query": name, "rows_only": n}))
            continue
        try:
            r = compare(spark, name, fn, oracles[name], sf, con)
        except Exception as e:  # report and continue with the next query
            r = {"query": name, "ok": False, "error": str(e)[:800]}
        bad += not r["ok"]
        print(json.dumps(r, ensure_ascii=False, default=str))
    print("FAILED", bad)

