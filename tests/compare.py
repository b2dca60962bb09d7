"""Compare registered queries with their SQL. `python tests/compare.py [sf] [names...]`"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import numpy as np
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def open_tables(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{folder}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _plain(value):
    if value is None or value is pd.NA or value != value:
        return None
    if isinstance(value, (bool, np.bool_)):
        return str(bool(value))
    if isinstance(value, (int, float, np.integer, np.floating)):
        return float(value)
    if hasattr(value, "isoformat"):
        return str(value)[:26].removesuffix(".000000")
    return str(value)


def _key(row):
    return tuple("~" if x is None else f"{x:.4f}" if isinstance(x, float) else x for x in row)


def difference(spark_df, con, sql: str) -> str | None:
    """None when equal, else what differs. Doubles must agree to 2e-6."""
    got = spark_df.toPandas()
    want = con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(set(got.columns) ^ set(want.columns))}"
    if len(got) != len(want):
        return f"rows {len(got)} against {len(want)}"
    names = sorted(got.columns)
    a = [tuple(_plain(x) for x in r) for r in got[names].astype(object).itertuples(index=False)]
    b = [tuple(_plain(x) for x in r) for r in want[names].astype(object).itertuples(index=False)]
    # Sort on exact fields first so that rounding noise in doubles cannot reorder rows.
    order = sorted(range(len(names)), key=lambda i: any(isinstance(r[i], float) and r[i] != int(r[i]) for r in a + b))
    arrange = lambda rows: sorted((tuple(r[i] for i in order) for r in rows), key=_key)
    off = 0
    for x, y in zip(arrange(a), arrange(b)):
        for i, (p, q) in enumerate(zip(x, y)):
            if p == q:
                continue
            if isinstance(p, float) and isinstance(q, float) and abs(p - q) <= 2e-6 * max(1.0, abs(p)):
                off += 1
                continue
            return f"{names[order[i]]}: {p!r} against {q!r} in {dict(zip([names[j] for j in order], x))}"
    return f"{off} values differ in the last rounded place" if off else None


def main() -> int:
    from wattframe.plans.catalog import load_queries
    from wattframe.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    folder = f"/root/testdata/sf{sf}"
    queries = load_queries()
    names = sys.argv[2:] or list(queries)
    if names == ["sql"]:
        names = [n for n, q in queries.items() if q.sql]
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = open_tables(folder)
    bad = 0
    for name in names:
        started = time.time()
        try:
            df = queries[name].run(spark, folder)
            sql = queries[name].oracle()
            if sql is None:
                result = f"rows {df.count()} (no SQL)"
                print(f"  -- {name} {result} {time.time() - started:.1f}s", flush=True)
                continue
            problem = difference(df, con, sql)
            rows = con.execute(f"SELECT count(*) FROM ({sql})").fetchall()[0][0]
        except Exception as error:  # noqa: BLE001 - a report over all queries
            problem, rows = f"{type(error).__name__}: {str(error)[:700]}", -1
        bad += problem is not None
        print(f"{'FAIL' if problem else '  ok'} {name} rows={rows} {time.time() - started:.1f}s {problem or ''}", flush=True)
    print("failed", bad, "of", len(names))
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
