"""Runs queries beside their SQL and tells where they differ. Usage: python tests/oracle_check.py SF_DIR [NAME...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def norm(x):
    if x is None or isinstance(x, float) and math.isnan(x) or str(x) in ("nan", "<NA>", "NaT"):
        return None
    if isinstance(x, bool):
        return x
    try:
        return round(float(x), 5) if not isinstance(x, str) else x
    except (TypeError, ValueError):
        return str(x)


def tables(con, d):
    for p in Path(d).glob("*.parquet"):
        con.execute(f"create or replace view {p.stem} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")


def differences(spark, con, d, name, query, sql) -> str:
    a = query(spark, d).toPandas()
    b = con.execute(sql).df()
    if sorted(a.columns) != sorted(b.columns):
        return f"columns {sorted(a.columns)} {sorted(b.columns)}"
    cols = sorted(a.columns)
    rows = lambda df: sorted((tuple(norm(x) for x in r) for r in df[cols].astype(object).itertuples(index=False)), key=repr)
    x, y = rows(a), rows(b)
    if len(x) != len(y):
        return f"rows {len(x)} {len(y)}; only left {list(set(x) - set(y))[:3]}; only right {list(set(y) - set(x))[:3]}"
    bad = [(p, r) for p, r in zip(x, y, strict=True) if p != r]
    return f"{len(bad)} of {len(x)} differ: {bad[:2]}" if bad else ""


if __name__ == "__main__":
    import duckdb

    import __spark_entry__ as e
    from mnemospark.session import local_session

    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con, d = duckdb.connect(), sys.argv[1]
    tables(con, d)
    queries, oracle = e.queries(), e.oracle_sql()
    for name in sys.argv[2:] or oracle:
        t = time.time()
        try:
            print(f"{name}: {differences(spark, con, d, name, queries[name], oracle[name]) or 'same'} ({time.time() - t:.1f} s)", flush=True)
        except Exception as x:  # noqa: BLE001
            print(f"{name}: failed: {str(x)[:600]}", flush=True)
