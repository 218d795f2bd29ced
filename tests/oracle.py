"""Compare registered queries with their DuckDB twins: ``python tests/oracle.py SF [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return "∅"
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(bool(v))
    if isinstance(v, float) or type(v).__name__ in ("float32", "float64"):
        return f"{float(v):.9g}"
    if hasattr(v, "tolist") and not isinstance(v, str):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_cell(x) for x in v) + "]"
    if isinstance(v, pd.Timestamp):
        return v.isoformat()
    return str(v)


def rows(pdf: pd.DataFrame) -> list[tuple]:
    pdf = pdf[sorted(pdf.columns)].astype(object)
    return sorted(tuple(_cell(v) for v in r) for r in pdf.itertuples(index=False))


def difference(left: pd.DataFrame, right: pd.DataFrame) -> str | None:
    if sorted(left.columns) != sorted(right.columns):
        return f"columns {sorted(left.columns)} / {sorted(right.columns)}"
    a, b = rows(left), rows(right)
    if a == b:
        return None
    only_a = [r for r in a if r not in set(b)][:3]
    only_b = [r for r in b if r not in set(a)][:3]
    return f"rows {len(a)} / {len(b)}; spark only {only_a}; oracle only {only_b}"


def main() -> None:
    from conftest import make_spark
    from foliospark.plans import QUERIES

    sf_dir = f"/root/testdata/sf{sys.argv[1]}"
    names = sys.argv[2:] or list(QUERIES)
    spark = make_spark()
    con = connect(sf_dir)
    for name in names:
        q = QUERIES[name]
        try:
            t0 = time.time()
            got = q.plan(spark, sf_dir).toPandas()
            t1 = time.time()
            if q.sql is None:
                print(f"{name}: rows only, {len(got)} rows, {t1 - t0:.1f}s", flush=True)
                continue
            want = con.execute(q.sql).df()
            t2 = time.time()
            bad = difference(got, want)
            print(f"{name}: {'ok' if bad is None else 'DIFF ' + bad} ({len(got)} rows, spark {t1 - t0:.1f}s, duckdb {t2 - t1:.1f}s)", flush=True)
        except Exception as e:
            print(f"{name}: ERROR {type(e).__name__} {str(e)[:1200]}", flush=True)


if __name__ == "__main__":
    main()
