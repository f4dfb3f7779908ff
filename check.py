"""Compare registered queries with their SQL in DuckDB: ``python check.py [names…]``."""

from __future__ import annotations

import os
import sys
import time
import traceback

import duckdb
import pandas as pd

from clanmark.registry import load
from clanmark.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def normal(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    rows = []
    for row in frame.itertuples(index=False):
        cells = []
        for v in row:
            if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
                cells.append("~")
            elif hasattr(v, "item"):
                v = v.item()
                cells.append(f"{v:.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v))
            elif isinstance(v, (int, float)) and not isinstance(v, bool):
                cells.append(f"{v:.6f}")
            else:
                cells.append(str(v))
        rows.append(tuple(cells))
    return sorted(rows)


def database(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def compare(spark, con, folder: str, name: str, base) -> str:
    started = time.time()
    got = base.QUERIES[name](spark, folder).toPandas()
    took = time.time() - started
    if name not in base.ORACLES:
        return f"rows-only {len(got)} rows, {took:.1f}s"
    relation = con.execute(base.ORACLES[name])
    want = relation.df()
    if sorted(got.columns) != sorted(want.columns):
        return f"FAIL columns {sorted(got.columns)} / {sorted(want.columns)}"
    a, b = normal(got), normal(want)
    if a == b and a:
        return f"ok {len(a)} rows, {took:.1f}s"
    if not a and not b:
        return "FAIL both empty"
    only_a = [r for r in a if r not in set(b)][:3]
    only_b = [r for r in b if r not in set(a)][:3]
    return f"FAIL {len(a)} / {len(b)} rows\n   spark {only_a}\n   sql   {only_b}"


def main(names: list[str]) -> int:
    folder = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
    base = load()
    spark, con = local_session(), database(folder)
    failed = 0
    for name in names or base.QUERIES:
        try:
            result = compare(spark, con, folder, name, base)
        except Exception as error:  # report and go on
            lines = str(error).splitlines()
            result = f"FAIL {type(error).__name__} " + " | ".join(lines[:6])[:900]
            if os.environ.get("CHECK_TRACE"):
                traceback.print_exc()
        failed += result.startswith("FAIL")
        print(f"{name}: {result}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
