"""Run registered queries against their reference SQL and report differences.

    python -m checks.compare [sf_dir] [name ...]
"""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

from checks import ORACLES, QUERIES
from updraft.session import build_session

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def normal(frame: pd.DataFrame) -> list[tuple]:
    """Rows as sorted tuples of comparable text."""
    def text(v) -> str:
        if v is None or v is pd.NA or (isinstance(v, float) and v != v):
            return "null"
        if hasattr(v, "item"):
            v = v.item()
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, (int, float)):
            return f"{float(v):.6f}".replace("-0.000000", "0.000000")
        return str(v)

    ordered = frame[sorted(frame.columns)]
    return sorted(tuple(text(v) for v in row) for row in ordered.astype(object).itertuples(index=False))


def main(argv: list[str]) -> int:
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    wanted = argv[1:] or list(QUERIES)
    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    failed = 0
    for name in wanted:
        try:
            start = time.time()
            mine = QUERIES[name](spark, sf_dir).toPandas()
            took = time.time() - start
            if name not in ORACLES:
                print(f"rows  {name}: {len(mine)} rows {took:.1f}s", flush=True)
                continue
            start = time.time()
            theirs = con.execute(ORACLES[name]).df()
            other = time.time() - start
            problem = ""
            if sorted(mine.columns) != sorted(theirs.columns):
                problem = f"columns {sorted(mine.columns)} vs {sorted(theirs.columns)}"
            else:
                a, b = normal(mine), normal(theirs)
                if a != b:
                    diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
                    problem = f"rows {len(a)} vs {len(b)}; {sorted(mine.columns)} {diff}"
            failed += bool(problem)
            print(f"{'FAIL' if problem else 'ok  '}  {name}: {len(mine)} rows {took:.1f}s "
                  f"(duckdb {other:.1f}s) {problem}", flush=True)
        except Exception as exc:
            failed += 1
            print(f"ERROR {name}: {str(exc)[:900]}", flush=True)
    print(f"{len(wanted)} queries, {failed} failed")
    return failed


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
