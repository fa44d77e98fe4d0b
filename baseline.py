"""Times the SQL oracles of the headline queries in one DuckDB process, as a baseline for bench.py.

BENCH_SF_DIR: table folder, BENCH_QUERIES: names to run. Prints one JSON line.
"""

import json
import os
import time

import duckdb

from bench import HEADLINE
from tallybook.plans.oracle import ORACLE


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = os.environ.get("BENCH_QUERIES", "").split() or [n for n in HEADLINE if n in ORACLE]
    con = duckdb.connect()
    for table in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    times = {}
    for name in names:
        began = time.perf_counter()
        con.execute(f"create or replace temp table result as {ORACLE[name]}")
        times[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"engine": f"duckdb {duckdb.__version__}", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times}))


if __name__ == "__main__":
    main()
