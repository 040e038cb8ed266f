"""Run every registered query on Spark and its SQL on DuckDB, and compare the rows.

    python tools/check_queries.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

from tablewright.registry import ORACLES, QUERIES  # noqa: E402
from tablewright.registry.base import TABLES  # noqa: E402
from tablewright.session import build_session  # noqa: E402


def plain(value) -> str:
    if value is None or value is pd.NaT or (isinstance(value, float) and value != value):
        return "null"
    if isinstance(value, pd.Timestamp):
        return value.isoformat()
    return repr(value.item() if hasattr(value, "item") else value)


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple(plain(v) for v in row) for row in frame.itertuples(index=False))


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = build_session(
        "check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{args.sf}/{name}.parquet')")
    bad = []
    for name, run in QUERIES.items():
        if args.names and name not in args.names:
            continue
        start = time.time()
        try:
            got = run(spark, args.sf).toPandas()
            took = time.time() - start
            if name not in ORACLES:
                print(f"rows  {name:36s} {len(got):7d} {took:6.2f}s")
                if not len(got):
                    bad.append(name)
                continue
            want = db.execute(ORACLES[name]).df()
            oracle_took = time.time() - start - took
            a, b = rows(got), rows(want)
            same = sorted(got.columns) == sorted(want.columns) and a == b
            print(f"{'ok   ' if same else 'DIFF '} {name:36s} {len(got):7d} {took:6.2f}s (sql {oracle_took:.2f}s)")
            if not same:
                bad.append(name)
                print("   columns", sorted(got.columns), sorted(want.columns), len(a), len(b))
                extra, missing = [r for r in a if r not in set(b)][:3], [r for r in b if r not in set(a)][:3]
                print("   only spark:", *extra, sep="\n      ")
                print("   only sql:  ", *missing, sep="\n      ")
        except Exception as error:
            bad.append(name)
            print(f"FAIL  {name}: {str(error).splitlines()[0][:300]}")
            if os.environ.get("TRACE"):
                traceback.print_exc()
    print(f"{len(bad)} of {len(args.names) or len(QUERIES)} differ: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
