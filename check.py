"""Compare registered queries with their SQL on one data folder: ``python check.py [folder] [key …]``."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb

from logquarry import build_session
from logquarry.bridge import TABLES, Bridge
from logquarry.plans import load


def cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, bool):
        return int(value)
    return value


def rows(columns: list[str], data) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(cell(r[i]) for i in order) for r in data)


def main() -> int:
    args = sys.argv[1:]
    folder = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    plans = load()
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"create view {table} as select * from '{folder}/{table}.parquet'")
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for key in args or plans:
        entry, started = plans[key], time.time()
        try:
            df = entry.run(Bridge(spark, folder))
            got = rows(df.columns, df.collect())
            spent = time.time() - started
            if entry.sql is None:
                print(f"rows  {key}: {sum(got.values())} rows {spent:.2f}s")
                continue
            result = con.sql(entry.sql)
            names, want = result.columns, None
            want = rows(names, result.fetchall())
            if sorted(names) != sorted(df.columns):
                print(f"BAD   {key}: columns {sorted(df.columns)} against {sorted(names)}")
                bad += 1
            elif got != want:
                print(f"BAD   {key}: {sum(got.values())} against {sum(want.values())} rows; columns {sorted(names)}")
                print("   only ours:", list((got - want).items())[:2])
                print("   only SQL :", list((want - got).items())[:2])
                bad += 1
            else:
                print(f"ok    {key}: {sum(got.values())} rows {spent:.2f}s")
        except Exception as failure:
            print(f"FAIL  {key}: {type(failure).__name__}: {str(failure)[:400]}")
            bad += 1
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
