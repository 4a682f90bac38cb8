"""Run registered queries in Spark and DuckDB and compare rows; ``python -m checks.compare``."""

from __future__ import annotations

import argparse
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

from checks.registry import ORACLES, QUERIES
from quillwatch.session import build_session


def normal(value: object) -> object:
    return value.item() if hasattr(value, "item") else value


def rows_of(columns: list[str], rows: list[tuple]) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(normal(row[i]) for i in order) for row in rows)


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("--only", default="")
    parser.add_argument("--cpus", default="8")
    args = parser.parse_args()
    spark = build_session(
        master=f"local[{args.cpus}]",
        spark__sql__shuffle__partitions="8",
        spark__ui__enabled="false",
        spark__driver__memory="8g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    db = duckdb.connect()
    for path in sorted(Path(args.sf).glob("*.parquet")):
        db.execute(f"create view {path.stem} as select * from '{path}'")
    failed = 0
    for name, query in QUERIES.items():
        if args.only and not any(part in name for part in args.only.split(",")):
            continue
        started = time.time()
        try:
            frame = query(spark, args.sf)
            ours = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
            if name not in ORACLES:
                print(f"rows  {name} {sum(ours.values())} {time.time() - started:.1f}s")
                continue
            cursor = db.execute(ORACLES[name])
            names = [d[0] for d in cursor.description]
            theirs = rows_of(names, cursor.fetchall())
            if sorted(names) != sorted(frame.columns):
                raise AssertionError(f"columns {sorted(frame.columns)} vs {sorted(names)}")
            if ours != theirs:
                extra, missing = ours - theirs, theirs - ours
                raise AssertionError(
                    f"{sum(ours.values())} vs {sum(theirs.values())} rows; only here "
                    f"{list(extra)[:2]}; only there {list(missing)[:2]}"
                )
            print(f"ok    {name} {sum(ours.values())} {time.time() - started:.1f}s")
        except Exception as error:  # report every query, then fail
            failed += 1
            print(f"FAIL  {name} {str(error)[:700]}")
        sys.stdout.flush()
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
