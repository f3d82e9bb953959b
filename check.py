"""Run the registered queries next to their SQL and compare the rows.

    python check.py [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

from weftline.plans.queries import ORACLES, QUERIES, TABLES
from weftline.session import local_session


def rows_of(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(value: object) -> object:
        if isinstance(value, float):
            return None if math.isnan(value) else round(value, 6)
        return value

    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    db = duckdb.connect()
    for table in TABLES:
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    wrong = []
    for name in names:
        started = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            got = rows_of(df.columns, [tuple(r) for r in df.collect()])
        except Exception as problem:  # noqa: BLE001
            print(f"{name:28} FAILED {type(problem).__name__}: {str(problem)[:600]}", flush=True)
            wrong.append(name)
            continue
        seconds = time.time() - started
        if name not in ORACLES:
            print(f"{name:28} {len(got):8} rows  {seconds:6.1f}s  (no SQL)", flush=True)
            continue
        try:
            answer = db.sql(ORACLES[name])
            want = rows_of(answer.columns, answer.fetchall())
        except Exception as problem:  # noqa: BLE001
            print(f"{name:28} SQL FAILED {str(problem)[:600]}", flush=True)
            wrong.append(name)
            continue
        same = got == want and sorted(df.columns) == sorted(answer.columns)
        print(f"{name:28} {len(got):8} rows  {seconds:6.1f}s  {'ok' if same else 'DIFFERENT'}", flush=True)
        if not same:
            wrong.append(name)
            print("   columns", sorted(df.columns), sorted(answer.columns), "rows", len(got), len(want))
            print("   only Spark", [r for r in got if r not in set(want)][:3] if len(got) < 300000 else "")
            print("   only SQL  ", [r for r in want if r not in set(got)][:3] if len(want) < 300000 else "")
    print(f"{len(names) - len(wrong)} of {len(names)} fine; wrong: {wrong}")
    return bool(wrong)


if __name__ == "__main__":
    sys.exit(main())
