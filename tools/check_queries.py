"""Run registered queries and compare each with its SQL on DuckDB.

usage: python tools/check_queries.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, (list, tuple)):
        return tuple(normal(v) for v in value)
    if isinstance(value, float):
        return round(value, 9) + 0.0
    if isinstance(value, bool):
        return value
    return value


def rows_of(records, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in records), key=repr)


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def compare(spark, con, name, run, sql, sf_dir) -> tuple[bool | None, str, float]:
    started = time.time()
    df = run(spark, sf_dir)
    got_rows = df.collect()
    took = time.time() - started
    if sql is None:
        return None, f"{len(got_rows)} rows (no SQL)", took
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    want_rows = result.fetchall()
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(names)}", took
    got, want = rows_of([tuple(r) for r in got_rows], df.columns), rows_of(want_rows, names)
    if got == want:
        return True, f"{len(got)} rows", took
    extra, missing = [r for r in got if r not in set(want)][:2], [r for r in want if r not in set(got)][:2]
    return False, f"{len(got)} vs {len(want)} rows; columns {sorted(names)}; only spark {extra}; only sql {missing}", took


def main() -> int:
    from tracelight.plans import all_queries
    from tracelight.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = build_session(master="local[8]", shuffle_partitions=8, spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    failed = 0
    for name, q in all_queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        try:
            ok, detail, took = compare(spark, con, name, q.run, q.sql, sf_dir)
        except Exception as error:  # noqa: BLE001
            ok, detail, took = False, f"{type(error).__name__}: {str(error)[:900]}", 0.0
        failed += ok is False
        print({True: "ok  ", False: "FAIL", None: "rows"}[ok], f"{took:6.1f}s", name, detail, flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main())
