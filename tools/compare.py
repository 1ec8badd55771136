"""Run registered queries on Spark and their SQL on DuckDB and compare all rows.

    python tools/compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from fieldloom.acceptance import CASES  # noqa: E402
from fieldloom.session import local_session  # noqa: E402


def cell(v):
    if v is None:
        return ""
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, bool):
        return repr(v)
    if isinstance(v, int):
        return repr(v)
    return str(v)


def kind(v):
    return "number" if isinstance(v, (int, float)) and not isinstance(v, bool) else type(v).__name__


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(row[i]) for i in order) for row in rows)


def main(argv):
    folder = argv[0] if argv else "/root/testdata/sf0.01"
    chosen = argv[1:] or list(CASES)
    spark = local_session(8, 8, "compare")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in sorted(os.listdir(folder)):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{folder}/{f}'")
    bad = 0
    for name in chosen:
        c = CASES[name]
        t0 = time.time()
        try:
            df = c.run(spark, folder)
            got = df.collect()
            t1 = time.time()
            if c.sql is None:
                print(f"{name:26} rows-only {len(got)} {t1 - t0:.2f}s", flush=True)
                continue
            rel = con.execute(c.sql)
            names = [d[0] for d in rel.description]
            want = rel.fetchall()
            t2 = time.time()
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"{name:26} ERROR {type(e).__name__}: {str(e)[:600]}", flush=True)
            continue
        a, b = rows_of(df.columns, got), rows_of(names, want)
        types = [f"{n}:{t}" for n, t in df.dtypes]
        note = ""
        if sorted(df.columns) != sorted(names):
            note = f"COLUMNS {sorted(df.columns)} {sorted(names)}"
        elif a != b:
            left = [x for x in a if x not in set(b)][:3]
            right = [x for x in b if x not in set(a)][:3]
            note = f"DIFF rows {len(a)}/{len(b)} spark {left} duckdb {right}"
        if note:
            bad += 1
        print(f"{name:26} {'ok' if not note else 'BAD'} {len(a)} rows spark {t1 - t0:.2f}s duckdb {t2 - t1:.2f}s {note}"
              + (f" {types}" if note else ""), flush=True)
    print("failed:", bad, "of", len(chosen))
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
