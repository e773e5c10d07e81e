"""Run registered queries beside their SQL on one scale folder and compare the rows.

usage: python tools/verify.py [sf_dir] [name-substring ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from tidemark.plans import catalog  # noqa: E402
from tidemark.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def plain(value):
    if value is None:
        return None
    if isinstance(value, float):
        return "nan" if math.isnan(value) else (0.0 if value == 0 else value)
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(
        (tuple(plain(row[i]) for i in order) for row in rows),
        key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r),
    )


def compare(left, right) -> str:
    (ln, lr), (rn, rr) = left, right
    if ln != rn:
        return f"COLUMNS {sorted(set(ln) ^ set(rn))}"
    if len(lr) != len(rr):
        return f"ROWS spark={len(lr)} sql={len(rr)}"
    bad = [(a, b) for a, b in zip(lr, rr) if repr(a) != repr(b)]
    if bad:
        a, b = bad[0]
        cols = [(n, x, y) for n, x, y in zip(ln, a, b) if repr(x) != repr(y)]
        return f"VALUES {len(bad)}/{len(lr)} first={cols[:4]} row={a}"
    return "ok"


def connect(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf}/{name}.parquet')")
    return con


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = local_session()
    con = connect(sf)
    oracles = catalog.oracle_sql()
    failed = []
    for name, fn in catalog.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            df = fn(spark, sf)
            rows = [tuple(r) for r in df.collect()]
            took = time.time() - start
            if name not in oracles:
                print(f"{name:42s} {took:6.2f}s rows={len(rows)} (no sql) {rows[:1]}"[:400], flush=True)
                continue
            result = con.execute(oracles[name])
            names = [d[0] for d in result.description]
            verdict = compare(table(df.columns, rows), table(names, result.fetchall()))
        except Exception as error:  # report and go on with the next query
            took = time.time() - start
            verdict = f"ERROR {type(error).__name__}: {str(error)[:700]}"
            rows = []
        if verdict != "ok":
            failed.append(name)
        print(f"{name:42s} {took:6.2f}s rows={len(rows)} {verdict}", flush=True)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
