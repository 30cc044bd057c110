"""Run every registered query in Spark and its DuckDB twin, compare rows, schema and values.

    python tools/check_twins.py [sf_dir] [name ...]
"""

from __future__ import annotations

import hashlib
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from snapweave.queries import QUERIES  # noqa: E402
from snapweave.session import local_session  # noqa: E402
from snapweave.twins import oracle_sql  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def norm(v):
    if isinstance(v, (bytes, bytearray, memoryview)):
        return bytes(v).hex()
    if isinstance(v, float):
        return round(v, 6)
    return v


def digest(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    keyed = sorted(repr(tuple(norm(r[i]) for i in order)) for r in rows)
    return hashlib.sha256("\n".join(keyed).encode()).hexdigest()[:16]


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = local_session(8)
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    sql = oracle_sql()
    bad = 0
    for n in names:
        t0 = time.time()
        df = QUERIES[n](spark, sf)
        rows = [tuple(r) for r in df.collect()]
        cols = df.columns
        ts = time.time() - t0
        try:
            res = con.execute(sql[n])
            orows = res.fetchall()
            ocols = [d[0] for d in res.description]
        except Exception as e:  # noqa: BLE001
            print(f"{n:24s} ORACLE ERROR {e}")
            bad += 1
            continue
        ok_cols = sorted(cols) == sorted(ocols)
        ok_n = len(rows) == len(orows)
        ok_v = ok_cols and digest(rows, cols) == digest(orows, ocols)
        status = "OK" if (ok_cols and ok_n and ok_v) else "MISMATCH"
        bad += status != "OK"
        print(f"{n:24s} {status:8s} rows {len(rows)}/{len(orows)} cols {ok_cols} spark {ts:.1f}s")
        if status != "OK" and ok_cols:
            order_s = [cols.index(c) for c in sorted(cols)]
            order_o = [ocols.index(c) for c in sorted(ocols)]
            s1 = {repr(tuple(norm(r[i]) for i in order_s)) for r in rows}
            s2 = {repr(tuple(norm(r[i]) for i in order_o)) for r in orows}
            for x in sorted(s1 - s2)[:3]:
                print("   spark only:", x[:300])
            for x in sorted(s2 - s1)[:3]:
                print("   twin  only:", x[:300])
        elif not ok_cols:
            print("   spark cols", cols, "twin cols", ocols)
    print("mismatches:", bad)


if __name__ == "__main__":
    main()
