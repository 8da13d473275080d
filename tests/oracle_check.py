"""Run registered queries against their DuckDB oracle SQL and compare.

Usage: python tests/oracle_check.py [sf_dir] [name-prefix ...]
Set ORACLE_STRICT=1 to compare floats exactly (no rounding).
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        if os.environ.get("ORACLE_STRICT"):
            return v + 0.0
        return round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "isoformat"):
        return str(v)[:19]
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def compare(spark, name, fn, sql, sf_dir, con):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    res = con.execute(sql)
    d_cols = [d[0] for d in res.description]
    d_rows = res.fetchall()
    ok_cols = sorted(s_cols) == sorted(d_cols)
    ok_n = len(s_rows) == len(d_rows)
    a, b = rows_of(s_cols, s_rows), rows_of(d_cols, d_rows)
    ok_v = ok_cols and a == b
    diff = None
    if not ok_v and ok_cols:
        sa, sb = set(a), set(b)
        diff = (list(sa - sb)[:3], list(sb - sa)[:3])
    return {"name": name, "cols": ok_cols, "rows": ok_n, "values": ok_v, "n": len(s_rows),
            "n_oracle": len(d_rows), "sec": round(t1 - t0, 2),
            "detail": None if ok_v else (s_cols, d_cols, diff)}


def main():
    from cellgrid.session import local_session
    import __spark_entry__ as E

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = sys.argv[2:]
    spark = local_session()
    con = duck(sf_dir)
    qs, orc = E.queries(), E.oracle_sql()
    bad = 0
    for name in sorted(qs):
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        if name not in orc:
            df = qs[name](spark, sf_dir)
            print(f"ROWS-ONLY {name}: {df.count()} rows")
            continue
        try:
            r = compare(spark, name, qs[name], orc[name], sf_dir, con)
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"ERROR {name}: {type(e).__name__}: {str(e)[:800]}")
            continue
        status = "OK " if r["values"] else "BAD"
        bad += 0 if r["values"] else 1
        print(f"{status} {name}: n={r['n']} oracle={r['n_oracle']} {r['sec']}s"
              + ("" if r["values"] else f" {r['detail']}"))
    print("bad:", bad)


if __name__ == "__main__":
    main()
