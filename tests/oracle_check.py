"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

Usage: python tests/oracle_check.py [sf_dir] [name-prefix ...]
Compare rule (like the driver): column names sorted, row count, and the
multiset of rows with floats rounded to 6 significant decimals.
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        if v == 0:
            return 0.0
        return float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, bool):
        return int(v)
    return v


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)
    return [cols[i] for i in order], out


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    rel = con.sql(sql)
    drows = rel.fetchall()
    scols, s = canon(sdf.columns, srows)
    dcols, d = canon(rel.columns, drows)
    ok = scols == dcols and len(s) == len(d) and s == d
    msg = ""
    if not ok:
        if scols != dcols:
            msg = f"cols spark-only={sorted(set(scols)-set(dcols))} duck-only={sorted(set(dcols)-set(scols))}"
        elif len(s) != len(d):
            msg = f"rows spark={len(s)} duck={len(d)}"
        else:
            diff = [(a, b) for a, b in zip(s, d) if a != b][:2]
            msg = f"values differ e.g. {diff}"
    return ok, t1 - t0, len(srows), msg


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    prefixes = argv[2:]
    sys.path.insert(0, ".")
    from tabloom.session import get_session, checkpoint_dir
    import __spark_entry__ as E
    spark = get_session("local[8]", 8)
    checkpoint_dir(spark)
    con = duck(sf_dir)
    qs, os_ = E.queries(), E.oracle_sql()
    bad = 0
    for name in sorted(qs):
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        if name not in os_:
            t0 = time.time()
            n = qs[name](spark, sf_dir).count()
            print(f"ROWS  {name:40s} {time.time()-t0:6.2f}s rows={n}", flush=True)
            continue
        try:
            ok, sec, n, msg = compare(spark, con, name, qs[name], os_[name], sf_dir)
        except Exception as e:  # noqa: BLE001
            ok, sec, n, msg = False, 0.0, 0, f"ERROR {type(e).__name__}: {str(e)[:400]}"
        bad += not ok
        print(f"{'OK ' if ok else 'BAD'}   {name:40s} {sec:6.2f}s rows={n} {msg}", flush=True)
    print(f"mismatches: {bad}")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
