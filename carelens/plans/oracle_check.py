"""Run registered queries in Spark and their DuckDB oracles, compare results.

    python -m carelens.plans.oracle_check [sf_dir] [key ...]

Compares row count, column names and the multiset of rows (columns sorted by
name, doubles rounded to 6 places).
"""

from __future__ import annotations

import math
import sys
import time
from datetime import date, datetime

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duckdb_connection(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        r = round(v, 6)
        return 0.0 if r == 0 else r
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, date):
        return v.isoformat()
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


def compare(spark, sf_dir: str, keys=None, verbose=True):
    from carelens.plans import all_queries, all_oracles
    qs, os_ = all_queries(), all_oracles()
    con = duckdb_connection(sf_dir)
    results = {}
    for key in (keys or list(qs)):
        t0 = time.time()
        df = qs[key](spark, sf_dir)
        s_cols = df.columns
        s_rows = [tuple(r) for r in df.collect()]
        t_spark = time.time() - t0
        if key not in os_:
            results[key] = {"rows": len(s_rows), "oracle": None, "spark_s": round(t_spark, 2)}
            if verbose:
                print(f"{key:28s} rows={len(s_rows):7d} (no oracle) {t_spark:.1f}s", flush=True)
            continue
        t1 = time.time()
        cur = con.execute(os_[key])
        d_cols = [d[0] for d in cur.description]
        d_rows = cur.fetchall()
        t_duck = time.time() - t1
        ok_cols = sorted(s_cols) == sorted(d_cols)
        ok_n = len(s_rows) == len(d_rows)
        ok_v = ok_cols and ok_n and _rows(s_cols, s_rows) == _rows(d_cols, d_rows)
        results[key] = {"rows": len(s_rows), "oracle_rows": len(d_rows), "cols": ok_cols, "values": ok_v,
                        "spark_s": round(t_spark, 2), "duck_s": round(t_duck, 2)}
        if verbose:
            status = "OK " if ok_v else "BAD"
            print(f"{status} {key:28s} rows={len(s_rows):7d}/{len(d_rows):7d} cols={ok_cols} "
                  f"spark={t_spark:.1f}s duck={t_duck:.1f}s", flush=True)
            if not ok_cols:
                print("   spark:", sorted(s_cols), "\n   duck: ", sorted(d_cols))
            elif not ok_v:
                a, b = _rows(s_cols, s_rows), _rows(d_cols, d_rows)
                diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
                print("   cols:", sorted(s_cols))
                for x, y in diff:
                    print("   spark:", x, "\n   duck: ", y)
    return results


def main(argv):
    from carelens.session import get_spark
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    keys = argv[2:] or None
    spark = get_spark("local[8]", shuffle_partitions=8)
    res = compare(spark, sf_dir, keys)
    bad = [k for k, v in res.items() if "values" in v and not v["values"]]
    print(f"{len(res)} queries, {sum(1 for v in res.values() if v.get('values'))} oracle matches, bad={bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
