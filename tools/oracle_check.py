"""Run registered Spark queries and their DuckDB oracles side by side.

    python tools/oracle_check.py [--sf /root/testdata/sf0.01] [name ...]

Compares row count, column names and the order-insensitive multiset of rows
(doubles rounded to 6 places). Prints one line per query and a JSON summary.
"""

from __future__ import annotations

import argparse
import json
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from ferret.sources.tables import TABLES, table_path  # noqa: E402


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(sf_dir, t)}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6) + 0.0
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if hasattr(v, "isoformat"):
        return str(v)
    try:
        import decimal
        if isinstance(v, decimal.Decimal):
            return round(float(v), 6)
    except Exception:
        pass
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def compare(spark, con, q, sf_dir):
    t0 = time.time()
    sdf = q.build(spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    scols = list(sdf.columns)
    t1 = time.time()
    res = {"name": q.name, "spark_rows": len(srows), "spark_s": round(t1 - t0, 2)}
    if q.sql is None:
        res["status"] = "rows-only"
        return res
    rel = con.sql(q.sql)
    dcols = list(rel.columns)
    drows = rel.fetchall()
    res["duck_rows"] = len(drows)
    if sorted(scols) != sorted(dcols):
        res["status"] = "COLUMNS"
        res["detail"] = f"spark={sorted(scols)} duck={sorted(dcols)}"
        return res
    a, b = rows_of(scols, srows), rows_of(dcols, drows)
    if a == b:
        res["status"] = "ok"
    else:
        res["status"] = "VALUES" if len(a) == len(b) else "ROWCOUNT"
        diff_a = [x for x in a if x not in set(b)][:3]
        diff_b = [x for x in b if x not in set(a)][:3]
        res["detail"] = f"cols={sorted(scols)} spark_only={diff_a} duck_only={diff_b}"
    return res


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    from ferret.plans.catalog import load_all
    from ferret.session import get_spark

    reg = load_all()
    names = a.names or list(reg)
    spark = get_spark("local[8]", shuffle_partitions=8)
    con = duck(a.sf)
    results = []
    for n in names:
        try:
            r = compare(spark, con, reg[n], a.sf)
        except Exception as e:  # report and go on
            r = {"name": n, "status": "ERROR", "detail": f"{type(e).__name__}: {str(e)[:400]}"}
        results.append(r)
        print(json.dumps(r), flush=True)
    bad = [r["name"] for r in results if r["status"] not in ("ok", "rows-only")]
    print(json.dumps({"total": len(results), "ok": sum(r["status"] == "ok" for r in results),
                      "rows_only": sum(r["status"] == "rows-only" for r in results), "bad": bad}))


if __name__ == "__main__":
    main()
