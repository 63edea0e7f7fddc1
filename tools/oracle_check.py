"""Run registered queries on Spark and their SQL oracles on DuckDB and compare.

usage: python tools/oracle_check.py [sf_dir] [key-substring ...]
Prints one line per query: OK / MISMATCH / ERROR, plus a summary.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from regula.plans.registry import ORACLES, QUERIES, load_all  # noqa: E402
from regula.sources.parquet import DRIVER_TABLES  # noqa: E402


def norm(v, digits=6):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        r = round(v, digits)
        return 0.0 if r == 0 else r
    if isinstance(v, decimal.Decimal):
        return norm(float(v), digits)
    if hasattr(v, "item") and not isinstance(v, (list, tuple)):
        try:
            return norm(v.item(), digits)
        except Exception:
            pass
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x, digits) for x in v)
    if hasattr(v, "tolist"):
        return tuple(norm(x, digits) for x in v.tolist())
    return v


def rows_of(cols, records, digits):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i], digits) for i in order) for r in records]
    return sorted(out, key=repr)


SPARK_T = {"IntegerType": "int32", "LongType": "int64", "DoubleType": "float64", "FloatType": "float32",
           "StringType": "str", "DateType": "date", "TimestampType": "ts", "TimestampNTZType": "ts",
           "BooleanType": "bool", "ShortType": "int16", "ByteType": "int8"}
DUCK_T = {"INTEGER": "int32", "BIGINT": "int64", "DOUBLE": "float64", "FLOAT": "float32", "VARCHAR": "str",
          "DATE": "date", "TIMESTAMP": "ts", "BOOLEAN": "bool", "SMALLINT": "int16", "TINYINT": "int8"}


def type_diff(sdf, cur):
    st = {f.name: SPARK_T.get(type(f.dataType).__name__, type(f.dataType).__name__) for f in sdf.schema.fields}
    dt_ = {d[0]: DUCK_T.get(str(d[1]), str(d[1])) for d in cur.description}
    return {k: (st[k], dt_.get(k)) for k in st if st[k] != dt_.get(k)}


def duck(sf_dir):
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def main():
    args = sys.argv[1:]
    sf_dir = "/root/testdata/sf0.01"
    if args and args[0].startswith("/"):
        sf_dir, args = args[0], args[1:]
    from regula.session import get_session
    spark = get_session("local[8]")
    load_all()
    con = duck(sf_dir)
    keys = [k for k in QUERIES if not args or any(a in k for a in args)]
    bad = 0
    for k in keys:
        t0 = time.time()
        try:
            sdf = QUERIES[k](spark, sf_dir)
            scols = sdf.columns
            srows = [tuple(r) for r in sdf.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"ERROR    {k}: spark: {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if k not in ORACLES:
            print(f"ROWS     {k}: {len(srows)} rows, no oracle ({ts:.1f}s)")
            continue
        try:
            cur = con.execute(ORACLES[k])
            dcols = [d[0] for d in cur.description]
            drows = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"ERROR    {k}: duckdb: {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        if sorted(scols) != sorted(dcols):
            print(f"MISMATCH {k}: columns spark={sorted(scols)} duck={sorted(dcols)}")
            bad += 1
            continue
        td = type_diff(sdf, cur)
        if td:
            print(f"TYPES    {k}: {td}")
        a = rows_of(scols, srows, 6)
        b = rows_of(dcols, drows, 6)
        if a == b:
            print(f"OK       {k}: {len(a)} rows ({ts:.1f}s)")
        else:
            a4 = rows_of(scols, srows, 3)
            b4 = rows_of(dcols, drows, 3)
            tag = "CLOSE   " if a4 == b4 else "MISMATCH"
            bad += tag != "CLOSE   "
            print(f"{tag} {k}: spark {len(a)} rows vs duck {len(b)} rows")
            diff_a = [r for r in a if r not in set(b)][:3]
            diff_b = [r for r in b if r not in set(a)][:3]
            print("   cols:", sorted(scols))
            print("   spark-only:", diff_a)
            print("   duck-only: ", diff_b)
    print(f"SUMMARY {len(keys)} queries, {bad} bad")


if __name__ == "__main__":
    main()
