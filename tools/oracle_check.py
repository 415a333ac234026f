"""Run registered Spark queries and their DuckDB twins side by side.

usage: python tools/oracle_check.py [sf_dir] [name-prefix ...]
Prints one line per query: ok / MISMATCH / ERROR, with row counts and time.
"""

from __future__ import annotations

import collections
import datetime
import decimal
import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from mlqa.sources.fixtures import TABLES  # noqa: E402


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return None
        r = round(v, 6)
        return 0.0 if r == 0 else r
    if isinstance(v, int):
        return v
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [tuple(norm(r[i]) for i in order) for r in rows], [cols[i] for i in order]


def spark_kind(dt) -> str:
    n = type(dt).__name__
    if n in ("IntegerType", "ShortType", "ByteType"):
        return "int32"
    if n == "LongType":
        return "int64"
    if n in ("DoubleType", "FloatType"):
        return "float"
    if n == "DecimalType":
        return "decimal"
    if n == "StringType":
        return "str"
    if n == "BooleanType":
        return "bool"
    if n in ("TimestampType", "TimestampNTZType", "DateType"):
        return "time"
    return n


def duck_kind(t: str) -> str:
    t = str(t).upper()
    if t in ("INTEGER", "SMALLINT", "TINYINT"):
        return "int32"
    if t in ("BIGINT", "UINTEGER"):
        return "int64"
    if t in ("HUGEINT", "UBIGINT"):
        return "int128"
    if t in ("DOUBLE", "FLOAT", "REAL"):
        return "float"
    if t.startswith("DECIMAL"):
        return "decimal"
    if t == "VARCHAR":
        return "str"
    if t == "BOOLEAN":
        return "bool"
    if t.startswith("TIMESTAMP") or t == "DATE":
        return "time"
    return t


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    df = fn(spark, sf_dir)
    srows = [tuple(r) for r in df.collect()]
    scols = df.columns
    t1 = time.time()
    if sql is None:
        return "rows-only", len(srows), None, t1 - t0, ""
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    s, sc = canon(scols, srows)
    d, dc = canon(dcols, drows)
    if sc != dc:
        return "MISMATCH", len(srows), len(drows), t1 - t0, f"columns {sc} vs {dc}"
    sk = {f.name: spark_kind(f.dataType) for f in df.schema.fields}
    dk = {c: duck_kind(t) for c, t in zip(dcols, res.description and [d[1] for d in res.description])}
    bad_types = {c: (sk[c], dk[c]) for c in sk if sk[c] != dk.get(c)}
    if bad_types:
        return "MISMATCH", len(srows), len(drows), t1 - t0, f"types {bad_types}"
    cs, cd = collections.Counter(map(repr, s)), collections.Counter(map(repr, d))
    if cs != cd:
        only_s = list((cs - cd).elements())[:3]
        only_d = list((cd - cs).elements())[:3]
        return "MISMATCH", len(srows), len(drows), t1 - t0, f"spark-only {only_s} duck-only {only_d}"
    return "ok", len(srows), len(drows), t1 - t0, ""


def main():
    args = sys.argv[1:]
    sf_dir = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    prefixes = [a for a in args if not a.startswith("/")]
    from mlqa.catalog import REGISTRY
    from mlqa.session import get_spark
    spark = get_spark("local[8]", shuffle_partitions=8)
    con = duck(sf_dir)
    bad = 0
    for name, (fn, sql) in REGISTRY.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        try:
            status, ns, nd, secs, msg = compare(spark, con, name, fn, sql, sf_dir)
        except Exception as e:  # noqa: BLE001
            status, ns, nd, secs, msg = "ERROR", None, None, 0.0, repr(e)[:600]
            traceback.print_exc(limit=3)
        bad += status in ("MISMATCH", "ERROR")
        print(f"{status:9s} {name:34s} spark={ns} duck={nd} {secs:6.2f}s {msg[:900]}", flush=True)
    print(f"done: {bad} bad")


if __name__ == "__main__":
    main()
