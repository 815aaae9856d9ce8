"""Run queries() against oracle_sql() on one scale factor and report per-query matches.

Usage: python tests/oracle_check.py [sf_dir] [query ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from quayside.session import get_spark  # noqa: E402
from quayside.sources.tables import DRIVER_TABLES  # noqa: E402


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v)   # exact: both sides must produce the same double
    if isinstance(v, decimal.Decimal):
        return format(v.normalize(), "f")   # scale is checked by the type comparison
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (dt.date,)):
        return v.isoformat()
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return str(v)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    return str(v)


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple("" if x is None else x for x in t))


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


_SPARK_TO_DUCK = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "smallint": "SMALLINT",
                  "double": "DOUBLE", "float": "FLOAT", "boolean": "BOOLEAN", "date": "DATE",
                  "timestamp_ntz": "TIMESTAMP", "binary": "BLOB"}


def type_mismatches(df, con, sql: str) -> list:
    """Columns whose Spark type differs from the DuckDB statement's type."""
    duck_types = {d[0]: str(d[1]) for d in con.execute(f"SELECT * FROM ({sql}) LIMIT 0").description}
    out = []
    for f in df.schema.fields:
        s = f.dataType.simpleString()
        want = s.upper() if s.startswith("decimal") else _SPARK_TO_DUCK.get(s, s.upper())
        if duck_types.get(f.name) != want:
            out.append((f.name, s, duck_types.get(f.name)))
    return out


def check(spark, con, name: str, sf_dir: str) -> dict:
    q = entry.queries()[name]
    sql = entry.oracle_sql().get(name)
    t0 = time.time()
    df = q(spark, sf_dir)
    srows = [tuple(r) for r in df.collect()]
    scols = df.columns
    secs = time.time() - t0
    res = {"query": name, "spark_rows": len(srows), "secs": round(secs, 2)}
    if sql is None:
        res["status"] = "no-oracle"
        return res
    cur = con.execute(sql)
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    res["oracle_rows"] = len(drows)
    if sorted(scols) != sorted(dcols):
        res["status"] = f"COLUMNS spark={sorted(scols)} oracle={sorted(dcols)}"
        return res
    tm = type_mismatches(df, con, sql)
    if tm:
        res["status"] = f"TYPES {tm}"
        return res
    a, b = _rows(scols, srows), _rows(dcols, drows)
    if a == b:
        res["status"] = "ok"
    else:
        diff_a = [r for r in a if r not in set(b)][:3]
        diff_b = [r for r in b if r not in set(a)][:3]
        res["status"] = f"VALUES spark-only={diff_a} oracle-only={diff_b}"
    return res


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:] or list(entry.queries())
    spark = get_spark("local[8]", shuffle_partitions=8)
    con = duck(sf_dir)
    bad = 0
    for n in names:
        try:
            r = check(spark, con, n, sf_dir)
        except Exception as e:  # report and continue with the next query
            r = {"query": n, "status": f"ERROR {type(e).__name__}: {str(e)[:400]}"}
        if r["status"] not in ("ok", "no-oracle"):
            bad += 1
        print(r, flush=True)
    print(f"mismatches: {bad} of {len(names)}")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
