"""Run registered queries against their DuckDB oracles (like the driver's check).

Usage: python tests/oracle_check.py [sf_dir] [name ...]
Compares row count, column names/types and an order-insensitive value hash.
"""

from __future__ import annotations

import hashlib
import json
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 9))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{_norm(v[k])}" for k in sorted(v)) + "}"
    if hasattr(v, "asDict"):
        return _norm(v.asDict(recursive=True))
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (bytes, bytearray)):
        return v.hex()
    return repr(v)


def table_hash(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def check(spark, sf_dir: str, names=None) -> dict:
    import __spark_entry__ as E
    qs, orc = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    out = {}
    for name in names or sorted(qs):
        t0 = time.time()
        rec = {}
        try:
            df = qs[name](spark, sf_dir)
            rows = [tuple(r) for r in df.collect()]
            cols = df.columns
            rec.update(rows=len(rows), spark_sec=round(time.time() - t0, 2))
            if name in orc:
                res = con.execute(orc[name])
                ocols = [d[0] for d in res.description]
                orows = res.fetchall()
                rec.update(oracle_rows=len(orows),
                           cols_match=sorted(cols) == sorted(ocols),
                           hash_match=table_hash(cols, rows) == table_hash(ocols, orows))
                if not rec["cols_match"]:
                    rec["cols"] = [cols, ocols]
                rec["ok"] = rec["cols_match"] and rec["hash_match"] and len(rows) == len(orows)
            else:
                rec["ok"] = None
        except Exception as e:  # noqa: BLE001
            rec.update(ok=False, error=f"{type(e).__name__}: {str(e)[:600]}")
        out[name] = rec
        print(name, json.dumps(rec), flush=True)
    return out


if __name__ == "__main__":
    from veilspark.session import build_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    spark = build_session(master=os.environ.get("ORACLE_MASTER"), shuffle_partitions=8)
    res = check(spark, sf, sys.argv[2:] or None)
    bad = [k for k, v in res.items() if v.get("ok") is False]
    print("FAILED:", bad)
