"""Compare a registered query with its DuckDB oracle SQL (local verification).

Usage: python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as _dt
import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from demandlens.sources.tables import TABLES  # noqa: E402

_TYPE_MAP = {
    "bigint": "BIGINT", "int": "INTEGER", "smallint": "SMALLINT", "double": "DOUBLE",
    "float": "FLOAT", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP",
    "timestamp": "TIMESTAMP WITH TIME ZONE", "date": "DATE",
}


def duck_connect(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v, digits):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        if math.isinf(v):
            return str(v)
        return repr(round(v, digits)) if digits is not None else repr(v)
    if isinstance(v, (_dt.datetime, _dt.date)):
        return v.isoformat()
    if hasattr(v, "item"):
        return _norm(v.item(), digits)
    return repr(v)


def _digest(rows, digits):
    lines = sorted("|".join(str(_norm(v, digits)) for v in r) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines


def compare(spark, name: str, sf_dir: str, con=None, digits: int = 9) -> dict:
    from demandlens import plans
    q = plans.REGISTRY[name]
    t0 = time.time()
    sdf = q.build(spark, sf_dir)
    s_cols = sdf.columns
    s_types = {c: _TYPE_MAP.get(t, t.upper()) for c, t in sdf.dtypes}
    s_rows = [tuple(r[c] for c in sorted(s_cols)) for r in sdf.collect()]
    t_spark = time.time() - t0
    out = {"name": name, "spark_rows": len(s_rows), "spark_sec": round(t_spark, 2)}
    if q.sql is None:
        out["status"] = "no-oracle"
        return out
    con = con or duck_connect(sf_dir)
    cur = con.execute(q.sql)
    d_cols = [d[0] for d in cur.description]
    d_types = {d[0]: str(d[1]).upper() for d in cur.description}
    fetched = cur.fetchall()
    idx = {c: i for i, c in enumerate(d_cols)}
    d_rows = [tuple(r[idx[c]] for c in sorted(d_cols)) if set(d_cols) == set(s_cols) else r for r in fetched]
    out["oracle_rows"] = len(d_rows)
    out["columns_match"] = sorted(s_cols) == sorted(d_cols)
    out["types_match"] = out["columns_match"] and all(s_types[c] == d_types[c] for c in s_cols)
    if not out["types_match"] and out["columns_match"]:
        out["type_diff"] = {c: (s_types[c], d_types[c]) for c in s_cols if s_types[c] != d_types[c]}
    if not out["columns_match"]:
        out["col_diff"] = (sorted(set(s_cols) - set(d_cols)), sorted(set(d_cols) - set(s_cols)))
    exact_s, _ = _digest(s_rows, None)
    exact_d, _ = _digest(d_rows, None)
    tol_s, ls = _digest(s_rows, digits)
    tol_d, ld = _digest(d_rows, digits)
    out["exact_hash_match"] = exact_s == exact_d
    out["rounded_hash_match"] = tol_s == tol_d
    if not out["rounded_hash_match"]:
        only_s = sorted(set(ls) - set(ld))[:3]
        only_d = sorted(set(ld) - set(ls))[:3]
        out["sample_diff"] = {"spark": only_s, "oracle": only_d}
    ok = (out["columns_match"] and out["types_match"] and len(s_rows) == len(d_rows)
          and out["rounded_hash_match"])
    out["status"] = "match" if ok else "MISMATCH"
    return out


def main(argv):
    from demandlens import plans
    from demandlens.session import build_session
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(plans.REGISTRY)
    spark = build_session()
    con = duck_connect(sf_dir)
    bad = 0
    for n in names:
        try:
            r = compare(spark, n, sf_dir, con)
        except Exception as e:  # report and continue
            r = {"name": n, "status": "ERROR", "error": f"{type(e).__name__}: {str(e)[:400]}"}
        bad += r["status"] not in ("match", "no-oracle")
        print(r, flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
