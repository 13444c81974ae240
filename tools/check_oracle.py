"""Run registered Spark queries and their DuckDB SQL side by side.

usage: python tools/check_oracle.py [sf_dir] [name ...]
Prints one line per query: OK / MISMATCH / ERROR with row counts.
"""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

from tidemark.plans.registry import load_all  # noqa: E402
from tidemark.session import build_session  # noqa: E402
from tidemark.sources.testdata import TABLES  # noqa: E402


def _norm_val(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime().replace(tzinfo=None)
    if hasattr(v, "item"):
        return _norm_val(v.item())
    return v


def _rows(pdf: pd.DataFrame):
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False):
        out.append(tuple(_norm_val(x) for x in rec))
    out.sort(key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))
    return cols, out


def main():
    args = sys.argv[1:]
    sf = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in args if not a.startswith("/")]
    reg = load_all()
    spark = build_session()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    bad = 0
    for name, (fn, sql, _ops) in reg.items():
        if names and name not in names:
            continue
        t0 = time.time()
        try:
            sdf = fn(spark, sf)
            s_pdf = sdf.toPandas()
            ts = time.time() - t0
            if sql is None:
                print(f"NOSQL    {name:24s} rows={len(s_pdf)} {ts:.1f}s", flush=True)
                continue
            d_pdf = con.execute(sql).df()
            sc, sr = _rows(s_pdf)
            dc, dr = _rows(d_pdf)
            types_s = {c: str(t) for c, t in zip(sdf.columns, [f.dataType.simpleString() for f in sdf.schema])}
            if sc != dc:
                bad += 1
                print(f"COLS     {name:24s} spark={sc} duck={dc}", flush=True)
            elif sr != dr:
                bad += 1
                diff = [r for r in sr if r not in set(dr)][:3]
                diff2 = [r for r in dr if r not in set(sr)][:3]
                print(f"MISMATCH {name:24s} spark={len(sr)} duck={len(dr)}\n   spark-only {diff}\n   duck-only  {diff2}",
                      flush=True)
            else:
                dtypes = dict(zip(d_pdf.columns, map(str, d_pdf.dtypes)))
                sdt = dict(zip(s_pdf.columns, map(str, s_pdf.dtypes)))
                tmis = {c: (sdt[c], dtypes[c]) for c in sc if sdt[c] != dtypes[c] and len(sr)}
                print(f"OK       {name:24s} rows={len(sr)} {ts:.1f}s {'types:' + str(tmis) if tmis else ''}",
                      flush=True)
            del types_s
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"ERROR    {name:24s} {type(e).__name__}: {str(e)[:400]}", flush=True)
            if os.environ.get("TRACE"):
                traceback.print_exc()
    print(f"done, {bad} problems")


if __name__ == "__main__":
    main()
