"""Run registered Spark queries and their DuckDB oracle side by side.

Usage: python tests/oracle_compare.py [sf_dir] [name ...]
Column order is ignored (names must match); rows are compared as sorted
multisets with doubles rounded to six places.
"""
from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"create view {t} as select * from read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        if math.isnan(v):
            return (0, "")
        return (1, round(v, 6))
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, (list, tuple)):
        return (2, tuple(_norm(x) for x in v))
    return (1, v)


def rows_of(pdf):
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        out.append(tuple(_norm(None if (x is not None and not isinstance(x, (str, list, tuple))
                                        and hasattr(x, "__float__") and x != x) else
                               (list(x) if hasattr(x, "tolist") and not isinstance(x, str) else x))
                         for x in rec))
    return cols, sorted(out, key=repr)


def compare(spark, name: str, sf_dir: str, con=None, verbose=True):
    from __spark_entry__ import oracle_sql, queries
    q, sql = queries()[name], oracle_sql().get(name)
    t0 = time.time()
    spdf = q(spark, sf_dir).toPandas()
    t1 = time.time()
    if sql is None:
        return {"name": name, "rows": len(spdf), "oracle": None, "spark_s": round(t1 - t0, 2)}
    con = con or duck(sf_dir)
    ddf = con.execute(sql).df()
    t2 = time.time()
    sc, sr = rows_of(spdf)
    dc, dr = rows_of(ddf)
    ok = sc == dc and sr == dr
    res = {"name": name, "ok": ok, "spark_rows": len(sr), "duck_rows": len(dr),
           "spark_s": round(t1 - t0, 2), "duck_s": round(t2 - t1, 2)}
    if not ok and verbose:
        if sc != dc:
            res["cols"] = (sc, dc)
        else:
            a, b = set(sr), set(dr)
            res["only_spark"] = [r for r in sr if r not in b][:3]
            res["only_duck"] = [r for r in dr if r not in a][:3]
    return res


def main():
    from wordloom.session import build_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = build_session("local[8]", shuffle_partitions=8)
    from __spark_entry__ import queries
    names = names or sorted(queries())
    con = duck(sf)
    bad = 0
    for n in names:
        try:
            r = compare(spark, n, sf, con)
        except Exception as e:  # report and go on
            r = {"name": n, "error": repr(e)[:600]}
        if not r.get("ok", r.get("oracle", 1) is None):
            bad += 1
        print(r, flush=True)
    print(f"{len(names) - bad}/{len(names)} passed")


if __name__ == "__main__":
    main()
