"""Side-by-side run of the catalogue against DuckDB. Usage: python tests/compare.py [sf] [query ...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb
from pyspark.sql import SparkSession

DATA = "/root/testdata"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def session() -> SparkSession:
    s = (SparkSession.builder.master("local[8]").appName("skylattice-tests").config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false").config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    return s


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/sf{sf}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return 0.0 if v == 0 else v
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in data]
    return [cols[i] for i in order], sorted(out, key=repr)


def differences(spark, con, q, sf: str, show: int = 3):
    """Empty list when both sides agree exactly (values are already rounded by the queries)."""
    df = q.plan(spark, f"{DATA}/sf{sf}")
    c1, r1 = rows(df.columns, [tuple(r) for r in df.collect()])
    if q.sql is None:
        return [], len(r1)
    cur = con.execute(q.sql)
    c2, r2 = rows([d[0] for d in cur.description], cur.fetchall())
    bad = []
    if c1 != c2:
        bad.append(f"columns {c1} vs {c2}")
    elif len(r1) != len(r2):
        bad.append(f"rows {len(r1)} vs {len(r2)}")
        s1, s2 = set(map(repr, r1)), set(map(repr, r2))
        bad += [f"  spark only {x}" for x in sorted(s1 - s2)[:show]] + [f"  sql only   {x}" for x in sorted(s2 - s1)[:show]]
    else:
        d = [(a, b) for a, b in zip(r1, r2) if repr(a) != repr(b)]
        if d:
            bad.append(f"{len(d)} of {len(r1)} rows differ {c1}")
            bad += [f"  {a}\n  {b}" for a, b in d[:show]]
    return bad, len(r1)


def main(argv):
    from skylattice.plans import CATALOGUE

    sf = argv[0] if argv else "0.01"
    names = argv[1:] or list(CATALOGUE)
    spark, con, failed = session(), connect(sf), []
    for n in names:
        t = time.time()
        try:
            bad, count = differences(spark, con, CATALOGUE[n], sf)
        except Exception as e:  # noqa: BLE001
            bad, count = [f"{type(e).__name__}: {str(e)[:1500]}"], -1
        tag = "FAIL" if bad else ("ok  " if CATALOGUE[n].sql else "rows")
        print(f"{tag} {n:32s} rows={count:7d} {time.time() - t:6.2f}s", flush=True)
        for b in bad:
            print("    ", b, flush=True)
        if bad:
            failed.append(n)
    print(f"{len(names) - len(failed)} of {len(names)} agree", failed)


if __name__ == "__main__":
    main(sys.argv[1:])
