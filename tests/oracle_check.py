"""Run registered queries against their SQL in DuckDB: python tests/oracle_check.py [name-part ...]"""

from __future__ import annotations

import logging
import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else ("f", round(v, 6) + 0.0)
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, int):
        return ("i", v)
    return v


def compare(spark_df, con, sql: str) -> str:
    cols = sorted(spark_df.columns)
    got = Counter(tuple(norm(r[c]) for c in cols) for r in spark_df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return f"columns differ: spark {cols} sql {sorted(names)}"
    pos = [names.index(c) for c in cols]
    want = Counter(tuple(norm(r[i]) for i in pos) for r in cur.fetchall())
    if got == want:
        return f"ok {sum(got.values())} rows" if got else "ok EMPTY"
    a, b = list((got - want).items())[:3], list((want - got).items())[:3]
    return f"MISMATCH spark {sum(got.values())} sql {sum(want.values())}\n   cols {cols}\n   spark-only {a}\n   sql-only   {b}"


def main() -> int:
    from tests.session import session

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    from mediaframe.plans import REGISTRY

    spark = session()
    logging.disable(logging.CRITICAL)
    con = connect(sf)
    bad = 0
    for name, q in REGISTRY.items():
        if sys.argv[1:] and not any(p in name for p in sys.argv[1:]):
            continue
        t0 = time.time()
        try:
            if q.sql is None:
                res = f"rows-only {q.build(spark, sf).count()}"
            else:
                res = compare(q.build(spark, sf), con, q.sql)
        except Exception as e:  # noqa: BLE001
            res = f"ERROR {type(e).__name__}: {str(e)[:int(os.environ.get("ERR", "300"))]}"
        if not res.startswith(("ok", "rows-only")) or "EMPTY" in res:
            bad += 1
        print(f"{name:36s} {time.time()-t0:6.2f}s {res}", flush=True)
    print("problems:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
