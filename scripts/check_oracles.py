"""Run registered queries on Spark and their SQL oracles on DuckDB; compare.

usage: python scripts/check_oracles.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from touchline.plans import registry  # noqa: E402
from touchline.session import get_session  # noqa: E402
from touchline.sources.tables import TABLES  # noqa: E402


def norm(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        if math.isnan(v):
            return "∅"
        return repr(round(v, 6) + 0.0)
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    if isinstance(v, (bool,)):
        return str(v)
    if hasattr(v, "__int__") and not isinstance(v, str):
        try:
            f = float(v)
            return repr(int(v)) if f == int(f) else repr(round(f, 6) + 0.0)
        except Exception:
            pass
    return str(v)


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(norm(r[i]) for i in order) for r in rows)
    return hashlib.md5("\n".join(lines).encode()).hexdigest(), lines


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = sys.argv[2:]
    registry.load_all()
    spark = get_session("local[8]", 8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    ok = bad = 0
    for name, fn in registry.QUERIES.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf)
            scols = df.columns
            srows = [tuple(r) for r in df.collect()]
        except Exception as e:
            print(f"FAIL-SPARK {name}: {str(e).splitlines()[0][:300]}")
            traceback.print_exc(limit=3)
            bad += 1
            continue
        ts = time.time() - t0
        sql = registry.ORACLES.get(name)
        if sql is None:
            print(f"ROWS  {name}: {len(srows)} rows ({ts:.1f}s) cols={scols}")
            ok += 1
            continue
        try:
            res = con.execute(sql)
            dcols = [d[0] for d in res.description]
            drows = res.fetchall()
        except Exception as e:
            print(f"FAIL-SQL {name}: {str(e).splitlines()[0][:300]}")
            bad += 1
            continue
        hs, ls = digest(scols, srows)
        hd, ld = digest(dcols, drows)
        same_cols = sorted(scols) == sorted(dcols)
        if hs == hd and same_cols and len(srows) == len(drows):
            print(f"OK    {name}: {len(srows)} rows ({ts:.1f}s)")
            ok += 1
        else:
            bad += 1
            print(f"DIFF  {name}: spark {len(srows)} rows {sorted(scols)} | duck {len(drows)} rows {sorted(dcols)}")
            a, b = set(ls), set(ld)
            for x in sorted(a - b)[:3]:
                print("   spark-only:", x[:200])
            for x in sorted(b - a)[:3]:
                print("   duck-only: ", x[:200])
    print(f"== ok {ok}  bad {bad}")


if __name__ == "__main__":
    main()
