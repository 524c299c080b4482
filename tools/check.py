"""Compare queries with their SQL: ``python tools/check.py [sf] [name ...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb  # noqa: E402

from pedalgrid.plans import ORACLES, QUERIES  # noqa: E402
from pedalgrid.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def show(v):
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    return repr(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(show(r[i]) for i in order) for r in rows)


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    folder = f"/root/testdata/sf{sf}"
    names = sys.argv[2:] or list(QUERIES)
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    bad = 0
    for name in names:
        start = time.time()
        try:
            df = QUERIES[name](spark, folder)
            got = [tuple(r) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: {str(e)[:1500]}")
            bad += 1
            continue
        took = time.time() - start
        if name not in ORACLES:
            print(f"rows {name}: {len(got)} {took:.1f}s")
            continue
        try:
            cur = con.execute(ORACLES[name])
            cols = [d[0] for d in cur.description]
            kinds = [str(d[1]) for d in cur.description]
            want = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"SQL  {name}: {str(e)[:600]}")
            bad += 1
            continue
        if sorted(cols) != sorted(df.columns):
            print(f"COLS {name}: {sorted(df.columns)} != {sorted(cols)}")
            bad += 1
            continue
        a, b = rows_of(df.columns, got), rows_of(cols, want)
        if a != b or not a:
            bad += 1
            print(f"DIFF {name}: {len(a)} rows vs {len(b)} ({took:.1f}s) {sorted(cols)}")
            for x, y in [(x, y) for x, y in zip(a, b) if x != y][:3]:
                print("   spark", x, "\n   sql  ", y)
        else:
            types = dict(zip(cols, kinds))
            print(f"ok   {name}: {len(a)} rows {took:.1f}s " + " ".join(f"{f.name}:{f.dataType.simpleString()}/{types[f.name]}" for f in df.schema if not same(f.dataType.simpleString(), types[f.name])))
    print("bad:", bad)
    return bad


def same(spark_type: str, duck: str) -> bool:
    known = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    return known.get(spark_type) == duck


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
