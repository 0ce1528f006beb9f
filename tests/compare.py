"""Run registered queries and compare them with their SQL equivalents."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    return str(v)


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())


def duck_rows(con, sql):
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(norm(r[i]) for i in order) for r in rel.fetchall())


def difference(a, b):
    """None when equal, otherwise a short description."""
    if a[0] != b[0]:
        return f"columns {a[0]} vs {b[0]}"
    if len(a[1]) != len(b[1]):
        return f"rows {len(a[1])} vs {len(b[1])}; first {a[1][:2]} vs {b[1][:2]}"
    bad = [(x, y) for x, y in zip(a[1], b[1], strict=True) if x != y]
    return f"{len(bad)} of {len(a[1])} rows differ, e.g. {str(bad[0])[:300]}" if bad else None


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    from bench import session

    import __spark_entry__ as entry

    sf_dir = sys.argv[1]
    only = sys.argv[2:]
    spark = session(8)
    con = connect(sf_dir)
    oracle = entry.oracle_sql()
    for name, fn in entry.queries().items():
        if only and not any(o in name for o in only):
            continue
        t = time.time()
        try:
            got = spark_rows(fn(spark, sf_dir))
            took = time.time() - t
            t = time.time()
            if name not in oracle:
                print(f"ROWS {name} {len(got[1])} {took:.1f}s", flush=True)
                continue
            diff = difference(got, duck_rows(con, oracle[name]))
            print(f"{'OK  ' if diff is None else 'DIFF'} {name} {len(got[1])} {took:.1f}s sql {time.time() - t:.1f}s {diff or ''}", flush=True)
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name} {type(e).__name__} {str(e)[:300]}", flush=True)
