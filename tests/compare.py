"""Run registered queries in Spark and their oracles in DuckDB, and compare.

    python -m tests.compare [sf] [regex]
"""

from __future__ import annotations

import math
import re
import sys
import time

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(_plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(_plain(x) for x in v.values())
    if hasattr(v, "tolist"):
        return _plain(v.tolist())
    return v


def _key(row):
    return tuple(
        (x is not None, type(x).__name__ if not isinstance(x, (int, float)) else "n",
         round(x, 4) if isinstance(x, float) else (x if not isinstance(x, tuple) else str(x)))
        for x in row
    )


def diff(spark_df, con, sql: str) -> str:
    """Empty text when names, rows and values agree; else the first difference."""
    cols = sorted(spark_df.columns)
    got = [tuple(_plain(r[c]) for c in cols) for r in spark_df.select(*[f"`{c}`" for c in cols]).collect()]
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    if sorted(names) != cols:
        return f"columns {cols} vs {sorted(names)}"
    idx = [names.index(c) for c in cols]
    want = [tuple(_plain(r[i]) for i in idx) for r in rel.fetchall()]
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    try:
        got.sort(key=_key)
        want.sort(key=_key)
    except TypeError:
        got.sort(key=str)
        want.sort(key=str)
    for g, w in zip(got, want):
        for c, a, b in zip(cols, g, w):
            if a == b:
                if isinstance(a, float) and isinstance(b, float) and math.copysign(1, a) != math.copysign(1, b):
                    return f"{c}: negative zero {a!r} vs {b!r}"
                if type(a) is not type(b):
                    return f"{c}: type {type(a)} vs {type(b)}"
                continue
            if isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 1e-9 * max(1, abs(a)):
                continue
            return f"{c}: {a!r} vs {b!r} in {g} vs {w}"
    return ""


def main(argv):
    sf = argv[1] if len(argv) > 1 else "0.001"
    pattern = re.compile(argv[2] if len(argv) > 2 else ".")
    sf_dir = f"/root/testdata/sf{sf}"
    from swapledger.plans import all_oracles, all_queries
    from swapledger.session import local_session

    spark = local_session("compare", partitions=4)
    con = duck(sf_dir)
    oracles = all_oracles()
    bad = 0
    for name, fn in all_queries().items():
        if not pattern.search(name):
            continue
        t = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in oracles:
                msg = diff(df, con, oracles[name])
                n = -1 if msg else df.count()
            else:
                n = df.count()
                msg = "" if n else "no rows"
        except Exception as e:  # noqa: BLE001
            msg, n = f"{type(e).__name__}: {str(e)[:700]}", -1
        bad += bool(msg)
        mark = "ok " if not msg else "BAD"
        print(f"{mark} {name} rows={n} {time.time() - t:.1f}s {'' if name in oracles else '(no oracle) '}{msg}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv)
