"""Run catalog queries in Spark and DuckDB and compare them: python tools/check.py [--sf DIR] [prefix ...]"""

from __future__ import annotations

import argparse
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def duck(sf: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def norm(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(norm(v) for v in value) + "]"
    if hasattr(value, "asDict"):
        return norm(list(value))
    return repr(value)


FAMILY = {"bigint": "int", "double": "float", "varchar": "str", "string": "str", "boolean": "bool"}


def compare(df, con, text: str) -> str:
    cols = sorted(df.columns)
    rel = con.execute(text)
    names = [d[0] for d in rel.description]
    types = {d[0]: str(d[1]).lower() for d in rel.description}
    if sorted(names) != cols:
        return f"columns differ: spark {cols} sql {sorted(names)}"
    bad = [
        f"{n}:{s}/{types[n]}" for n, s in df.dtypes if FAMILY.get(s, s) != FAMILY.get(types[n], types[n]) and "[" not in types[n]
    ]
    expect = rel.fetchall()
    order = [names.index(c) for c in cols]
    want = sorted(tuple(norm(r[i]) for i in order) for r in expect)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.select(*cols).collect())
    if bad:
        return "types differ: " + ", ".join(bad)
    if len(want) != len(got):
        extra = set(got) - set(want)
        miss = set(want) - set(got)
        return f"rows differ: spark {len(got)} sql {len(want)} {cols} +{list(extra)[:2]} -{list(miss)[:2]}"
    diff = [(g, w) for g, w in zip(got, want) if g != w]
    if diff:
        return f"{len(diff)} of {len(got)} rows differ, {cols}: " + "; ".join(f"{g} <> {w}" for g, w in diff[:3])
    return f"ok {len(got)} rows"


def main() -> int:
    from swathline.catalog import load
    from swathline.session import local_session

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    cat = load()
    spark = local_session(8)
    con = duck(args.sf)
    failed = 0
    for name, fn in cat.queries.items():
        if args.names and not any(name == n or name.startswith(n + "_") or (len(n) == 1 and name.startswith(n)) for n in args.names):
            continue
        start = time.time()
        try:
            df = fn(spark, args.sf)
            text = cat.oracles.get(name)
            result = compare(df, con, text) if text else f"ok (no SQL) {len(df.collect())} rows"
        except Exception as exc:  # report and go on with the next query
            result = f"ERROR {type(exc).__name__}: {str(exc)[:1200]}"
        failed += not result.startswith("ok")
        print(f"{name:40s} {time.time() - start:6.2f}s  {result[:1800]}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main() > 0)
