"""Run registered queries and their SQL side by side: python tools/compare.py [--sf DIR] [name or module part ...]."""

from __future__ import annotations

import argparse
import os
import sys
import time
import traceback

import duckdb
import pandas as pd

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))

from concord.plans import load_all  # noqa: E402
from concord.session import local_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    rows = []
    for row in df.itertuples(index=False):
        rows.append(tuple("" if v is None or v is pd.NaT or (isinstance(v, float) and v != v) else repr(float(v)) if isinstance(v, float) else str(v) for v in row))
    return sorted(rows)


def main() -> None:
    args = argparse.ArgumentParser()
    args.add_argument("--sf", default="/root/testdata/sf0.01")
    args.add_argument("names", nargs="*")
    opts = args.parse_args()
    queries, oracles = load_all()
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{opts.sf}/{t}.parquet'")
    bad = []
    for name, fn in queries.items():
        if opts.names and not any(n in name or n in fn.__module__ for n in opts.names):
            continue
        try:
            start = time.time()
            got_df = fn(spark, opts.sf)
            rows = got_df.collect()
            spent = time.time() - start
            got = pd.DataFrame([tuple(r) for r in rows], columns=got_df.columns, dtype=object)
            if name not in oracles:
                print(f"rows  {name:32s} {len(got):7d} rows {spent:6.1f}s", flush=True)
                continue
            start = time.time()
            res = con.execute(oracles[name])
            cols = [d[0] for d in res.description]
            types = [str(d[1]) for d in res.description]
            want = pd.DataFrame(res.fetchall(), columns=cols, dtype=object)
            dspent = time.time() - start
            problems = []
            if sorted(cols) != sorted(got.columns):
                problems.append(f"columns {sorted(got.columns)} vs {sorted(cols)}")
            if any("HUGEINT" in t or "DECIMAL" in t for t in types):
                problems.append(f"types {dict(zip(cols, types))}")
            if len(got) != len(want):
                problems.append(f"rows {len(got)} vs {len(want)}")
            if not problems:
                a, b = normal(got), normal(want)
                diff = [(x, y) for x, y in zip(a, b) if x != y]
                if diff:
                    problems.append(f"{len(diff)} rows differ, first {diff[0]}")
            print(f"{'FAIL' if problems else 'ok'}    {name:32s} {len(got):7d} rows {spent:6.1f}s sql {dspent:5.1f}s {problems or ''}", flush=True)
            if problems:
                bad.append(name)
        except Exception as error:  # report and go on
            bad.append(name)
            print(f"ERROR {name}: {type(error).__name__} {str(error)[:900]}", flush=True)
            traceback.print_exc(limit=-2)
    print("bad:", bad)


if __name__ == "__main__":
    main()
