"""Run registered queries in Spark and DuckDB side by side and report mismatches.

usage: python tools/check_oracle.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import sys
import time
import traceback

sys.path.insert(0, __import__("os").path.dirname(__import__("os").path.dirname(__file__)))

from ticketlens.plans.catalog import load_all  # noqa: E402
from ticketlens.plans.oracle import compare, duck  # noqa: E402
from ticketlens.session import local_session  # noqa: E402


def main() -> int:
    args = sys.argv[1:]
    sf_dir = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    prefixes = [a for a in args if not a.startswith("/")]
    spark = local_session(8)
    con = duck(sf_dir)
    bad = 0
    for name, q in load_all().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        t0 = time.time()
        try:
            sdf = q.build(spark, sf_dir).toPandas()
            ts = time.time() - t0
            if q.sql is None:
                print(f"ROWS  {name}: {len(sdf)} rows ({ts:.1f}s, no SQL)")
                continue
            ddf = con.execute(q.sql).fetchdf()
            probs = compare(sdf, ddf)
        except Exception as e:  # noqa: BLE001
            probs = [f"{type(e).__name__}: {str(e)[:800]}"]
            traceback.print_exc(limit=2)
            ts = time.time() - t0
        if probs:
            bad += 1
            print(f"FAIL  {name} ({ts:.1f}s): " + " | ".join(probs))
        else:
            print(f"OK    {name}: {len(sdf)} rows x {len(sdf.columns)} cols ({ts:.1f}s)")
    print(f"{bad} failing")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
