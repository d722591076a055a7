"""Manual runner: compare every registered query with its oracle at one scale.

    python tests/check_oracle.py /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracle_harness import compare, duck  # noqa: E402

import __spark_entry__ as E  # noqa: E402
from jobsight.session import build_session  # noqa: E402


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = set(sys.argv[2:])
    spark = build_session("local[8]", 8)
    con = duck(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if only and name not in only:
            continue
        t = time.time()
        if name not in sqls:
            n = fn(spark, sf_dir).count()
            print(f"{name:32s} rows-only n={n} {time.time()-t:.1f}s")
            continue
        try:
            probs = compare(spark, con, name, fn, sqls[name], sf_dir)
        except Exception as ex:  # report and go on
            probs = [f"error {type(ex).__name__}: {str(ex)[:400]}"]
        bad += bool(probs)
        print(f"{name:32s} {'OK' if not probs else 'FAIL'} {time.time()-t:.1f}s {'; '.join(probs)[:900]}")
    print("failures:", bad)


if __name__ == "__main__":
    main()
