"""Run queries against their oracles from the command line: python tests/check.py [sf] [names...]"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import oracle  # noqa: E402

import __spark_entry__ as E  # noqa: E402
from wardline.session import build_session  # noqa: E402


def main():
    sf = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
    only = sys.argv[2:]
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sql = oracle.connect(sf), E.oracle_sql()
    bad = []
    for name, f in E.queries().items():
        if only and name not in only:
            continue
        t = time.time()
        try:
            if name in sql:
                diff, n = oracle.compare(f(spark, sf), con, sql[name])
            else:
                diff, n = None, len(f(spark, sf).collect())
        except Exception as e:  # noqa: BLE001
            diff, n = f"{type(e).__name__}: {str(e)[:600]}", -1
        print(f"{'ok ' if diff is None else 'BAD'} {name:32s} {n:8d} rows {time.time() - t:6.1f}s {'' if name in sql else '(no oracle)'} {diff or ''}", flush=True)
        if diff:
            bad.append(name)
    print("bad:", bad)


if __name__ == "__main__":
    main()
