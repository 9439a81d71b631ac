"""Run registered queries in Spark and their oracle SQL in DuckDB; print a report.

usage: python tools/oracle_report.py [sf_dir] [name ...]
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))
sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), "..", "tests"))

from oracle_check import compare, duck_connect  # noqa: E402

from barwise.plans import load_all  # noqa: E402
from barwise.session import build_session  # noqa: E402


def main():
    args = sys.argv[1:]
    sf = args[0] if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    names = [a for a in args if not os.path.isdir(a)]
    reg = load_all()
    spark = build_session("local[8]")
    con = duck_connect(sf)
    summary = {}
    for name, (fn, sql) in reg.items():
        if names and name not in names:
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf)
            if sql:
                res = compare(df, sql, con)
            else:
                res = {"ok": None, "rows": df.count(), "problems": []}
        except Exception as e:  # report and continue
            res = {"ok": False, "problems": [f"{type(e).__name__}: {str(e)[:600]}"]}
        res["sec"] = round(time.time() - t0, 2)
        summary[name] = res
        print(name, json.dumps(res, default=str)[:1500], flush=True)
    bad = [n for n, r in summary.items() if r["ok"] is False]
    print("FAILED:", bad)
    print("rows-only:", [n for n, r in summary.items() if r["ok"] is None])
    spark.stop()


if __name__ == "__main__":
    main()
