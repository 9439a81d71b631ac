"""Benchmark: headline queries on region bars (5 keys) and supplier bars.

Prints one JSON line: {"metric", "value" (sum of medians, sec), "unit",
"queries": {name: median sec}, "sf"}. Each query is materialised with the
``noop`` sink after one warm-up run; median of ``BENCH_REPS`` runs.
Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_REPS (default 3).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from barwise.functions import windows as Wn  # noqa: E402
from barwise.operators import metrics as Me  # noqa: E402
from barwise.operators import stats as St  # noqa: E402
from barwise.operators.bars import drop_incomplete, fill_gaps  # noqa: E402
from barwise.operators.correlation import correlation_pairs  # noqa: E402
from barwise.plans import load_all  # noqa: E402
from barwise.schema import OHLCV  # noqa: E402
from barwise.session import build_session  # noqa: E402
from barwise.sources import fixtures as X  # noqa: E402


def supplier_panel(spark, sf):
    return drop_incomplete(Wn.features(X.supplier_bars(spark, sf)))


def supplier_leaderboard(spark, sf):
    from barwise.operators import splits as Sp
    from barwise.operators.lsq import materialize_small
    panel = Wn.targets(supplier_panel(spark, sf), "adj_close").select("Ticker", "Date", "adj_close", "MA7", "Target_Next_Price")
    ml = Sp.split_time(materialize_small(panel), 0.8)
    test = ml.filter("split = 'test'")
    base = ["Ticker", "Date", F.col("Target_Next_Price").alias("actual")]
    coef = ml.filter("split = 'train'").groupBy("Ticker").agg(
        F.regr_slope("Target_Next_Price", "adj_close").alias("b"),
        F.regr_intercept("Target_Next_Price", "adj_close").alias("a"))
    p = Me.collect_backtests(
        test.select(F.lit("last_value").alias("model"), *base, F.col("adj_close").alias("predicted")),
        test.select(F.lit("ma7").alias("model"), *base, F.col("MA7").alias("predicted")),
        test.join(coef, "Ticker").select(F.lit("ar1").alias("model"), *base,
                                         (F.col("a") + F.col("b") * F.col("adj_close")).alias("predicted")))
    m = Me.regression_metrics(p, ("model", "Ticker")).join(
        Me.direction_accuracy(p, ("model", "Ticker")), ["model", "Ticker"])
    return Me.leaderboard(m)


def main():
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    reps = int(os.environ.get("BENCH_REPS", "3"))
    spark = build_session(f"local[{cpus}]", shuffle_partitions=max(8, 2 * int(cpus)))
    reg = load_all()
    qs = {
        "ohlcv_bars": lambda: reg["ohlcv_bars"][0](spark, sf),
        "features": lambda: reg["features"][0](spark, sf),
        "risk_stats": lambda: reg["risk_stats"][0](spark, sf),
        "kpis": lambda: reg["kpis"][0](spark, sf),
        "correlation": lambda: reg["correlation"][0](spark, sf),
        "leaderboard": lambda: reg["leaderboard"][0](spark, sf),
        "supplier_bars": lambda: X.supplier_bars(spark, sf),
        "supplier_features": lambda: supplier_panel(spark, sf),
        "supplier_risk_stats": lambda: St.risk_stats(supplier_panel(spark, sf)),
        "supplier_kpis": lambda: St.kpis(X.supplier_bars(spark, sf)),
        "supplier_correlation": lambda: correlation_pairs(supplier_panel(spark, sf), "Daily_Return"),
        "supplier_leaderboard": lambda: supplier_leaderboard(spark, sf),
        "supplier_fill_gaps": lambda: fill_gaps(X.supplier_bars(spark, sf).withColumns(
            {c: F.when(F.dayofmonth("Date") % 7 != 0, F.col(c)) for c in OHLCV})),
        "isolation": lambda: reg["isolation"][0](spark, sf),
        "incremental_refresh": lambda: reg["incremental_refresh"][0](spark, sf),
    }
    only = [a for a in sys.argv[1:]]
    times = {}
    for name, build in qs.items():
        if only and name not in only:
            continue
        build().write.format("noop").mode("overwrite").save()  # warm-up
        runs = []
        for _ in range(reps):
            t0 = time.perf_counter()
            build().write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(runs), 3)
        print(f"# {name}: {times[name]}s", file=sys.stderr, flush=True)
    sf_val = os.path.basename(sf.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "sum_of_query_medians", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf_val}))
    spark.stop()


if __name__ == "__main__":
    main()
