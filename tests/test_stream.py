"""Stream = batch for L1 in two session time zones; L2 replay is idempotent."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from barwise.sources import files as Fi
from barwise.sources import fixtures as X
from barwise.sources.tables import table
from barwise.streaming import stream as St
from conftest import SF_SMALL

BARS = ["Ticker", "Date", "Open", "High", "Low", "Close", "adj_close", "Volume"]


@pytest.mark.parametrize("tz", ["UTC", "America/Los_Angeles"])
def test_stream_bars_equal_batch(spark, tz):
    prev = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", tz)
    try:
        root = Fi.scratch_path(spark, "t_stream")
        src = os.path.join(SF_SMALL, "events.parque[t]")
        got = St.run_stream_bars(spark, src, table(spark, SF_SMALL, "events").schema,
                                 f"{root}/out", f"{root}/ckpt").select(*BARS)
        want = X.tick_bars(spark, SF_SMALL).select(*BARS)
        assert sorted(got.collect()) == sorted(want.collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", prev)


def test_refresh_replay_is_idempotent(spark):
    bars = X.region_bars(spark, SF_SMALL).select(*BARS).cache()
    root = Fi.scratch_path(spark, "t_refresh")
    cut = bars.selectExpr("percentile_approx(Date, 0.5, 10000) AS c").first()["c"]
    first = bars.filter(F.col("Date") < F.lit(cut))
    second = bars.filter(F.col("Date") >= F.lit(cut))
    sink = St.refresh_panel(f"{root}/panel")
    sink(first, 0)
    sink(second, 1)
    once = sorted(St.read_refreshed(spark, f"{root}/panel").collect())
    sink(second, 1)  # replay of batch 1
    again = sorted(St.read_refreshed(spark, f"{root}/panel").collect())
    assert once == again and len(once) == bars.count()


def test_refresh_with_late_corrected_and_missing_bars(spark):
    from barwise.functions.windows import indicators
    days = [dt.date(2024, 1, 1) + dt.timedelta(i) for i in range(300)]
    good = [("K", d, 1.0, 1.0, 1.0, None if i % 37 == 5 else 100.0 + (i * 7) % 13, 1.0, 1.0) for i, d in enumerate(days)]
    wrong = [("K", *good[40][1:5], 55.0, 1.0, 1.0)]
    drops = [[r for i, r in enumerate(good[:200]) if i not in (20, 40, 199)] + wrong + [(None, *good[0][1:])],
             [good[20], good[40]], good[200:250], [good[199]] + good[250:]]
    schema = "Ticker string, Date date, Open double, High double, Low double, Close double, adj_close double, Volume double"
    path = Fi.scratch_path(spark, "t_late") + "/panel"
    for n, rows in enumerate(drops):
        St.refresh_panel(path)(spark.createDataFrame(rows, schema), n)
    got = {r.Date: r for r in St.read_refreshed(spark, path).collect()}
    want = indicators(spark.createDataFrame(good, schema)).collect()
    assert len(got) == len(want) == 300
    for r in want:
        for c in St.IND_COLS:
            assert got[r.Date][c] == pytest.approx(r[c]) if r[c] is not None else got[r.Date][c] is None, (r.Date, c)
