"""Zoned dates, bucketed tables and mergeable profiles."""

import datetime as dt

from conftest import SF_SMALL
from pyspark.sql import functions as F

from barwise.functions import windows as Wn
from barwise.operators import sketches as Sk
from barwise.plans.queries_features import bucketed_panel
from barwise.sources.files import to_bar_date


def test_wall_clock_date(spark):
    stamps = ["2024-03-01 23:30:00-05:00", "2024-03-01T23:30:00Z", "2024-03-01 00:10:00+14:00", "2024-03-01", " 2024-3-1 1:00 US/Eastern",
              "2024-03-01x", "20240301", "2024-13-01", "", None, "n/a"]
    df = spark.createDataFrame([(s,) for s in stamps], "s string")
    assert [r.d for r in df.select(to_bar_date("s").alias("d")).collect()] == [dt.date(2024, 3, 1)] * 5 + [None] * 6
    typed = spark.sql("SELECT timestamp_ntz'2024-03-01 23:59:59' AS a, date'2024-03-01' AS b")
    assert tuple(typed.select(to_bar_date("a"), to_bar_date("b")).first()) == (dt.date(2024, 3, 1),) * 2


def test_bucketed_windows_need_no_exchange(spark):
    had = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = Wn.features(bucketed_panel(spark, SF_SMALL, 4))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", had)
    assert "Window" in plan and "Exchange" not in plan


def test_merged_sketches(spark):
    df = spark.range(20_000).select((F.col("id") % 7).alias("p"), (F.col("id") % 5000).cast("double").alias("x"),
                                    F.lit(None).cast("double").alias("none"),
                                    F.when(F.col("id") % 2 == 0, F.lit(-0.0)).otherwise(F.lit(0.0)).alias("zero"))
    got = {r.column: r for r in Sk.profile_of(Sk.merge_sketches(Sk.sketch_drops(df, ["x", "none", "zero"], "p"))).collect()}
    x = got["x"]
    assert (x.n, x.nulls, x.min, x.max, x.mean) == (20_000, 0, 0.0, 4999.0, 2499.5)
    assert abs(x.n_distinct - 5000) <= 100 and abs(x.p50 - 2500) < 100 and abs(x.p25 - 1250) < 100
    assert (got["none"].nulls, got["none"].mean, got["none"].n_distinct, got["none"].p50) == (20_000, None, 0, None)
    assert got["zero"].n_distinct == 1
    one = {r.column: r.n_distinct for r in Sk.profile_of(Sk.sketch_drops(df, ["x"])).collect()}
    assert one["x"] == x.n_distinct
    assert Sk.profile_of(Sk.merge_sketches(Sk.sketch_drops(df.limit(0), ["x"], "p"))).count() == 0
