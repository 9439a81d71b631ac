"""Registered queries: streaming (L1, L2) and file round trips.

Stream = batch: each streaming query has the SQL twin of its batch result.
Scratch output goes under the shared checkpoint folder.
"""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from barwise.functions.exprs import quantize
from barwise.operators.bars import prefer_source
from barwise.plans import sql_features as S
from barwise.plans.queries_features import PANEL_CTES, panel
from barwise.plans.registry import q_sql, register, with_ctes
from barwise.schema import BAR_SCHEMA
from barwise.sources import files as Fi
from barwise.sources import fixtures as X
from barwise.sources import vendor as Ve
from barwise.sources.tables import table
from barwise.streaming import stateful as Sf
from barwise.streaming import stream as St

BAR_COLS = "Ticker, Date, Open, High, Low, Close, adj_close, Volume"


@register("stream_bars", with_ctes(X.TICK_BARS_SQL, f"SELECT {BAR_COLS} FROM tbars"))
def q_stream_bars(spark, sf):
    # the driver table is one file: a glob makes the file source list it
    src = os.path.join(sf, "events.parque[t]")
    schema = table(spark, sf, "events").schema
    root = Fi.scratch_path(spark, "stream_bars")
    return St.run_stream_bars(spark, src, schema, f"{root}/out", f"{root}/ckpt")


_IND_Q = ["SMA_50", "SMA_200", "Volatility_30d", "Cumulative_Return"]


_REFRESH_SQL = with_ctes(X.REGION_BARS_SQL + ["""rb AS (
  SELECT Ticker, Date, Open, High, Low, CASE WHEN day(Date) % 11 <> 0 THEN Close END AS Close, adj_close, Volume
  FROM bars)"""] + S.indicators_ctes("rb"), "SELECT "
          + ", ".join(S.BASE + ["Return"] + [q_sql(c) + f" AS {c}" for c in _IND_Q]) + " FROM ind")


def _refreshed_in_drops(spark, sf, run):
    """Bars arrive in three drops, ``run`` is called after each: (1) dates before
    the 60 % date without every ninth day of a month and with wrong closes on the
    fifteenth; (2) the rest up to the 80 % date and the corrections; (3) the late
    days and everything after. Closes are missing on every eleventh day. The stored
    panel must equal the batch indicators."""
    day = F.dayofmonth("Date")
    root = Fi.scratch_path(spark, "refresh")
    # the bars are read by three drops: built once
    X.region_bars(spark, sf).select(*[f.name for f in BAR_SCHEMA.fields]).write.parquet(f"{root}/bars")
    bars = spark.read.parquet(f"{root}/bars").withColumn("Close", F.when(day % 11 != 0, F.col("Close")))
    a, b = bars.selectExpr("percentile_approx(Date, array(0.6, 0.8), 10000) AS c").first()["c"]
    late = (day % 9 == 0) & (F.col("Date") < F.lit(a))
    wrong = (day == 15) & (F.col("Date") < F.lit(a))
    drops = [bars.filter((F.col("Date") < F.lit(a)) & ~late).withColumn(
                 "Close", F.when(wrong, F.col("Close") * 2).otherwise(F.col("Close"))),
             bars.filter(((F.col("Date") >= F.lit(a)) & (F.col("Date") < F.lit(b))) | wrong),
             bars.filter((F.col("Date") >= F.lit(b)) | late)]
    src, panel_path, ckpt = f"{root}/landing", f"{root}/panel", f"{root}/ckpt"
    for drop in drops:
        drop.write.mode("append").parquet(src)
        run(spark, src, bars.schema, panel_path, ckpt)
    out = St.read_refreshed(spark, panel_path).select(*S.BASE, "Return", *_IND_Q)
    return out.withColumns({c: quantize(c) for c in _IND_Q})


@register("incremental_refresh", _REFRESH_SQL)
def q_incremental_refresh(spark, sf):
    """L2 over the stored panel alone: a batch reads the history of its keys."""
    return _refreshed_in_drops(spark, sf, St.run_refresh)


@register("stateful_refresh", _REFRESH_SQL)
def q_stateful_refresh(spark, sf):
    """L2 over keyed state, one running stream: a batch reads the chunks of bars that
    it changes."""
    running = []

    def run(*args):
        if not running:
            running.append(Sf.start_stateful_refresh(*args))
        running[0].processAllAvailable()
    try:
        return _refreshed_in_drops(spark, sf, run)
    finally:
        for query in running:
            query.stop()


@register("csv_roundtrip", with_ctes(X.REGION_BARS_SQL, f"SELECT {BAR_COLS} FROM bars"))
def q_csv_roundtrip(spark, sf):
    path = Fi.scratch_path(spark, "bars_csv")
    Fi.export_csv(X.region_bars(spark, sf), path, partition_by="Ticker")
    return Fi.read_bars_csv(spark, path).select(*BAR_COLS.split(", "))


@register("panel_csv", with_ctes(PANEL_CTES, "SELECT Ticker, Date, Close, Volume, "
          "Is_Month_End, Target_Direction FROM df_clean"))
def q_panel_csv(spark, sf):
    """The engineered panel as one sorted CSV table, read back."""
    path = Fi.scratch_path(spark, "panel_csv")
    Fi.write_csv(panel(spark, sf), path)
    back = Fi.read_bars_csv(spark, path)
    return back.select("Ticker", "Date", "Close", "Volume", F.col("Is_Month_End").cast("int").alias("Is_Month_End"),
                       F.col("Target_Direction").cast("int").alias("Target_Direction"))


@register("dirty_csv", with_ctes(X.DIRTY_BARS_SQL, "SELECT Ticker, Date, Close, Volume, CAST(0 AS INTEGER) AS bad_cells "
          "FROM dirty WHERE src = 0"))
def q_dirty_csv(spark, sf):
    """Bars with missing cells written as ``null`` text, read back as NULL."""
    path = Fi.scratch_path(spark, "dirty_csv")
    bars = X.dirty_bars(spark, sf).filter("src = 0").select("Ticker", "Date", "Close", "Volume")
    bars.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in ("Close", "Volume")}) \
        .write.option("header", True).csv(path)
    return Fi.read_bars_csv(spark, path, flag_bad=True).select("Ticker", "Date", "Close", "Volume", F.col("_bad_cells").alias("bad_cells"))


@register("vendor_csv", with_ctes(X.REGION_BARS_SQL, """
SELECT Ticker, Date, Open, High, Low, Close, Volume FROM bars"""))
def q_vendor_csv(spark, sf):
    path = Fi.scratch_path(spark, "vendor_csv")
    Fi.write_vendor_csv(X.region_bars(spark, sf), path)
    return Fi.read_vendor_csv(spark, path)


@register("vendor_source", with_ctes(X.REGION_BARS_SQL, """
SELECT Ticker, Date, Open, High, Low, Close, Volume FROM bars"""))
def q_vendor_source(spark, sf):
    """S2 as a data source: one vendor file a ticker, the key from its folder."""
    path = Fi.scratch_path(spark, "vendor_files")
    Fi.write_vendor_csv(X.region_bars(spark, sf), path, by_key=True)
    return Ve.vendor_bars(spark, path)


@register("vendor_fallback", with_ctes(X.REGION_BARS_SQL, """
SELECT Ticker, Date, Close, CASE WHEN Ticker < 'B' THEN 'primary' ELSE 'secondary' END AS source
FROM bars WHERE year(Date) >= 1996"""))
def q_vendor_fallback(spark, sf):
    """S4 over two vendor folders: the first holds some tickers, the second all with
    prices doubled for the first's; both are read from 1996 on."""
    root = Fi.scratch_path(spark, "vendor_two")
    bars, mine = X.region_bars(spark, sf), F.col("Ticker") < "B"
    Fi.write_vendor_csv(bars.filter(mine), f"{root}/a", by_key=True)
    Fi.write_vendor_csv(bars.withColumn("Close", F.when(mine, F.col("Close") * 2).otherwise(F.col("Close"))), f"{root}/b", by_key=True)
    a, b = (Ve.vendor_bars(spark, f"{root}/{d}").filter(F.col("Date") >= F.lit("1996-01-01").cast("date")) for d in "ab")
    return prefer_source(a, b).select("Ticker", "Date", "Close", "source")


@register("panel_by_year", with_ctes(PANEL_CTES,
    "SELECT Ticker, Date, Year, Close, MA7 FROM (SELECT Ticker, Date, Year, Close, "
    + q_sql("MA7") + " AS MA7 FROM df_clean) t WHERE Year >= 1999"))
def q_panel_by_year(spark, sf):
    """Write the panel partitioned by year and read back 1999 on: the scan
    lists only the matching folders (PartitionFilters on Year)."""
    path = Fi.scratch_path(spark, "panel")
    Fi.write_panel(panel(spark, sf), path)
    out = Fi.read_panel(spark, path, 1999).select("Ticker", "Date", "Year", "Close", "MA7")
    return out.withColumn("MA7", quantize("MA7"))
