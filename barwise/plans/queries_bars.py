"""Registered queries: sources, bars and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from barwise.functions.exprs import quantize
from barwise.operators import bars as B
from barwise.operators import sketches as Sk
from barwise.operators.stats import profile
from barwise.plans.registry import q_sql, register, with_ctes
from barwise.sources import files as Fi
from barwise.sources import fixtures as X

BAR_COLS = "Ticker, Date, Open, High, Low, Close, adj_close, Volume"


@register("ohlcv_bars", with_ctes(X.REGION_BARS_SQL, f"SELECT {BAR_COLS} FROM bars"))
def q_ohlcv_bars(spark, sf):
    return X.region_bars(spark, sf)


@register("supplier_bars", with_ctes(X.SUPPLIER_BARS_SQL, f"SELECT {BAR_COLS} FROM sbars"))
def q_supplier_bars(spark, sf):
    return X.supplier_bars(spark, sf)


@register("tick_bars", with_ctes(X.TICK_BARS_SQL, f"SELECT {BAR_COLS} FROM tbars"))
def q_tick_bars(spark, sf):
    return X.tick_bars(spark, sf)


@register("walk_bars", with_ctes(X.WALK_BARS_SQL, f"SELECT {BAR_COLS} FROM walk"))
def q_walk_bars(spark, sf):
    return X.walk_bars(spark, sf)


@register("dirty_bars", with_ctes(X.DIRTY_BARS_SQL, f"SELECT {BAR_COLS}, src FROM dirty"))
def q_dirty_bars(spark, sf):
    return X.dirty_bars(spark, sf)


@register("dedup", with_ctes(X.DIRTY_BARS_SQL, f"""
SELECT {BAR_COLS}, src FROM (
  SELECT *, row_number() OVER (PARTITION BY Ticker, Date ORDER BY src) AS rn FROM dirty) t
WHERE rn = 1 AND Ticker IS NOT NULL"""))
def q_dedup(spark, sf):
    # C3 then C4: rows without a key tie on src, so only keyed rows are deterministic
    return B.dedup_bars(X.dirty_bars(spark, sf), "src").filter(F.col("Ticker").isNotNull())


_FILL_SQL = """
SELECT Ticker, Date,
  coalesce(last_value(Open IGNORE NULLS) OVER fw, first_value(Open IGNORE NULLS) OVER bw) AS Open,
  coalesce(last_value(High IGNORE NULLS) OVER fw, first_value(High IGNORE NULLS) OVER bw) AS High,
  coalesce(last_value(Low IGNORE NULLS) OVER fw, first_value(Low IGNORE NULLS) OVER bw) AS Low,
  coalesce(last_value(Close IGNORE NULLS) OVER fw, first_value(Close IGNORE NULLS) OVER bw) AS Close,
  coalesce(last_value(adj_close IGNORE NULLS) OVER fw, first_value(adj_close IGNORE NULLS) OVER bw) AS adj_close,
  coalesce(last_value(Volume IGNORE NULLS) OVER fw, first_value(Volume IGNORE NULLS) OVER bw, 0.0) AS Volume,
  src
FROM {src}
WINDOW fw AS (PARTITION BY Ticker ORDER BY Date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
       bw AS (PARTITION BY Ticker ORDER BY Date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"""


@register("fill_gaps", with_ctes(X.DIRTY_BARS_SQL, _FILL_SQL.format(
    src="(SELECT * FROM dirty WHERE src = 0) d")))
def q_fill_gaps(spark, sf):
    d = X.dirty_bars(spark, sf).filter("src = 0")
    return B.fill_gaps(d)


CLEAN_SQL = X.DIRTY_BARS_SQL + ["""
dedup AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY Ticker, Date ORDER BY src) AS rn FROM dirty) t
  WHERE rn = 1 AND Ticker IS NOT NULL AND Date IS NOT NULL)""",
    "clean AS (" + _FILL_SQL.format(src="dedup") + ")"]


@register("clean_bars", with_ctes(CLEAN_SQL, f"SELECT {BAR_COLS}, src FROM clean"))
def q_clean_bars(spark, sf):
    return B.clean_bars(X.dirty_bars(spark, sf), "src")


@register("universe_filter", with_ctes(X.REGION_BARS_SQL + X.UNIVERSE_SQL, f"""
SELECT {BAR_COLS} FROM bars
WHERE Ticker IN (SELECT Ticker FROM universe WHERE "group" = 'group_a')"""))
def q_universe_filter(spark, sf):
    return B.in_universe(X.region_bars(spark, sf), X.universe(spark), "group_a")


# app B: 5 * 365 + 150 days of history
HISTORY_DAYS = 5 * 365 + 150


@register("trailing_history", with_ctes(X.REGION_BARS_SQL, f"""
SELECT {BAR_COLS} FROM (
  SELECT *, max(Date) OVER (PARTITION BY Ticker) AS last_date FROM bars) t
WHERE Date > last_date - INTERVAL {HISTORY_DAYS} DAY"""))
def q_trailing_history(spark, sf):
    return B.trailing_history(X.region_bars(spark, sf), HISTORY_DAYS)


@register("source_fallback", with_ctes(X.WALK_BARS_SQL, f"""
SELECT {BAR_COLS}, 'primary' AS source FROM bars WHERE Ticker <> 'EUROPE'
UNION ALL
SELECT {BAR_COLS}, 'secondary' AS source FROM walk
WHERE Ticker NOT IN (SELECT DISTINCT Ticker FROM bars WHERE Ticker <> 'EUROPE')"""))
def q_source_fallback(spark, sf):
    bars = X.region_bars(spark, sf)
    primary = bars.filter(F.col("Ticker") != "EUROPE")
    return B.prefer_source(primary, X.walk_bars(spark, sf, bars))


_PROFILE_COLS = ["Open", "High", "Low", "Close", "adj_close", "Volume"]


@register("profile", with_ctes(X.DIRTY_BARS_SQL, " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) AS n, count(*) - count({c}) AS nulls,
       count(DISTINCT {c}) AS n_distinct, min({c}) AS min, max({c}) AS max,
       {q_sql(f'avg({c})')} AS mean FROM dirty""" for c in _PROFILE_COLS)))
def q_profile(spark, sf):
    out = profile(X.dirty_bars(spark, sf), _PROFILE_COLS)
    return out.withColumn("mean", quantize("mean"))


# ------------------------------------------------ C2, S5, S7 beside the plain forms
#: offsets written behind the stamps, by key (fixed values)
ZONES = {"AFRICA": "+02:00", "AMERICA": "-05:00", "ASIA": "Z", "EUROPE": "+00:00", "MIDDLE EAST": " +03:30"}


@register("zoned_dates", with_ctes(X.REGION_BARS_SQL, "SELECT Ticker, strftime(Date, '%Y-%m-%d') || ' 23:30:00' || CASE Ticker "
    + " ".join(f"WHEN '{k}' THEN '{z}'" for k, z in ZONES.items()) + " END AS stamp, Date FROM bars"))
def q_zoned_dates(spark, sf):
    """Stamps late in the day with zones keep the date on their wall clock."""
    zone = F.element_at(F.create_map(*[F.lit(x) for kz in ZONES.items() for x in kz]), F.col("Ticker"))
    bars = X.region_bars(spark, sf).select("Ticker", F.concat(F.date_format("Date", "yyyy-MM-dd"), F.lit(" 23:30:00"), zone).alias("stamp"))
    return bars.withColumn("Date", Fi.to_bar_date("stamp"))


@register("profile_merged", with_ctes(X.DIRTY_BARS_SQL, " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) AS n, count(*) - count({c}) AS nulls, min({c}) AS min, max({c}) AS max,
       {q_sql(f'avg({c})')} AS mean, true AS distinct_within_2pct, true AS one_pass_within_1pct FROM dirty""" for c in _PROFILE_COLS)))
def q_profile_merged(spark, sf):
    """One sketch a year, merged: against the exact profile and against a sketch
    of all rows at once."""
    d = X.dirty_bars(spark, sf)
    years = Sk.sketch_drops(d.withColumn("y", F.year("Date")), _PROFILE_COLS, "y")
    merged, once = Sk.profile_of(Sk.merge_sketches(years)), Sk.profile_of(Sk.sketch_drops(d, _PROFILE_COLS))
    exact = profile(d, _PROFILE_COLS).select("column", F.col("n_distinct").alias("exact"))
    near = F.abs(F.col("n_distinct") - F.col("exact")) <= F.col("exact") * 0.02
    return (merged.join(exact, "column").join(once.select("column", F.col("n_distinct").alias("once")), "column")
            .select("column", "n", "nulls", "min", "max", quantize("mean").alias("mean"), near.alias("distinct_within_2pct"),
                    (F.abs(F.col("n_distinct") - F.col("once")) <= F.col("once") * 0.01).alias("one_pass_within_1pct")))
