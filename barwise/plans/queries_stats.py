"""Registered queries: cross-key statistics and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from barwise.functions import windows as Wn
from barwise.functions.exprs import quantize
from barwise.functions.ordering import rank_by
from barwise.operators import stats as St
from barwise.operators.correlation import correlation_pairs, extreme_correlations
from barwise.operators.lsq import materialize_small
from barwise.plans import sql_features as S
from barwise.plans.queries_features import PANEL_CTES, panel
from barwise.plans.registry import q_sql, register, with_ctes
from barwise.sources import fixtures as X

W = S.W


def _q(df, cols):
    return df.withColumns({c: quantize(c) for c in cols})


TR_CTE = ["""tr AS (SELECT Ticker,
  (arg_max(adj_close, Date) / nullif(arg_min(adj_close, Date), 0) - 1) * 100 AS total_return_pct
  FROM df_clean GROUP BY Ticker)"""]


@register("total_return", with_ctes(PANEL_CTES + TR_CTE, """
SELECT Ticker, total_return_pct,
  CAST(row_number() OVER (ORDER BY total_return_pct DESC NULLS LAST, Ticker) AS INTEGER) AS rank
FROM tr"""))
def q_total_return(spark, sf):
    return St.total_return(panel(spark, sf))


@register("performers", with_ctes(PANEL_CTES + TR_CTE, """
SELECT (SELECT Ticker FROM tr ORDER BY total_return_pct DESC, Ticker LIMIT 1) AS best,
       (SELECT max(total_return_pct) FROM tr) AS best_value,
       (SELECT Ticker FROM tr ORDER BY total_return_pct ASC, Ticker LIMIT 1) AS worst,
       (SELECT min(total_return_pct) FROM tr) AS worst_value"""))
def q_performers(spark, sf):
    return St.extremes(St.total_return(panel(spark, sf), with_rank=False), "total_return_pct")


RISK_CTES = [f"""rs0 AS (SELECT *, max(adj_close) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
   AS peak FROM df_clean)""", """risk AS (SELECT Ticker,
  pow(1 + avg(Daily_Return), 252) - 1 AS ann_return,
  stddev_samp(Daily_Return) * sqrt(252) AS ann_volatility,
  avg(Daily_Return) / nullif(stddev_samp(Daily_Return), 0) * sqrt(252) AS sharpe,
  max((peak - adj_close) / nullif(peak, 0)) AS max_drawdown
  FROM rs0 GROUP BY Ticker)"""]
RISK_Q = ["ann_return", "ann_volatility", "sharpe"]


@register("risk_stats", with_ctes(PANEL_CTES + RISK_CTES, f"""
SELECT Ticker, {q_sql('ann_return')} AS ann_return, {q_sql('ann_volatility')} AS ann_volatility,
  {q_sql('sharpe')} AS sharpe, max_drawdown FROM risk"""))
def q_risk_stats(spark, sf):
    return _q(St.risk_stats(panel(spark, sf)), RISK_Q)


def flagship(spark, sf):
    """Total return and risk per region, ranked by Sharpe (the entry query)."""
    p = panel(spark, sf)
    risk = _q(St.risk_stats(p), RISK_Q)
    tr = St.total_return(p, with_rank=False)
    return rank_by(risk.join(tr, "Ticker"), "sharpe", desc=True, tie=["Ticker"], name="sharpe_rank")


@register("flagship", with_ctes(PANEL_CTES + RISK_CTES + TR_CTE, f"""
SELECT r.Ticker, {q_sql('ann_return')} AS ann_return, {q_sql('ann_volatility')} AS ann_volatility,
  {q_sql('sharpe')} AS sharpe, max_drawdown, total_return_pct,
  CAST(row_number() OVER (ORDER BY {q_sql('sharpe')} DESC NULLS LAST, r.Ticker) AS INTEGER) AS sharpe_rank
FROM risk r JOIN tr USING (Ticker)"""))
def q_flagship(spark, sf):
    return flagship(spark, sf)


@register("activity", with_ctes(PANEL_CTES, f"""
SELECT Ticker, {q_sql('avg(Volume) / 1e6')} AS avg_volume_m,
  {q_sql('avg(Volatility_30d)')} AS avg_volatility_30d,
  {q_sql('avg(CASE WHEN abs(Daily_Return) > CAST(0.05 AS DOUBLE) THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) * 100')} AS pct_big_move_days,
  count(DISTINCT Date) AS trading_days
FROM df_clean GROUP BY Ticker"""))
def q_activity(spark, sf):
    return _q(St.activity_stats(panel(spark, sf)), ["avg_volume_m", "avg_volatility_30d", "pct_big_move_days"])


CORR_CTE = [f"""cp AS (SELECT a.Ticker AS ticker_a, b.Ticker AS ticker_b, count(*) AS n_common,
  CASE WHEN count(*) >= 2 AND var_pop(a.Daily_Return) > 0 AND var_pop(b.Daily_Return) > 0
       THEN {q_sql('corr(a.Daily_Return, b.Daily_Return)')} END AS corr
  FROM df_clean a JOIN df_clean b ON a.Date = b.Date
  WHERE a.Daily_Return IS NOT NULL AND b.Daily_Return IS NOT NULL
  GROUP BY a.Ticker, b.Ticker)"""]


def _corr(spark, sf, mirror=True):
    return correlation_pairs(panel(spark, sf), "Daily_Return", mirror=mirror).withColumn("corr", quantize("corr"))


@register("correlation", with_ctes(PANEL_CTES + CORR_CTE, "SELECT * FROM cp"))
def q_correlation(spark, sf):
    return _corr(spark, sf)


SUPPLIER_CORR = X.SUPPLIER_BARS_SQL + [f"""
sr AS (SELECT Ticker, Date, Close / nullif(lag(Close, 1) OVER ({W}), 0) - 1 AS r FROM sbars)""",
    f"""scp AS (SELECT a.Ticker AS ticker_a, b.Ticker AS ticker_b, count(*) AS n_common,
  CASE WHEN count(*) >= 2 AND var_pop(a.r) > 0 AND var_pop(b.r) > 0
       THEN {q_sql('corr(a.r, b.r)')} END AS corr
  FROM sr a JOIN sr b ON a.Date = b.Date
  WHERE a.r IS NOT NULL AND b.r IS NOT NULL GROUP BY a.Ticker, b.Ticker)"""]


def _supplier_returns(spark, sf):
    """The narrow bars are written once, so that the shuffle of the lines is off the
    disk when the bars go to their keys."""
    b = materialize_small(X.supplier_bars(spark, sf).select("Ticker", "Date", "Close"), drop_shuffles=True)
    return Wn.pct_change(b, "Close", 1, "r")


@register("supplier_correlation", with_ctes(SUPPLIER_CORR, "SELECT * FROM scp"))
def q_supplier_correlation(spark, sf):
    return correlation_pairs(_supplier_returns(spark, sf), "r").withColumn("corr", quantize("corr"))


#: correlations that the grid of ``quantize`` takes for equal are ties
GRID = 2.0 ** -20

EXTREMES_SQL = """
(SELECT 'strongest' AS kind, ticker_a, ticker_b, corr FROM {cp}
 WHERE ticker_a {op} ticker_b AND corr IS NOT NULL ORDER BY corr DESC, ticker_a, ticker_b LIMIT 1)
UNION ALL
(SELECT 'weakest' AS kind, ticker_a, ticker_b, corr FROM {cp}
 WHERE ticker_a {op} ticker_b AND corr IS NOT NULL ORDER BY corr ASC, ticker_a, ticker_b LIMIT 1)"""


@register("supplier_extreme_pairs", with_ctes(SUPPLIER_CORR, EXTREMES_SQL.format(cp="scp", op="<")))
def q_supplier_extreme_pairs(spark, sf):
    """The two extreme pairs of all suppliers; no table of pairs is made."""
    return extreme_correlations(_supplier_returns(spark, sf), "r", grid=GRID)


@register("extreme_pairs", with_ctes(PANEL_CTES + CORR_CTE, """
(SELECT 'strongest' AS kind, ticker_a, ticker_b, corr FROM cp
 WHERE ticker_a < ticker_b AND corr IS NOT NULL ORDER BY corr DESC, ticker_a, ticker_b LIMIT 1)
UNION ALL
(SELECT 'weakest' AS kind, ticker_a, ticker_b, corr FROM cp
 WHERE ticker_a < ticker_b AND corr IS NOT NULL ORDER BY corr ASC, ticker_a, ticker_b LIMIT 1)"""))
def q_extreme_pairs(spark, sf):
    return extreme_correlations(panel(spark, sf), grid=GRID)


@register("yearly_stats", with_ctes(PANEL_CTES, f"""
SELECT Ticker, CAST(year(Date) AS INTEGER) AS Year, {q_sql('avg(Daily_Return)')} AS mean_return,
  {q_sql('stddev_samp(Daily_Return)')} AS std_return, {q_sql('avg(Close)')} AS mean_close
FROM df_clean GROUP BY Ticker, year(Date)"""))
def q_yearly_stats(spark, sf):
    return _q(St.yearly_stats(panel(spark, sf)), ["mean_return", "std_return", "mean_close"])


def _kpi_sql(days):
    inwin = "TRUE" if days is None else f"Date > max(Date) OVER (PARTITION BY Ticker) - INTERVAL {days} DAY"
    return with_ctes(X.REGION_BARS_SQL + [f"""
k0 AS (SELECT *, lag(Close, 1) OVER ({W}) AS prev, {inwin} AS inwin FROM bars)"""], """
SELECT Ticker, max(Date) AS last_date, arg_max(Close, Date) AS last_close,
  coalesce((arg_max(Close, Date) / nullif(arg_max(prev, Date), 0) - 1) * 100, 0.0) AS change_pct,
  arg_max(Volume, Date) AS last_volume,
  max(CASE WHEN inwin THEN High END) AS high_max, min(CASE WHEN inwin THEN Low END) AS low_min,
  count(*) AS n_bars
FROM k0 GROUP BY Ticker""")


@register("kpis", _kpi_sql(None))
def q_kpis(spark, sf):
    return St.kpis(X.region_bars(spark, sf))


@register("kpis_52w", _kpi_sql(365))
def q_kpis_52w(spark, sf):
    return St.kpis(X.region_bars(spark, sf), window_days=365)


@register("histogram", with_ctes(X.REGION_BARS_SQL + [
    f"h0 AS (SELECT Ticker, (Close / nullif(lag(Close, 1) OVER ({W}), 0) - 1) * 100 AS v FROM bars)",
    "h1 AS (SELECT Ticker, v FROM h0 WHERE v IS NOT NULL)",
    "rng AS (SELECT Ticker, min(v) AS mn, max(v) AS mx, (max(v) - min(v)) / 70.0 AS w FROM h1 GROUP BY Ticker)",
    """cnt AS (SELECT h1.Ticker, CAST(CASE WHEN w > 0 THEN least(floor((v - mn) / w), 69) ELSE 0 END AS INTEGER) AS bin,
       count(*) AS n FROM h1 JOIN rng ON h1.Ticker = rng.Ticker GROUP BY 1, 2)""",
    "grid AS (SELECT Ticker, mn, w, CAST(unnest(range(0, 70)) AS INTEGER) AS bin FROM rng)"], """
SELECT g.Ticker, g.bin, mn + g.bin * w AS lo, mn + (g.bin + 1) * w AS hi, coalesce(c.n, 0) AS n
FROM grid g LEFT JOIN cnt c ON g.Ticker = c.Ticker AND g.bin = c.bin"""))
def q_histogram(spark, sf):
    b = Wn.pct_change(X.region_bars(spark, sf), "Close", 1, "Return")
    return St.histogram(b, "Return", 70, scale=100.0)


LABELS = ["down", "flat", "up"]


def return_label(r="Daily_Return", band=0.005):
    return (F.when(F.col(r) < -band, "down").when(F.col(r) > band, "up").otherwise("flat"))


LABEL_CTE = ["""lab AS (SELECT *, CASE WHEN Daily_Return < -0.005 THEN 'down'
  WHEN Daily_Return > 0.005 THEN 'up' ELSE 'flat' END AS label FROM df_clean)"""]


@register("label_counts", with_ctes(PANEL_CTES + LABEL_CTE, """
SELECT Ticker, count(*) FILTER (WHERE label = 'down') AS down,
  count(*) FILTER (WHERE label = 'flat') AS flat, count(*) FILTER (WHERE label = 'up') AS up
FROM lab GROUP BY Ticker"""))
def q_label_counts(spark, sf):
    return St.label_counts(panel(spark, sf).withColumn("label", return_label()), "label", LABELS)


@register("label_shares", with_ctes(PANEL_CTES + LABEL_CTE, """
SELECT Ticker, label, n, n / sum(n) OVER (PARTITION BY Ticker) AS share
FROM (SELECT Ticker, label, count(*) AS n FROM lab GROUP BY Ticker, label) t"""))
def q_label_shares(spark, sf):
    return St.label_shares(panel(spark, sf).withColumn("label", return_label()), "label")


MDM_COLS = ["Daily_Return", "Overnight_Gap", "Volume_Ratio", "Price_Position_20d"]


@register("mean_of_daily_means", with_ctes(PANEL_CTES, "SELECT " + ", ".join(
    f"{q_sql(f'avg({c})')} AS mean_{c}" for c in MDM_COLS)
    + " FROM (SELECT Date, " + ", ".join(f"avg({c}) AS {c}" for c in MDM_COLS)
    + " FROM df_clean GROUP BY Date) d"))
def q_mean_of_daily_means(spark, sf):
    return _q(St.mean_of_daily_means(panel(spark, sf), MDM_COLS), [f"mean_{c}" for c in MDM_COLS])


Z_CTE = ["""z AS (SELECT *, coalesce(abs((Daily_Return - avg(Daily_Return) OVER (PARTITION BY Ticker))
  / nullif(stddev_samp(Daily_Return) OVER (PARTITION BY Ticker), 0)) > 3, false) AS is_anomaly FROM df_clean)"""]


@register("anomaly_rate", with_ctes(PANEL_CTES + Z_CTE, f"""
SELECT Ticker, {q_sql('avg(CAST(is_anomaly AS DOUBLE)) * 100')} AS anomaly_rate_pct,
  count(*) FILTER (WHERE is_anomaly) AS n_anomalies FROM z GROUP BY Ticker"""))
def q_anomaly_rate(spark, sf):
    return _q(St.anomaly_rate(St.zscore_flags(panel(spark, sf), "Daily_Return")), ["anomaly_rate_pct"])


@register("anomaly_rate_overall", with_ctes(PANEL_CTES + Z_CTE, f"""
SELECT {q_sql('avg(CAST(is_anomaly AS DOUBLE)) * 100')} AS anomaly_rate_pct,
  count(*) FILTER (WHERE is_anomaly) AS n_anomalies, count(*) AS n FROM z"""))
def q_anomaly_rate_overall(spark, sf):
    return _q(St.overall_anomaly_rate(St.zscore_flags(panel(spark, sf), "Daily_Return")), ["anomaly_rate_pct"])


@register("anomaly_top_moves", with_ctes(PANEL_CTES + Z_CTE, f"""
SELECT Date, Ticker, Daily_Return, {q_sql('Volume_Ratio')} AS Volume_Ratio FROM z WHERE is_anomaly
ORDER BY abs(Daily_Return) DESC, Date, Ticker LIMIT 10"""))
def q_anomaly_top_moves(spark, sf):
    """T3 on the flagged rows only."""
    flagged = St.zscore_flags(panel(spark, sf), "Daily_Return").filter("is_anomaly")
    return St.top_abs(flagged, "Daily_Return", 10).select(
        "Date", "Ticker", "Daily_Return", quantize("Volume_Ratio").alias("Volume_Ratio"))


REGIONS = [k for _, k in X.UNIVERSE]


@register("anomaly_calendar", with_ctes(PANEL_CTES + Z_CTE, """
SELECT strftime(Date, '%Y-%m') AS YearMonth, """ + ", ".join(
    f"""count(*) FILTER (WHERE Ticker = '{k}') AS "{k}\"""" for k in REGIONS) + """
FROM z WHERE is_anomaly GROUP BY 1"""))
def q_anomaly_calendar(spark, sf):
    return St.anomaly_calendar(St.zscore_flags(panel(spark, sf), "Daily_Return"), REGIONS)


@register("profile_text", with_ctes(X.DIRTY_BARS_SQL, " UNION ALL ".join(f"""
SELECT '{c}' AS "column", count(*) AS n, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS n_distinct,
  min(CAST({c} AS VARCHAR)) AS first_value, max(CAST({c} AS VARCHAR)) AS last_value,
  max(length(CAST({c} AS VARCHAR))) AS max_length FROM dirty""" for c in ["Ticker", "Date"])))
def q_profile_text(spark, sf):
    return St.profile_text(X.dirty_bars(spark, sf), ["Ticker", "Date"])


@register("tail_rows", with_ctes(X.REGION_BARS_SQL, """
SELECT Ticker, Date, Open, High, Low, Close, adj_close, Volume FROM bars ORDER BY Date DESC, Ticker DESC LIMIT 10"""))
def q_tail_rows(spark, sf):
    return St.tail_rows(X.region_bars(spark, sf), 10)


@register("top_moves", with_ctes(PANEL_CTES, f"""
SELECT Date, Ticker, Daily_Return, {q_sql('Volume_Ratio')} AS Volume_Ratio FROM df_clean
ORDER BY abs(Daily_Return) DESC, Date, Ticker LIMIT 10"""))
def q_top_moves(spark, sf):
    t = St.top_abs(panel(spark, sf), "Daily_Return", 10)
    return t.select("Date", "Ticker", "Daily_Return", quantize("Volume_Ratio").alias("Volume_Ratio"))


@register("fundamentals_join", with_ctes(X.REGION_BARS_SQL + X.FUNDAMENTALS_SQL, f"""
SELECT k.Ticker, k.last_close, coalesce(f.longName, '') AS long_name,
  {q_sql('coalesce(f.marketCap, 0.0) / 1e12')} AS market_cap_t,
  CASE WHEN f.trailingPE IS NULL OR f.trailingPE = 0 THEN 'N/A' ELSE printf('%.2f', f.trailingPE) END AS pe_ratio
FROM (SELECT Ticker, arg_max(Close, Date) AS last_close FROM bars GROUP BY Ticker) k
LEFT JOIN fundamentals f ON k.Ticker = f.Ticker"""))
def q_fundamentals_join(spark, sf):
    k = St.kpis(X.region_bars(spark, sf)).select("Ticker", "last_close")
    j = St.with_fundamentals(k, X.fundamentals(spark, sf))
    return j.withColumn("market_cap_t", quantize("market_cap_t"))


@register("last_rows", with_ctes(X.REGION_BARS_SQL, """
SELECT Ticker, Date, Open, High, Low, Close, adj_close, Volume FROM (
  SELECT *, row_number() OVER (PARTITION BY Ticker ORDER BY Date DESC) AS rn FROM bars) t WHERE rn <= 10"""))
def q_last_rows(spark, sf):
    return St.last_rows(X.region_bars(spark, sf), 10)


@register("date_range", with_ctes(PANEL_CTES, """
SELECT Ticker, min(Date) AS first_date, max(Date) AS last_date FROM df_clean GROUP BY Ticker"""))
def q_date_range(spark, sf):
    return St.date_range(panel(spark, sf), key="Ticker")


# ------------------------------------------------ quirk-reproducing variants
@register("risk_stats_pct", with_ctes(PANEL_CTES + RISK_CTES, f"""
SELECT Ticker, {q_sql('ann_return * 100')} AS ann_return, {q_sql('ann_volatility * 100')} AS ann_volatility,
  {q_sql('sharpe * 100')} AS sharpe, {q_sql('max_drawdown * 100')} AS max_drawdown FROM risk"""))
def q_risk_stats_pct(spark, sf):
    """Q4: the reference scales every risk column by 100."""
    r = St.risk_stats(panel(spark, sf), percent=True)
    return _q(r, RISK_Q + ["max_drawdown"])


@register("extreme_pairs_incl_self", with_ctes(PANEL_CTES + CORR_CTE, """
(SELECT 'strongest' AS kind, ticker_a, ticker_b, corr FROM cp
 WHERE ticker_a <= ticker_b AND corr IS NOT NULL ORDER BY corr DESC, ticker_a, ticker_b LIMIT 1)
UNION ALL
(SELECT 'weakest' AS kind, ticker_a, ticker_b, corr FROM cp
 WHERE ticker_a <= ticker_b AND corr IS NOT NULL ORDER BY corr ASC, ticker_a, ticker_b LIMIT 1)"""))
def q_extreme_pairs_incl_self(spark, sf):
    """Q5: with the diagonal, the strongest pair is a key with itself."""
    return extreme_correlations(panel(spark, sf), exclude_self=False, grid=GRID)
