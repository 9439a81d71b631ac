"""Registered queries (rows-only): clustering, anomalies, PCA and mixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from barwise.functions.exprs import quantize
from barwise.operators import stats as St
from barwise.operators import unsupervised as U
from barwise.plans.queries_features import PANEL_CTES, panel
from barwise.plans.registry import q_sql, register, with_ctes
from barwise.sources import fixtures as X


def _design(spark, sf):
    return U.unsup_design(panel(spark, sf))


@register("kmeans")
def q_kmeans(spark, sf):
    model, out = U.fit_regimes(_design(spark, sf))
    sil = U.silhouette(out.withColumn("regime", F.col("regime").cast("int")), "regime")
    return out.select("Ticker", "Date", "regime", F.lit(sil).alias("silhouette"))


@register("silhouette_regions", with_ctes(PANEL_CTES + ["""
sl AS (SELECT Ticker, row_number() OVER (ORDER BY Ticker, Date) AS id, Daily_Return * 10 AS x, HL_Range AS y, Price_Position_20d AS z FROM df_clean)""", """
sd AS (SELECT a.id, a.Ticker AS t, b.Ticker AS u, sum(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))) AS s
  FROM sl a, sl b GROUP BY a.id, a.Ticker, b.Ticker)""", """
sn AS (SELECT Ticker AS u, count(*) AS n FROM sl GROUP BY Ticker)""", """
sw AS (SELECT id, max(CASE WHEN t = u THEN s / (n - 1) END) AS a, min(CASE WHEN t <> u THEN s / n END) AS b
  FROM sd JOIN sn USING (u) GROUP BY id)"""], f"""
SELECT {q_sql('avg((b - a) / greatest(a, b))', 16)} AS silhouette FROM sw"""))
def q_silhouette_regions(spark, sf):
    """E6 on given labels: how well three features tell the regions apart."""
    from pyspark.ml.feature import VectorAssembler
    x = panel(spark, sf).select((F.col("Daily_Return") * 10).alias("x"), F.col("HL_Range").alias("y"), F.col("Price_Position_20d").alias("z"), "Ticker")
    names = F.array(*[F.lit(t) for t in sorted(t for _, t in X.UNIVERSE)])
    d = VectorAssembler(inputCols=["x", "y", "z"], outputCol="features").transform(x.withColumn("c", F.array_position(names, F.col("Ticker"))))
    return spark.createDataFrame([(U.silhouette(d, "c"),)], "silhouette double").select(quantize("silhouette", 16).alias("silhouette"))


@register("regime_counts")
def q_regime_counts(spark, sf):
    _, out = U.fit_regimes(_design(spark, sf))
    return St.label_counts(out.withColumn("regime", F.col("regime").cast("string")), "regime",
                           ["0", "1", "2", "3"])


@register("isolation")
def q_isolation(spark, sf):
    return U.isolation_scores(_design(spark, sf))


@register("isolation_flags", with_ctes(PANEL_CTES, """
SELECT count(*) AS n, CAST(floor(count(*) * 0.02) AS BIGINT) AS flagged, true AS above_the_others FROM df_clean"""))
def q_isolation_flags(spark, sf):
    """M8: two rows in a hundred are flagged, and none scores below another."""
    s = U.isolation_scores(_design(spark, sf))
    flagged, score = F.col("is_anomaly"), F.col("anomaly_score")
    return s.agg(F.count(F.lit(1)).alias("n"), F.count_if(flagged).alias("flagged"),
                 (F.min(F.when(flagged, score)) >= F.max(F.when(~flagged, score))).alias("above_the_others"))


@register("kmeans_assignment", with_ctes(PANEL_CTES, """
SELECT count(*) AS n, count(*) AS nearest, CAST(4 AS BIGINT) AS regimes FROM df_clean"""))
def q_kmeans_assignment(spark, sf):
    """M7: every row is in the regime whose mean, recomputed from the rows, is the
    nearest of all."""
    from pyspark.ml.functions import vector_to_array
    _, out = U.fit_regimes(_design(spark, sf))
    x = out.select("Ticker", "Date", "regime", vector_to_array("features").alias("v"))
    d = x.select(F.size("v")).first()[0]
    means = x.groupBy("regime").agg(F.array(*[F.avg(F.col("v")[j]) for j in range(d)]).alias("m")).collect()
    far = lambda m: F.aggregate(F.zip_with("v", F.array(*[F.lit(c) for c in m]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, e: s + e)
    own = F.coalesce(*[F.when(F.col("regime") == r.regime, far(r.m)) for r in means])
    near = own <= F.least(*[far(r.m) for r in means]) * F.lit(1 + 1e-6)
    return x.agg(F.count(F.lit(1)).alias("n"), F.count_if(near).alias("nearest"), F.count_distinct("regime").alias("regimes"))


@register("isolation_rate")
def q_isolation_rate(spark, sf):
    return St.anomaly_rate(U.isolation_scores(_design(spark, sf)))


@register("pca")
def q_pca(spark, sf):
    comp, _ = U.pca_summary(_design(spark, sf))
    return comp


@register("pca_loadings")
def q_pca_loadings(spark, sf):
    _, load = U.pca_summary(_design(spark, sf))
    return St.top_abs(load, "loading", 8, tie=("feature",))


@register("pca_two", with_ctes(PANEL_CTES + ["pr AS (SELECT abs(corr(Close, Volume)) AS r FROM df_clean)"], f"""
SELECT CAST(1 AS INTEGER) AS component, {q_sql('(1 + r) / 2', 16)} AS ratio FROM pr
UNION ALL SELECT CAST(2 AS INTEGER), {q_sql('(1 - r) / 2', 16)} FROM pr"""))
def q_pca_two(spark, sf):
    """M9 on two standardised columns: the ratios are (1 +- |r|) / 2."""
    cols = ["Close", "Volume"]
    comp, _ = U.pca_summary(U.unsup_design(panel(spark, sf), cols), cols)
    return comp.select("component", quantize("ratio", 16).alias("ratio"))


# the first component of three standardised columns by power iteration
_PC1_STEP = ["x + r12 * y + r13 * z", "r12 * x + y + r23 * z", "r13 * x + r23 * y + z"]
_PC1_NORM = "sqrt(" + " + ".join(f"({e}) * ({e})" for e in _PC1_STEP) + ")"


@register("pca_loadings_three", with_ctes(PANEL_CTES + ["""
pr AS MATERIALIZED (SELECT corr("Open", MA7) AS r12, corr("Open", Volume) AS r13, corr(MA7, Volume) AS r23 FROM df_clean)""", """
pw AS (SELECT 0 AS i, CAST(1 AS DOUBLE) AS x, CAST(0.5 AS DOUBLE) AS y, CAST(0.25 AS DOUBLE) AS z
  UNION ALL SELECT i + 1, """ + ", ".join(f"({e}) / {_PC1_NORM}" for e in _PC1_STEP) + """ FROM pw, pr WHERE i < 400)""", """
pl AS (SELECT unnest(['Open', 'MA7', 'Volume']) AS feature, unnest([x, y, z]) AS v FROM pw WHERE i = 400)"""], f"""
SELECT feature, {q_sql('abs(v)', 16)} AS weight FROM pl ORDER BY abs(v) DESC LIMIT 2""").replace("WITH ", "WITH RECURSIVE ", 1))
def q_pca_loadings_three(spark, sf):
    """T4 on three columns: the two greatest loadings of the first component."""
    cols = ["Open", "MA7", "Volume"]
    _, load = U.pca_summary(U.unsup_design(panel(spark, sf), cols), cols)
    return St.top_abs(load, "loading", 2, tie=("feature",)).select("feature", quantize(F.abs("loading"), 16).alias("weight"))


@register("gmm_assignment", with_ctes(PANEL_CTES, """
SELECT count(*) AS n, count(*) AS likeliest, count(*) AS summing_to_one, CAST(4 AS BIGINT) AS states FROM df_clean"""))
def q_gmm_assignment(spark, sf):
    """Every row is in its likeliest state and its probabilities sum to one."""
    out, _, _ = U.fit_states(_design(spark, sf))
    probs = [F.col(f"State_{i}") for i in range(4)]
    own = F.element_at(F.array(*probs), F.col("state") + 1)
    return out.agg(F.count(F.lit(1)).alias("n"), F.count_if(own >= F.greatest(*probs)).alias("likeliest"),
                   F.count_if(F.abs(sum(probs, F.lit(0.0)) - 1.0) < 1e-9).alias("summing_to_one"),
                   F.count_distinct("state").alias("states"))


@register("gmm")
def q_gmm(spark, sf):
    out, mean_ll, sil = U.fit_states(_design(spark, sf))
    return out.withColumns({"mean_log_likelihood": F.lit(mean_ll), "silhouette": F.lit(sil).cast("double")})


@register("gmm_daily_means")
def q_gmm_daily_means(spark, sf):
    out, _, _ = U.fit_states(_design(spark, sf))
    return St.mean_of_daily_means(out, [f"State_{i}" for i in range(4)])


@register("gmm_state_shares")
def q_gmm_state_shares(spark, sf):
    out, _, _ = U.fit_states(_design(spark, sf))
    return St.label_shares(out, "state")


# dashboard variant: Close, Volume, Return, Volatility_30d, unscaled, NULL -> 0
APP_FEATURES = ["Close", "Volume", "Return", "Volatility_30d"]


def _app_design(spark, sf):
    from barwise.functions.windows import indicators
    from barwise.sources import fixtures as X
    ind = indicators(X.region_bars(spark, sf))
    return U.unsup_design(ind, APP_FEATURES, fill_null=True, scale=False)


@register("kmeans_app")
def q_kmeans_app(spark, sf):
    _, out = U.fit_regimes(_app_design(spark, sf))
    return out.select("Ticker", "Date", "regime")


@register("isolation_app")
def q_isolation_app(spark, sf):
    return U.isolation_scores(_app_design(spark, sf), APP_FEATURES)
