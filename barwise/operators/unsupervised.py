"""Unsupervised models.

K-Means, PCA and the Gaussian mixture are MLlib estimators. The isolation
forest (M8), which MLlib lacks, is a Spark job:

1. sample: every row draws for every tree on its own (a hash of row, tree and
   seed below a probability that leaves more than psi rows a tree), and each tree
   keeps the psi rows of least hash: min(psi, n) rows a tree at every size;
2. grow: ``groupBy("tree").applyInPandas`` grows every tree from its <= psi
   rows (random feature, random split between the node's min and max, depth
   limit ceil(log2 psi)), emitting nodes as rows;
3. score: the forest (trees * (2 psi - 1) nodes at most - a bound that does not
   grow with the data) is broadcast and every partition is scored in
   ``mapInPandas`` with vectorised numpy traversal; s = 2^(-E[h] / c(psi))
   (Liu, Ting and Zhou, 2008);
4. flag: the rows that rank among the highest n * contamination scores, by a
   distributed rank (exact at every size, ties by key and date).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barwise.functions.ordering import global_index
from barwise.operators.lsq import materialize_small
from barwise.operators.splits import zscore
from barwise.schema import UNSUPERVISED_FEATURES


def unsup_design(df: DataFrame, features=tuple(UNSUPERVISED_FEATURES), fill_null: bool = False,
                 scale: bool = True):
    """z-scored features (fitted on all rows, as the reference does) + vector.
    The dashboard variant uses raw features with NULL -> 0 (``scale=False``,
    ``fill_null=True``)."""
    cols = list(features)
    d = df.na.fill(0.0, cols) if fill_null else df
    z = zscore(d, cols, fit_on=None) if scale else d
    va = VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="error")
    return materialize_small(va.transform(z).select("Ticker", "Date", *cols, "features"))


# ---------------------------------------------------------------- M7, E6
def fit_regimes(d: DataFrame, k: int = 4, restarts: int = 10, seed: int = 42):
    """K-Means with ``restarts`` seeds, keeping the lowest cost; clusters are
    renumbered by their centres (lexicographic order) so labels are stable."""
    best = None
    for i in range(restarts):
        m = KMeans(k=k, seed=seed + i, maxIter=300, tol=1e-6).fit(d)
        cost = m.summary.trainingCost
        if best is None or cost < best[0]:
            best = (cost, m)
    model = best[1]
    order = sorted(range(k), key=lambda j: tuple(model.clusterCenters()[j]))
    relabel = F.create_map(*[x for new, old in enumerate(order) for x in (F.lit(old), F.lit(new))])
    out = model.transform(d).withColumn("regime", relabel[F.col("prediction")].cast("int"))
    return model, out.drop("prediction")


def silhouette(pred: DataFrame, label: str, metric: str = "euclidean", features="features", shard_rows: int = 65_536) -> float | None:
    """Mean silhouette; None with fewer than two clusters.

    ``euclidean`` (what the reference reports) needs the distance of every row to
    every other: tasks hold one shard of rows while all rows stream past and hand
    on the sums of distances by cluster, no pairs. The work grows with the square
    of the rows; ``squared`` is MLlib's squared variant, one pass over centres."""
    counts = {r[0]: r[1] for r in pred.groupBy(F.col(label).cast("int")).count().collect()}
    if len(counts) < 2:
        return None
    if metric == "squared":
        return ClusteringEvaluator(predictionCol=label, featuresCol=features).evaluate(pred)
    labels = sorted(counts)
    rows = materialize_small(pred.select(F.col(label).cast("int").alias("label"), vector_to_array(features).alias("v")))
    rows = rows.withColumn("id", F.monotonically_increasing_id())  # of written rows: the same in every job
    n, d = sum(counts.values()), rows.select(F.size("v")).first()[0]
    shards = max(2 * rows.sparkSession.sparkContext.defaultParallelism, math.ceil(n / shard_rows))
    kinds = lambda shard, asked: rows.select(shard.alias("shard"), F.lit(asked).alias("asked"), "id", "label", "v")
    met = (kinds(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"), False)
           .unionByName(kinds(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))), True))
           .repartition(shards, "shard").sortWithinPartitions("shard", "asked"))

    def sums(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, x, of = [], None, None
        for b in batches:  # the shard's rows first, then all rows
            v = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            ids, label_ = b.column("id").to_numpy(), b.column("label").to_numpy()
            n_held = b.num_rows - b.column("asked").true_count
            if n_held:
                seen.append((ids[:n_held], label_[:n_held], v[:n_held]))
            if n_held < b.num_rows and seen:
                if x is None:
                    own, held, x = (np.concatenate(c) for c in zip(*seen))
                    of = (held[:, None] == np.array(labels)).astype(np.float64)
                for lo in range(n_held, b.num_rows, 256):
                    q = v[lo:min(lo + 256, b.num_rows)]
                    dist = np.sqrt(sum((q[:, j, None] - x[None, :, j]) ** 2 for j in range(d)))
                    yield pa.record_batch({"id": pa.array(ids[lo:lo + len(q)]), "label": pa.array(label_[lo:lo + len(q)]),
                                           "s": pa.array(list(dist @ of), pa.list_(pa.float64()))})

    total = met.groupBy("shard").applyInArrow(sums, "id long, label int, s array<double>").groupBy("id", "label").agg(
        *[F.sum(F.col("s")[j]).alias(f"s{j}") for j in range(len(labels))])
    own = F.coalesce(*[F.when(F.col("label") == c, F.struct(F.col(f"s{j}").alias("s"), F.lit(counts[c]).alias("n"))) for j, c in enumerate(labels)])
    near = F.least(*[F.when(F.col("label") != c, F.col(f"s{j}") / F.lit(counts[c])) for j, c in enumerate(labels)])
    a = F.col("own.s") / (F.col("own.n") - 1)
    width = F.when(F.col("own.n") > 1, F.coalesce(F.try_divide(F.col("near") - a, F.greatest("near", a)), F.lit(0.0))).otherwise(F.lit(0.0))
    return total.withColumns({"own": own, "near": near}).agg(F.avg(width)).first()[0]


# ---------------------------------------------------------------- M8
def _c(n: float) -> float:
    """Average path length of an unsuccessful BST search over n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


def _grow(cols, psi, seed):
    limit = int(math.ceil(math.log2(max(psi, 2))))

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        rng = np.random.default_rng(seed * 100003 + tree)
        X = pdf[cols].to_numpy(dtype="float64")
        nodes = []  # node, feature, threshold, left, right, path length of a row that ends here

        def build(idx, depth):
            nid = len(nodes)
            nodes.append([nid, -1, 0.0, -1, -1, depth + _c(len(idx))])
            if depth >= limit or len(idx) <= 1:
                return nid
            sub = X[idx]
            lo, hi = sub.min(axis=0), sub.max(axis=0)
            usable = np.nonzero(hi > lo)[0]
            if len(usable) == 0:
                return nid
            f = int(rng.choice(usable))
            thr = float(rng.uniform(lo[f], hi[f]))
            left = idx[sub[:, f] < thr]
            right = idx[sub[:, f] >= thr]
            nodes[nid][1], nodes[nid][2] = f, thr
            nodes[nid][3] = build(left, depth + 1)
            nodes[nid][4] = build(right, depth + 1)
            return nid
        build(np.arange(len(X)), 0)
        out = pd.DataFrame(nodes, columns=["node", "feature", "threshold", "left", "right",
                                           "path"])
        out.insert(0, "tree", tree)
        return out
    return fn


def _score(cols, forest_bc, psi: int):
    cn = _c(psi) or 1.0  # every tree has psi rows at its root

    def fn(batches):
        forest = forest_bc.value
        trees = []
        for _, t in forest.sort_values(["tree", "node"]).groupby("tree"):
            trees.append({k: t[k].to_numpy() for k in ["feature", "threshold", "left", "right", "path"]})
        for pdf in batches:
            X = pdf[cols].to_numpy(dtype="float64")
            total = np.zeros(len(X))
            for t in trees:
                node = np.zeros(len(X), dtype=np.int64)
                active = t["feature"][node] >= 0
                while active.any():
                    f = t["feature"][node[active]]
                    go_left = X[active, f] < t["threshold"][node[active]]
                    node[active] = np.where(go_left, t["left"][node[active]], t["right"][node[active]])
                    active = t["feature"][node] >= 0
                total += t["path"][node]
            eh = total / len(trees)
            out = pdf[["Ticker", "Date"]].copy()
            out["anomaly_score"] = np.power(2.0, -eh / cn)
            yield out
    return fn


def tree_samples(d: DataFrame, cols: list[str], trees: int, psi: int, n: int, seed: int) -> DataFrame:
    """(tree, cols): ``psi`` of the ``n`` rows for every tree, drawn without
    replacement and independently of the other trees."""
    grid = 1 << 30
    share = min(1.0, (psi + 6.0 * math.sqrt(psi)) / max(n, 1))  # six deviations above psi
    draw = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(
        t.alias("tree"), F.pmod(F.xxhash64("Ticker", "Date", t, F.lit(seed)), F.lit(grid)).alias("u")))
    hits = d.select(*cols, F.explode(F.filter(draw, lambda x: x["u"] < int(share * grid))).alias("_x"),
                    F.xxhash64("Ticker", "Date").alias("_k"))
    w = Window.partitionBy("_x.tree").orderBy("_x.u", "_k")
    return (hits.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= psi)
            .select(F.col("_x.tree").alias("tree"), *cols))


def isolation_scores(d: DataFrame, features=tuple(UNSUPERVISED_FEATURES), trees: int = 100,
                     psi: int = 256, contamination: float = 0.02, seed: int = 42) -> DataFrame:
    """Anomaly score per (Ticker, Date) and the flag of the ``contamination``
    highest (the row key must be unique)."""
    cols = list(features)
    n = d.count()
    psi = int(min(psi, n))
    samp = tree_samples(d, cols, trees, psi, n, seed)
    schema = "tree int, node long, feature long, threshold double, left long, right long, path double"
    forest = samp.groupBy("tree").applyInPandas(_grow(cols, psi, seed), schema).toPandas()
    # the forest is bounded by trees * (2 psi - 1) nodes whatever the data size
    bc = d.sparkSession.sparkContext.broadcast(forest)
    # read by the quantile and by the result: score once
    scored = materialize_small(d.select("Ticker", "Date", *cols).mapInPandas(
        _score(cols, bc, psi), "Ticker string, Date date, anomaly_score double"))
    ranked = global_index(scored, [F.col("anomaly_score").desc(), F.col("Ticker"), F.col("Date")], "_rank")
    return ranked.withColumn("is_anomaly", F.col("_rank") < F.lit(math.floor(round(n * contamination, 6)))).drop("_rank")


# ---------------------------------------------------------------- M9
def pca_summary(d: DataFrame, features=tuple(UNSUPERVISED_FEATURES), target: float = 0.95):
    """Explained variance ratio per component with the cumulative share, the
    number of components reaching ``target``, and PC1 loadings."""
    p = len(features)
    model = PCA(k=p, inputCol="features", outputCol="pcs").fit(d)
    ratios = [float(x) for x in model.explainedVariance.toArray()]
    spark = d.sparkSession
    comp = spark.createDataFrame([(i + 1, r) for i, r in enumerate(ratios)], "component int, ratio double")
    comp = comp.withColumn("cum", F.sum("ratio").over(Window.orderBy("component").rowsBetween(
        Window.unboundedPreceding, 0)))
    n95 = comp.filter(F.col("cum") >= target).agg(F.min("component")).first()[0]
    comp = comp.withColumn("n_for_target", F.lit(n95))
    pc1 = model.pc.toArray()[:, 0]
    loadings = spark.createDataFrame([(f, float(v)) for f, v in zip(features, pc1)],
                                     "feature string, loading double")
    return comp, loadings


# ---------------------------------------------------------------- M14
def fit_states(d: DataFrame, k: int = 4, seed: int = 42):
    """Gaussian mixture: state label, per-state probabilities, the mean
    log-likelihood (MLlib reports the total) and the silhouette of the states."""
    gm = GaussianMixture(k=k, seed=seed, maxIter=100, tol=0.001).fit(d)
    n = gm.summary.cluster.count()
    mean_ll = gm.summary.logLikelihood / max(n, 1)
    states = gm.transform(d)
    sil = silhouette(states, "prediction")
    out = states.withColumn("_p", vector_to_array("probability"))
    out = out.select("Ticker", "Date", F.col("prediction").cast("int").alias("state"),
                     *[F.col("_p")[i].alias(f"State_{i}") for i in range(k)])
    return out, mean_ll, sil
