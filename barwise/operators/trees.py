"""Regression trees: exact growth in a task, and a forest grown to purity (M4).

The forest is hybrid. While a node of a tree holds more than ``task_rows`` rows,
it is split by Spark: tasks sum histograms over quantile bins for all open nodes
of all trees, the sums meet by node, and only the chosen splits reach the driver.
A node with fewer rows is finished in one group: its rows are sent there and the
subtree is grown exactly (all thresholds) until its leaves are pure, without a
limit of depth. The rows to predict are routed to the same groups, so the trees
never leave their tasks. While no node is split the trees of a forest share their
rows, and a group grows a batch of them.

Bootstrap: a row's weight in a tree is a Poisson(1) draw from a hash of its key,
the same in every attempt of a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TASK_ROWS = 50_000
TOP_BINS = 64
#: nodes whose histograms a task holds at a time
SLOTS = 4_096
#: chances that a Poisson(1) draw is at most 0, 1, 2, ...
POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(20)])


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalising bit mixer over uint64 (wraps around)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(h: np.ndarray, salt: int) -> np.ndarray:
    """A number in [0, 1) for each row hash, another one for each salt."""
    start = np.uint64(((salt + 1) * 0x9E3779B97F4A7C15) % (1 << 64))
    return (mix64(h.view(np.uint64) ^ mix64(np.array([start]))) >> np.uint64(11)) * 2.0 ** -53


class Tree:
    """Nodes as arrays; a leaf has feature -1. x <= threshold goes left."""

    def __init__(self):
        self.feature, self.threshold, self.left, self.right, self.value = [], [], [], [], []

    def add(self, value: float = 0.0) -> int:
        for column, v in ((self.feature, -1), (self.threshold, 0.0), (self.left, -1), (self.right, -1), (self.value, value)):
            column.append(v)
        return len(self.feature) - 1

    def split(self, node: int, feature: int, threshold: float) -> tuple[int, int]:
        self.feature[node], self.threshold[node] = feature, threshold
        self.left[node], self.right[node] = self.add(), self.add()
        return self.left[node], self.right[node]

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        feature, threshold = np.array(self.feature), np.array(self.threshold)
        left, right = np.array(self.left), np.array(self.right)
        at, go = np.zeros(len(x), np.int64), np.arange(len(x))
        while len(go := go[feature[at[go]] >= 0]):
            n = at[go]
            at[go] = np.where(x[go, feature[n]] <= threshold[n], left[n], right[n])
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaves(x)]


def grow_exact(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> Tree:
    """A tree of least squared error grown until every leaf is pure in ``y`` or
    equal in ``x``; thresholds lie midway between neighbouring values. All nodes
    of a level are split together: rows stay sorted by (node, value) a feature."""
    keep = np.flatnonzero(w > 0)
    x, y, w = x[keep], y[keep], w[keep].astype(np.float64)
    tree = Tree()
    if not len(y):
        tree.add(float("nan"))
        return tree
    shift = float(np.average(y, weights=w))
    y = y - shift
    rounding = 1e-12 * float(y @ y) / len(y)
    tree.add(shift)
    order = np.argsort(x, axis=0, kind="stable").T.copy()  # features x rows
    node, ids = np.zeros(len(y), np.int64), np.array([0])
    while True:
        m = order.shape[1]
        own = node[order[0]]
        starts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        sizes = np.diff(np.append(starts, m))
        seg = np.repeat(np.arange(len(starts)), sizes)
        wo, yo = w[order], y[order]
        cw, cs = np.cumsum(wo, axis=1), np.cumsum(wo * yo, axis=1)
        tail = starts + sizes - 1
        base_w, base_s = (np.where(starts > 0, c[0][starts - 1], 0.0) for c in (cw, cs))
        tot_w, tot_s = cw[0][tail] - base_w, cs[0][tail] - base_s
        # sums start anew a feature: each has its own rounding
        lw, ls = cw - (cw[:, tail] - tot_w)[:, seg], cs - (cs[:, tail] - tot_s)[:, seg]
        rw, rs = tot_w[seg] - lw, tot_s[seg] - ls
        xo = np.take_along_axis(x, order.T, axis=0).T
        can = np.ones(xo.shape, bool)
        can[:, :-1] = xo[:, 1:] > xo[:, :-1]
        can[:, tail] = False
        with np.errstate(divide="ignore", invalid="ignore"):
            score = np.where(can, ls * ls / lw + rs * rs / rw, -np.inf)
        top = np.maximum.reduceat(score, starts, axis=1)
        best = top.max(axis=0)
        # splits alike up to rounding: the first feature, the least threshold
        near = best - 1e-10 * np.abs(best) - rounding
        feature = (top >= near).argmax(axis=0)
        spread = np.maximum.reduceat(yo[0], starts) - np.minimum.reduceat(yo[0], starts)
        for s, n in enumerate(ids):
            tree.value[n] = shift + tot_s[s] / tot_w[s]
        go = np.isfinite(best) & (spread > 0)
        if not go.any():
            return tree
        hit = score[feature[seg], np.arange(m)] >= near[seg]
        first = np.minimum.reduceat(np.where(hit, np.arange(m), m), starts)
        new_ids, child = [], np.full((len(starts), 2), -1)
        cut = np.zeros(len(starts))
        for s in np.flatnonzero(go):
            f, i = feature[s], first[s]
            low, high = xo[f, i], xo[f, i + 1]
            cut[s] = mid if low <= (mid := low + (high - low) / 2) < high else low
            child[s] = len(new_ids), len(new_ids) + 1
            new_ids += tree.split(int(ids[s]), int(f), float(cut[s]))
        rows = order[0]
        right = x[rows, feature[seg]] > cut[seg]
        node[rows] = child[seg, right.astype(np.int64)]
        order = order[:, node[order[0]] >= 0] if go.all() else order[np.where(node[order] >= 0)].reshape(len(order), -1)
        order = np.take_along_axis(order, np.argsort(node[order], axis=1, kind="stable"), axis=1)
        ids = np.array(new_ids)


def quantile_edges(df: DataFrame, column: str, d: int, bins: int) -> list[np.ndarray]:
    """At most ``bins`` - 1 edges a feature of an array column: its quantiles."""
    probs = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    row = df.agg(*[F.percentile_approx(F.col(column)[j], probs, 20_000).alias(f"q{j}") for j in range(d)]).first()
    return [np.unique(np.array(q if q is not None else [], np.float64)) for q in row]


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bin of each value: the first edge that is not below it."""
    return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1).astype(np.int32)


def histogram(bins: np.ndarray, slot: np.ndarray, slots: int, width: int, w: np.ndarray, s: np.ndarray) -> np.ndarray:
    """(slots, features, width, 2): sums of ``w`` and ``s`` by slot and bin; rows
    with slot -1 are left out."""
    use = np.flatnonzero(slot >= 0)
    d = bins.shape[1]
    at = ((slot[use, None] * d + np.arange(d)) * width + bins[use]).ravel()
    n = slots * d * width
    return np.stack([np.bincount(at, np.repeat(v[use], d), n) for v in (w, s)], axis=1).reshape(slots, d, width, 2)


def best_split(hist: np.ndarray, least: float = 1.0, penalty: float = 0.0,
               columns: np.ndarray | None = None) -> tuple[float, int, int]:
    """(gain, feature, bin) of one node's histogram (features, width, 2); gain
    -inf where no split leaves ``least`` weight on both sides."""
    left = np.cumsum(hist, axis=1)
    total = left[:, -1:, :]
    right = total - left
    n, s = total[0, 0]
    ok = (left[..., 0] >= least) & (right[..., 0] >= least)
    if columns is not None:
        ok &= columns[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        score = left[..., 1] ** 2 / (left[..., 0] + penalty) + right[..., 1] ** 2 / (right[..., 0] + penalty)
    score = np.where(ok, score - s * s / (n + penalty), -np.inf)
    f, b = np.unravel_index(int(score.argmax()), score.shape)
    return float(score[f, b]), int(f), int(b)


# ---------------------------------------------------------------- the forest
def _blocks(df: DataFrame, label: str | None, features: str, key: list[str]) -> DataFrame:
    """Rows packed a batch at a time: h (two hashes of the key), x, y as bytes."""
    cols = [F.xxhash64(*key).alias("h"), F.xxhash64(F.lit("second"), *key).alias("g"),
            vector_to_array(features).alias("x"), (F.col(label).cast("double") if label else F.lit(0.0)).alias("y")]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                h = np.stack([b.column("h").to_numpy(), b.column("g").to_numpy()], axis=1)
                x = b.column("x").flatten().to_numpy(zero_copy_only=False)
                yield pa.record_batch({"n": pa.array([b.num_rows], pa.int32()), "h": pa.array([h.tobytes()], pa.binary()),
                                       "x": pa.array([x.tobytes()], pa.binary()), "y": pa.array([b.column("y").to_numpy(zero_copy_only=False).tobytes()], pa.binary())})

    return df.select(*cols).mapInArrow(pack, "n int, h binary, x binary, y binary")


def _unpacked(b: pa.RecordBatch | pa.Table, d: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for h, x, y in zip(*(b.column(c).to_pylist() for c in ("h", "x", "y"))):
        yield np.frombuffer(h, np.int64).reshape(-1, 2), np.frombuffer(x).reshape(-1, d), np.frombuffer(y)


def weights(h: np.ndarray, tree: int, seed: int, bootstrap: bool) -> np.ndarray:
    if not bootstrap:
        return np.ones(len(h))
    return np.searchsorted(POISSON, uniform(h[:, 0], seed * 1_000_003 + tree), side="right").astype(np.float64)


def _top_splits(blocks: DataFrame, d: int, edges: list[np.ndarray], trees: int, task_rows: int, seed: int,
                bootstrap: bool) -> list[Tree]:
    """Tree tops whose leaves hold at most ``task_rows`` weight each."""
    tops = [Tree() for _ in range(trees)]
    width = max(len(e) for e in edges) + 1
    todo = [(t, top.add()) for t, top in enumerate(tops)]
    while todo:
        now, todo, nodes = todo[:SLOTS], todo[SLOTS:], []
        slots: dict[int, dict[int, int]] = {}
        for i, (t, n) in enumerate(now):
            slots.setdefault(t, {})[n] = i
        so_far = {t: tops[t] for t in slots}

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            acc = np.zeros((len(now), d, width, 2))
            for b in batches:
                for h, x, y in _unpacked(b, d):
                    cells = binned(x, edges)
                    for t, own in slots.items():
                        table = np.full(len(so_far[t].feature), -1)
                        table[list(own)] = range(len(own))
                        w = weights(h, t, seed, bootstrap)
                        acc[list(own.values())] += histogram(cells, table[so_far[t].leaves(x)], len(own), width, w, w * y)
            yield pa.record_batch({"slot": pa.array(range(len(now)), pa.int32()),
                                   "v": pa.array(list(acc.reshape(len(now), -1)), pa.list_(pa.float64()))})

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = []
                for slot, v in zip(b.column("slot").to_pylist(), b.column("v").to_pylist()):
                    hist = np.array(v).reshape(d, width, 2)
                    gain, f, cell = best_split(hist)
                    heavy = hist[0, :, 0].sum() > task_rows and gain > 0
                    found.append((slot, f if heavy else -1, float(edges[f][cell]) if heavy else 0.0))
                yield pa.record_batch([pa.array(c) for c in zip(*found)] if found else [[], [], []], names=["slot", "f", "cut"])

        met = (blocks.mapInArrow(sums, "slot int, v array<double>").groupBy("slot")
               .agg(Summarizer.sum(array_to_vector("v")).alias("v")).withColumn("v", vector_to_array("v")))
        for r in met.mapInArrow(choose, "slot long, f long, cut double").collect():
            if r.f >= 0:
                t, n = now[r.slot]
                nodes += [(t, c) for c in tops[t].split(n, r.f, r.cut)]
        todo += sorted(nodes)
    return tops


def forest_predict(train: DataFrame, rows: DataFrame, trees: int = 300, seed: int = 42, label="label", features="features",
                   key: tuple[str, ...] = ("Ticker", "Date"), task_rows: int = TASK_ROWS, bootstrap: bool = True,
                   name="prediction") -> DataFrame:
    """``rows`` with the mean prediction of ``trees`` fully grown trees fitted on
    ``train``; ``features`` is a vector column, ``key`` identifies a row. Every
    split may use every feature. With an empty ``train`` predictions are null."""
    key = list(key)
    packed = _blocks(train, label, features, key).persist()
    try:
        n = packed.agg(F.sum("n")).first()[0] or 0
        if not n:
            return rows.withColumn(name, F.lit(None).cast("double"))
        first = train.select(F.size(vector_to_array(features)).alias("d")).first()
        d = first.d
        arrays = train.select(vector_to_array(features).alias("x"))
        if n > task_rows:
            tops = _top_splits(packed, d, quantile_edges(arrays, "x", d, TOP_BINS), trees, task_rows, seed, bootstrap)
            units = {(t, leaf): i for i, (t, leaf) in enumerate(
                (t, leaf) for t, top in enumerate(tops) for leaf, f in enumerate(top.feature) if f < 0)}
        else:
            tops, units = None, {}
        batches_of = max(1, min(trees, 4 * train.sparkSession.sparkContext.defaultParallelism))
    finally:
        packed.unpersist()

    def route(kind: int):
        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for h, x, y in _unpacked(b, d):
                    parts: list[tuple[int, np.ndarray]] = []
                    if tops is None:
                        parts = [(u, np.arange(len(h))) for u in range(batches_of)]
                    else:
                        for t, top in enumerate(tops):
                            leaf = top.leaves(x)
                            keep = np.flatnonzero(weights(h, t, seed, bootstrap) > 0) if kind == 0 else np.arange(len(h))
                            parts += [(units[t, int(v)], keep[leaf[keep] == v]) for v in np.unique(leaf[keep])]
                    for u, at in parts:
                        yield pa.record_batch({
                            "unit": pa.array([u], pa.int32()), "kind": pa.array([kind], pa.int32()),
                            "h": pa.array([h[at].tobytes()], pa.binary()), "x": pa.array([x[at].tobytes()], pa.binary()),
                            "y": pa.array([y[at].tobytes()], pa.binary())})
        return deal

    of_unit = {u: t for (t, _), u in units.items()}

    def finish(unit: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, seen, grown = unit[0].as_py(), [], None
        for b in batches:  # the unit's train rows first, then the rows to predict
            for at, kind in enumerate(b.column("kind").to_pylist()):
                (h, x, y), = _unpacked(b.slice(at, 1), d)
                if kind == 0:
                    seen.append((h, x, y))
                    continue
                if grown is None:
                    grown = _grow_unit(seen, range(u, trees, batches_of) if tops is None else [of_unit[u]], seed, bootstrap)
                    seen = []
                total = np.zeros(len(h))
                for tree in grown:
                    total += tree.predict(x)
                yield pa.record_batch({"h": pa.array(h[:, 0]), "g": pa.array(h[:, 1]), "p": pa.array(total),
                                       "t": pa.array(np.full(len(h), len(grown), np.int32))})

    kinds = "unit int, kind int, h binary, x binary, y binary"
    met = (_blocks(train, label, features, key).mapInArrow(route(0), kinds)
           .unionByName(_blocks(rows, None, features, key).mapInArrow(route(1), kinds))
           .repartition("unit").sortWithinPartitions("unit", "kind"))
    said = (met.groupBy("unit").applyInArrow(finish, "h long, g long, p double, t int")
            .groupBy("h", "g").agg((F.sum("p") / F.sum("t")).alias(name)))
    asked = rows.withColumns({"_h": F.xxhash64(*key), "_g": F.xxhash64(F.lit("second"), *key)})
    return asked.join(said, (F.col("_h") == F.col("h")) & (F.col("_g") == F.col("g")), "left").drop("_h", "_g", "h", "g")


def _grow_unit(seen: list, own_trees, seed: int, bootstrap: bool) -> list[Tree]:
    h, x, y = (np.concatenate(c) for c in zip(*seen))
    order = np.lexsort((y, *x.T[::-1], h[:, 0]))  # not as the rows arrived
    h, x, y = h[order], x[order], y[order]
    return [grow_exact(x, y, weights(h, t, seed, bootstrap)) for t in own_trees]
