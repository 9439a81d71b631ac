"""Gradient boosting that can go on: own rounds over histogram trees (M5, M6).

Features are cut at their quantiles once; rows then live in cached blocks of bins
with their margin. A round draws rows and columns by hash, grows one tree on the
residuals, adds it to the margins and measures the error on the validation rows,
all in one pass where the rows lie; patience ends the run, and nothing is fitted
twice. The model is the trees of the best round.

A tree asks for histograms of its open nodes only: of the smaller set of nodes
whose parents it knows, the siblings following by subtraction. While the rows
fill one block, the grower runs beside them; with more blocks it runs on the
driver and each question is a Spark job that sums the blocks' histograms. Both
ways grow the same tree. Growth is leaf-wise (best gain first, up to ``leaves``)
or by levels up to ``depth``.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwise.operators.trees import Tree, best_split, binned, histogram, quantile_edges, uniform
from barwise.session import ensure_checkpoint_dir

BINS = 255
BLOCK_ROWS = 50_000
#: rounds after which the margins are written and the lineage is cut
CUT_EVERY = 50


@dataclass(frozen=True)
class Preset:
    """``least``: rows of a leaf; ``penalty``: L2 on leaf values; a new sample of
    rows every ``every`` rounds."""
    rate: float = 0.05
    leaves: int | None = None
    depth: int | None = None
    columns: float = 1.0
    rows: float = 1.0
    every: int = 1
    least: float = 1.0
    penalty: float = 0.0


# fixed values of the three booster presets
PRESETS = {
    "leafwise": Preset(leaves=31, columns=0.9, rows=0.8, every=5, least=20.0),
    "depthwise": Preset(depth=6, columns=0.8, rows=0.8, penalty=1.0),
    "app": Preset(depth=6, penalty=1.0),
}


@dataclass
class Block:
    """Rows of one block: bins, label, row hash, validation flag, margin."""
    bins: np.ndarray
    y: np.ndarray
    h: np.ndarray
    valid: np.ndarray
    margin: np.ndarray
    tree: Tree | None = None

    def drawn(self, preset: Preset, round_: int, seed: int) -> np.ndarray:
        if preset.rows >= 1:
            return ~self.valid
        return ~self.valid & (uniform(self.h, seed * 1_000_003 + round_ // preset.every) < preset.rows)

    def histogram(self, tree: Tree, nodes: list[int], width: int, use: np.ndarray) -> np.ndarray:
        table = np.full(len(tree.feature), -1)
        table[nodes] = range(len(nodes))
        slot = np.where(use, table[tree.leaves(self.bins)], -1)
        return histogram(self.bins, slot, len(nodes), width, np.ones(len(self.y)), self.y - self.margin)

    def grown(self, tree: Tree) -> "Block":
        return Block(self.bins, self.y, self.h, self.valid, self.margin + tree.predict(self.bins), tree)

    def error(self) -> tuple[float, int]:
        return float(np.abs(self.y - self.margin)[self.valid].sum()), int(self.valid.sum())


def grow(ask: Callable[[Tree, list[int]], np.ndarray], preset: Preset, columns: np.ndarray | None) -> Tree:
    """One tree over bins (x <= threshold compares bins). ``ask(tree, nodes)``
    gives the histograms of leaves of the tree as grown so far.

    Nodes are split ahead wherever the finished tree could split them, a batch a
    question; the tree returned has the splits that growing one best leaf at a
    time would have made."""
    full = Tree()
    root = full.add()
    hist = {root: ask(full, [root])[0]}
    splits: dict[int, tuple[float, int, int]] = {}
    level = {root: 0}
    while True:
        wanted, out = [], []
        heap: list[tuple[float, int]] = []

        def offer(n: int) -> None:
            if n not in splits:
                deep = preset.depth is not None and level[n] >= preset.depth
                splits[n] = (-math.inf, 0, 0) if deep else best_split(hist[n], preset.least, preset.penalty, columns)
            if splits[n][0] > 1e-12:
                heapq.heappush(heap, (-splits[n][0], n))

        offer(root)
        count = 1
        while heap and (preset.leaves is None or count < preset.leaves):
            _, n = heapq.heappop(heap)
            count += 1
            out.append(n)
            if full.feature[n] < 0:
                wanted.append(n)
                continue
            for c in (full.left[n], full.right[n]):
                offer(c)
        if not wanted:
            return _pruned(full, set(out), hist, preset)
        for n in wanted:
            _, f, cell = splits[n]
            for c in full.split(n, f, float(cell)):
                level[c] = level[n] + 1
        known = ask(full, [full.left[n] for n in wanted])
        for n, h in zip(wanted, known):
            hist[full.left[n]], hist[full.right[n]] = h, hist[n] - h


def _pruned(full: Tree, kept: set[int], hist: dict, preset: Preset) -> Tree:
    """The tree of the kept splits, with shrunken leaf values."""
    out = Tree()

    def value(n: int) -> float:
        w, s = hist[n][0].sum(axis=0)
        return preset.rate * s / (w + preset.penalty) if w + preset.penalty > 0 else 0.0

    todo = [(0, out.add(value(0)))]
    while todo:
        n, at = todo.pop()
        if n in kept:
            pair = out.split(at, full.feature[n], full.threshold[n])
            for child, own in zip((full.left[n], full.right[n]), pair):
                out.value[own] = value(child)
                todo.append((child, own))
    return out


@dataclass
class Booster:
    base: float
    edges: list[np.ndarray]
    trees: list[Tree]
    #: validation error after each round (empty without validation rows)
    errors: list[float] = field(default_factory=list)

    def predict(self, x: np.ndarray) -> np.ndarray:
        cells, out = binned(x, self.edges), np.full(len(x), self.base)
        for t in self.trees:
            out += t.predict(cells)
        return out

    def transform(self, df: DataFrame, features="features", name="prediction") -> DataFrame:
        """``df`` with predictions; the trees (their number is a parameter) go out
        with the tasks."""
        d = len(self.edges)

        @F.arrow_udf("double")
        def predicted(x: pa.Array) -> pa.Array:
            return pa.array(self.predict(x.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)))

        return df.withColumn(name, predicted(vector_to_array(features)))


def boost(train: DataFrame, valid: DataFrame | None, preset: Preset, rounds: int, patience: int | None = None, seed: int = 42,
          label="label", features="features", key: tuple[str, ...] = ("Ticker", "Date"), block_rows: int = BLOCK_ROWS) -> Booster:
    """Boosted trees of ``train``: ``rounds`` rounds, or until the mean absolute
    error on ``valid`` has not improved for ``patience`` rounds; the trees up to
    the best round stay. ``features`` is a vector column, ``key`` identifies a
    row in the draws. An empty ``train`` gives a model that predicts 0."""
    def narrow(df: DataFrame, is_valid: bool) -> DataFrame:
        return df.select(F.xxhash64(*key).alias("h"), vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y"),
                         F.lit(is_valid).alias("v"))

    rows = narrow(train, False)
    about = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean"), F.max(F.size("x")).alias("d")).first()
    if not about.n:
        return Booster(0.0, [np.zeros(0)] * 0, [])
    edges = quantile_edges(rows, "x", about.d, BINS)
    width = max(len(e) for e in edges) + 1
    if valid is not None:
        rows = rows.unionByName(narrow(valid, True))
    ensure_checkpoint_dir(train.sparkSession)
    parts = max(1, math.ceil(about.n / block_rows))

    def pack(part):
        part = list(part)
        if not part:
            return
        x = np.array([r.x for r in part], np.float64).reshape(len(part), -1)
        yield Block(binned(x, edges).astype(np.uint8), np.array([r.y for r in part]), np.array([r.h for r in part], np.int64),
                    np.array([r.v for r in part], bool), np.full(len(part), about["mean"]))

    # one block a partition; cached, as every round reads all of them
    state = rows.repartition(parts, "h").rdd.mapPartitions(pack).persist(StorageLevel.MEMORY_AND_DISK)
    alone = parts == 1
    model, best = Booster(float(about["mean"]), edges, []), math.inf
    for r in range(rounds):
        columns = _columns(about.d, preset.columns, seed, r)
        before = state
        if alone:
            state = before.map(lambda b, r=r, c=columns: b.grown(_grow_beside(b, preset, r, seed, c, width)))
        else:
            def ask(tree: Tree, nodes: list[int], r=r) -> np.ndarray:
                return before.map(lambda b: b.histogram(tree, nodes, width, b.drawn(preset, r, seed))).treeReduce(np.add)

            tree = grow(ask, preset, columns)
            state = before.map(lambda b, t=tree: b.grown(t))
        state = state.persist(StorageLevel.MEMORY_AND_DISK)
        if r % CUT_EVERY == CUT_EVERY - 1:
            state.checkpoint()
        if alone:
            (error, n, tree), = state.map(lambda b: (*b.error(), b.tree)).collect()
        else:
            error, n = state.map(lambda b: b.error()).treeReduce(lambda a, b: (a[0] + b[0], a[1] + b[1]))
        before.unpersist()
        model.trees.append(tree)
        if n:
            model.errors.append(error / n)
            best = min(best, model.errors[-1])
            if patience and r - model.errors.index(best) >= patience:
                break
    state.unpersist()
    if model.errors:
        model.trees = model.trees[:model.errors.index(best) + 1]
    return model


def _grow_beside(b: Block, preset: Preset, r: int, seed: int, columns: np.ndarray | None, width: int) -> Tree:
    use = b.drawn(preset, r, seed)
    return grow(lambda tree, nodes: b.histogram(tree, nodes, width, use), preset, columns)


def _columns(d: int, share: float, seed: int, round_: int) -> np.ndarray | None:
    if share >= 1:
        return None
    out = np.zeros(d, bool)
    out[np.random.default_rng([seed, round_]).permutation(d)[:max(1, round(share * d))]] = True
    return out
