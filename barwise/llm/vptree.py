"""Approximate nearest neighbours by a vantage-point tree per shard.

Vectors are dealt to shards by id. A task builds the tree of its shard once and
takes the stated queries through it block by block as they stream past. A leaf is
skipped when the triangle inequality at a vantage point above it puts it farther
than ``factor`` times the distance of the k-th neighbour found so far; factor one
is exact, a smaller one skips more. The k best of each shard meet in a final ranking.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barwise.llm.common import table

LEAF = 64
OUT = "query_id long, vec_id long, score double"
SLACK = 1e-12
#: relative error that a distance by products may have
ROUNDING = 1e-9


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, summed in component order."""
    acc = np.zeros((len(q), len(x)))
    for j in range(q.shape[1]):
        t = q[:, j, None] - x[None, :, j]
        acc += t * t
    return np.sqrt(acc)


class Tree:
    """Nodes are index ranges of a permutation of the vectors: the first is the
    vantage point, the nearer half of the rest is the inner child. Ranges of at
    most ``LEAF`` vectors are leaves."""

    def __init__(self, x: np.ndarray, ids: np.ndarray):
        order = np.arange(len(x))
        #: (vantage point, radius, parent, in its inner half) of each inner node
        self.nodes: list[tuple[int, float, int, bool]] = []
        #: (start, end, parent, in its inner half) of each leaf
        self.leaves: list[tuple[int, int, int, bool]] = []
        stack = [(0, len(x), -1, True)]
        while stack:
            lo, hi, parent, inner = stack.pop()
            if hi - lo <= LEAF:
                self.leaves.append((lo, hi, parent, inner))
                continue
            own = order[lo:hi]
            # the point farthest from the range's first point sees the rest under spread-out distances
            far = int(np.argmax(((x[own] - x[own[0]]) ** 2).sum(axis=1)))
            own[0], own[far] = own[far], own[0]
            d = distances(x[own[:1]], x[own[1:]])[0]
            by = np.argsort(d, kind="stable")
            own[1:] = own[1:][by]
            mid = (hi - lo - 1) // 2
            n = len(self.nodes)
            self.nodes.append((lo, float(d[by[mid]]), parent, inner))
            stack += [(lo + 1, lo + 1 + mid, n, True), (lo + 1 + mid, hi, n, False)]
        self.x, self.ids = x[order], ids[order]
        with np.errstate(over="ignore"):
            self.x2 = (self.x * self.x).sum(axis=1)

    def bounds(self, d: np.ndarray) -> np.ndarray:
        """Least distance (leaves x queries) that the triangle inequality leaves a
        query to the vectors of a leaf, from its distances to the vantage points."""
        low = np.zeros((len(self.nodes) + 1, d.shape[0]))  # the last row: no parent

        def of(parent: int, inner: bool) -> np.ndarray:
            if parent < 0:
                return low[-1]
            gap = d[:, parent] - self.nodes[parent][1]
            return np.maximum(low[parent], gap if inner else -gap)

        for n, (_, _, parent, inner) in enumerate(self.nodes):  # a parent comes before its children
            low[n] = of(parent, inner)
        return np.array([of(parent, inner) for _, _, parent, inner in self.leaves])

    def nearest(self, q: np.ndarray, own: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """(distances, ids), k of each query in order; inf and -1 where fewer. Every
        query takes its nearest leaf first, then all queries take each leaf that
        their bounds don't rule out."""
        best = np.full((len(q), k), np.inf)
        ids = np.full((len(q), k), -1, np.int64)
        with np.errstate(over="ignore"):
            q2 = (q * q).sum(axis=1)

        def offer(rows: np.ndarray, d: np.ndarray, cand: np.ndarray) -> None:
            cand = np.broadcast_to(cand, d.shape)
            all_d = np.concatenate([best[rows], np.where(cand == own[rows, None], np.inf, d)], axis=1)
            all_i = np.concatenate([ids[rows], cand], axis=1)
            all_i = np.where(np.isinf(all_d), -1, all_i)
            take = np.lexsort((all_i, all_d), axis=-1)[:, :k]
            best[rows], ids[rows] = np.take_along_axis(all_d, take, 1), np.take_along_axis(all_i, take, 1)

        def visit(rows: np.ndarray, lo: int, hi: int) -> None:
            """Exact distances of the candidates that a product doesn't show to be
            farther than the best so far."""
            with np.errstate(over="ignore", invalid="ignore"):
                size = q2[rows, None] + self.x2[None, lo:hi]
                near = size - 2 * (q[rows] @ self.x[lo:hi].T)
                far = near > best[rows, k - 1, None] ** 2 * (1 + ROUNDING) + ROUNDING * size
            some = ~far.all(axis=1)
            rows, far = rows[some], far[some]
            if not len(rows):
                return
            r, c = np.nonzero(~far)
            acc = np.zeros(len(r))
            for j in range(q.shape[1]):
                t = q[rows[r], j] - self.x[lo + c, j]
                acc += t * t
            d = np.full(far.shape, np.inf)
            d[r, c] = np.sqrt(acc)
            offer(rows, d, self.ids[lo:hi])

        vantage = np.array([n[0] for n in self.nodes], np.int64)
        d = distances(q, self.x[vantage])
        low = self.bounds(d)
        if len(vantage):
            offer(np.arange(len(q)), d, self.ids[vantage])
        home = low.argmin(axis=0)
        for n, (lo, hi, _, _) in enumerate(self.leaves):
            visit(np.flatnonzero(home == n), lo, hi)
        for n, (lo, hi, _, _) in enumerate(self.leaves):
            reach = best[:, k - 1] * factor * (1 + SLACK) + SLACK
            visit(np.flatnonzero((home != n) & (low[n] <= reach)), lo, hi)
        return best, ids


def _matrix(t: pa.Table, name: str) -> np.ndarray:
    lists = t.column(name).combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def _candidates(t: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray]:
    """One row an id (its least vector), and of equal vectors the k + 1 least
    ids: a later copy can't be among the k nearest of any query."""
    x, ids = _matrix(t, "v"), t.column("id").to_numpy()
    order = np.lexsort((*x.T[::-1], ids))
    x, ids = x[order], ids[order]
    keep = np.append(True, ids[1:] != ids[:-1])
    x, ids = x[keep], ids[keep]
    order = np.lexsort((ids, *x.T))
    x, ids = x[order], ids[order]
    new = np.append(True, (x[1:] != x[:-1]).any(axis=1))
    start = np.flatnonzero(new)
    nth = np.arange(len(x)) - start[np.cumsum(new) - 1]
    return x[nth <= k], ids[nth <= k]


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 10, factor: float = 1.0,
                       shard_rows: int = 32_768, block_rows: int = 2048,
                       id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest of each query among
    ``vectors`` of the query's length, its own id left out; ties to the smaller
    id, fewer rows where there are fewer candidates.

    Vectors that are null, empty, zero, or hold null or non-finite components
    take no part, nor do rows without an id. Of several rows of one id the one
    with the least vector counts. Empty tables give an empty result; other
    columns are not read. A task holds one shard and ``block_rows`` queries;
    very long vectors make these wider.
    """
    def usable(df: DataFrame) -> DataFrame:
        v = F.col("v")
        good = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
        return (df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
                .filter(F.col("id").isNotNull() & (F.size("v") > 0) & good & F.exists(v, lambda c: c != 0)))

    x, q = usable(vectors), usable(queries).groupBy("id").agg(F.min("v").alias("v"))
    shards = max(2 * vectors.sparkSession.sparkContext.defaultParallelism, math.ceil(x.count() / shard_rows))
    kinds = lambda shard, asked: [shard.alias("shard"), F.size("v").alias("dim"), F.lit(asked).alias("asked"), "id", "v"]
    x = x.select(*kinds(F.pmod(F.xxhash64("id", F.lit("shard")), F.lit(shards)).cast("int"), False))
    q = q.select(*kinds(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))), True))

    def search(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, tree = [], 0, None
        for b in chain(batches, [None]):  # the shard first, then the queries
            asked = b is not None and b.num_rows and b.column("asked")[b.num_rows - 1].as_py()
            for part in _by_kind(b):
                if part.column("asked")[0].as_py() and tree is None:
                    if not held:
                        return
                    tree, held, n = Tree(*_candidates(pa.Table.from_batches(held), k)), [], 0
                held.append(part)
                n += part.num_rows
            if tree is not None and held and (b is None or asked and n >= block_rows):
                t = pa.Table.from_batches(held)
                own = t.column("id").to_numpy()
                d, ids = tree.nearest(_matrix(t, "v"), own, k, factor)
                found = ids >= 0
                yield pa.record_batch({"query_id": np.repeat(own, k).reshape(-1, k)[found], "vec_id": ids[found], "score": d[found]})
                held, n = [], 0

    # a shard is sent once, every query once a shard; the tree is built once
    met = x.unionByName(q).repartition(shards, "shard", "dim").sortWithinPartitions("shard", "dim", "asked")
    found = met.groupBy("shard", "dim").applyInArrow(search, OUT)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return (found.withColumn("rank", rank).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def _by_kind(b: pa.RecordBatch | None) -> list[pa.RecordBatch]:
    """A sorted batch as its candidates and its queries, without empty parts."""
    if b is None or not b.num_rows:
        return []
    n = b.num_rows - (b.column("asked").true_count)
    return [part for part in (b.slice(0, n), b.slice(n)) if part.num_rows]


def op10_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest_neighbours(e, e.filter("vec_id % 100 = 0"), k=10, factor=1.0)


OP10_SQL = """
WITH e AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
d AS (
  SELECT q.vec_id AS query_id, x.vec_id, sqrt(list_reduce(list_transform(list_zip(q.v, x.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])), lambda a, b: a + b)) AS score
  FROM (SELECT * FROM e WHERE vec_id % 100 = 0) q JOIN e x ON x.vec_id <> q.vec_id AND len(x.v) = len(q.v)),
r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM d)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
