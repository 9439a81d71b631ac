"""Hard negatives by spanning trees of anchors.

Anchors are ordered along a direction hash, cut into blocks, and each block is
spanned by a minimum spanning tree. Candidates are dealt to shards by id; a task
holds one shard and lets the blocks stream past. Down a tree, a candidate's score
with a child lies within its score with the parent plus or minus edge length times
candidate norm. Only candidates whose interval overlaps a window of the child are
scored again; the others hand their widened interval on.

Two rounds over the same shards: first the nearest rows of the anchor's own label
(window: from the least score that the k best must have), then, for each positive,
the best rows of other labels between two shares of the positive's score.

Scores are exact integers: components are floored multiples, products are summed
in doubles while they fit 53 bits and in Python integers otherwise.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barwise.functions.ordering import global_index
from barwise.llm.common import cut, table

EXACT = 1 << 53
LONG = (1 << 63) - 1
#: relative slack of the bounds for rounding of lengths and norms
SLACK = 1e-9
#: candidates whose intervals are held at a time
SLICE = 8192
FOUND = "anchor_id long, slot int, vec_id long, score long"
_FOUND = pa.schema([("anchor_id", pa.int64()), ("slot", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _matrix(lists: pa.Array, d: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def spanning_tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, parent, length): a minimum spanning tree by Prim from row 0;
    ``order`` lists the rows so that a parent comes before its children."""
    n = len(x)
    order, parent, length = np.zeros(n, np.int64), np.full(n, -1), np.zeros(n)
    best, near, left = np.full(n, np.inf), np.full(n, -1), np.ones(n, bool)
    at = 0
    for step in range(n):
        order[step], left[at] = at, False
        parent[at], length[at] = near[at], 0.0 if near[at] < 0 else best[at]
        d = np.sqrt(((x - x[at]) ** 2).sum(axis=1))
        closer = left & (d < best)
        best[closer], near[closer] = d[closer], at
        if step + 1 < n:
            at = int(np.argmin(np.where(left, best, np.inf)))
    return order, parent, length


class Block:
    """Anchors of one block: ids, labels, vectors, their tree, and the scores of
    their positives (none in the first round)."""

    def __init__(self, ids, labels, x, positives):
        self.ids, self.labels, self.x, self.positives = ids, labels, x, positives
        self.order, self.parent, self.length = spanning_tree(x)


class Shard:
    """Candidates of one task, by label, then id: one row an id."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        order = np.lexsort((*x.T[::-1], labels, ids))
        keep = order[np.append(True, ids[order][1:] != ids[order][:-1])] if len(ids) else order
        keep = keep[np.lexsort((ids[keep], labels[keep]))]
        self.ids, self.labels, self.x = ids[keep], labels[keep], x[keep]
        self.norm = np.sqrt((self.x * self.x).sum(axis=1)) * (1 + SLACK)

    def scores(self, a: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Exact inner products with the rows ``at``."""
        rows = self.x[at]
        if not len(rows) or np.abs(rows).max() * np.abs(a).max() * len(a) < EXACT:
            return (rows @ a).astype(np.int64)
        whole = [int(c) for c in a]
        return np.array([sum(int(c) * w for c, w in zip(r, whole)) for r in rows], object)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> list[int]:
    """Positions of the ``k`` highest scores, ties to the smaller id."""
    if len(scores) > 4 * k and scores.dtype != object:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= floor)
    else:
        near = np.arange(len(scores))
    return sorted(near.tolist(), key=lambda i: (-scores[i], ids[i]))[:k]


def _at_least(low: np.ndarray, k: int) -> float:
    """A score that ``k`` rows reach for certain, from their lower bounds."""
    return float(np.partition(low, len(low) - k)[len(low) - k]) if len(low) >= k else -np.inf


def search(shard: Shard, block: Block, k: int, window: tuple[int, int, int] | None) -> Iterator[tuple[int, int, int, int]]:
    """(anchor, slot, candidate, score) of a shard's best for each anchor of a
    block. Without ``window``: the ``k`` best of the anchor's label, slot 0. With
    ``window`` (base, from, to): for each positive's slot the ``k`` best of other
    labels with from * positive <= base * score <= to * positive."""
    for lo in range(0, len(shard.ids), SLICE):
        part = slice(lo, min(lo + SLICE, len(shard.ids)))
        ids, labels, norm = shard.ids[part], shard.labels[part], shard.norm[part]
        seen: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        children = np.bincount(block.parent[block.parent >= 0], minlength=len(block.ids))
        for at in block.order.tolist():
            up, a = int(block.parent[at]), block.x[at]
            own, label = block.ids[at], block.labels[at]
            if up < 0:
                low, high = np.full(len(ids), -np.inf), np.full(len(ids), np.inf)
            else:
                reach = block.length[at] * (1 + SLACK) * norm
                low, high = seen[up][0] - reach, seen[up][1] + reach
                slack = SLACK * (np.abs(low) + np.abs(high)) + 1e-6
                low, high = low - slack, high + slack
                children[up] -= 1
                if not children[up]:
                    del seen[up]
            fit = (labels == label) & (ids != own) if window is None else labels != label
            if window is None:
                wanted = fit & (high >= _at_least(low[fit], k))
                slots = [(0, None, None)]
            else:
                base, least, most = window
                slots = [(s, -(-least * p // base), most * p // base) for s, p in block.positives[at] if most * p >= least * p]
                wanted = np.zeros(len(ids), bool)
                for _, bottom, top in slots:
                    inside = low[fit & (low >= bottom) & (high <= top)]
                    wanted |= fit & (low <= top) & (high >= max(bottom, _at_least(inside, k)))
            if up < 0 and children[at]:
                wanted[:] = True  # the root is scored in full: the bounds start there
            to_score = np.flatnonzero(wanted)
            scores = shard.scores(a, to_score + lo)
            if children[at]:
                exact = scores.astype(np.float64)
                low, high = low.copy(), high.copy()
                low[to_score], high[to_score] = exact, exact
                if scores.dtype == object:  # beyond 53 bits a double is rounded
                    low[to_score] -= np.abs(exact) * SLACK
                    high[to_score] += np.abs(exact) * SLACK
                seen[at] = low, high
            mine = fit[to_score]
            scores, own_ids = scores[mine], ids[to_score][mine]
            for s, bottom, top in slots:
                if bottom is None:
                    got, got_ids = scores, own_ids
                else:
                    inside = (scores >= bottom) & (scores <= top)
                    got, got_ids = scores[inside], own_ids[inside]
                for i in _best(got, got_ids, k):
                    yield int(own), s, int(got_ids[i]), max(-LONG - 1, min(LONG, int(got[i])))


def _usable(vectors: DataFrame, id_col: str, vec_col: str, label_col: str, scale: int) -> DataFrame:
    v = F.col("v")
    good = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
                          F.col(vec_col).cast("array<double>").alias("v"))
    return rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & good).select(
        "id", "label", F.transform(v, lambda c: _floored(c, scale)).alias("v"), F.size("v").alias("d"))


def _floored(c, scale: int):
    """floor(scale * c) as a double, held to +-1e150 so that products stay finite."""
    most = F.lit(1e150)
    x = F.least(F.greatest(c * F.lit(float(scale)), -most), most)
    return F.when(F.abs(x) < F.lit(2.0 ** 53), F.floor(x).cast("double")).otherwise(x)


def _direction(v):
    """Where the largest component lies, and its sign: near anchors mostly agree."""
    sizes = F.transform(v, lambda c: F.abs(c))
    at = F.array_position(sizes, F.array_max(sizes))
    return at * F.signum(F.element_at(v, at.cast("int")))


def hard_negatives(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3,
                   window: tuple[int, int, int] = (100, 50, 95), scale: int = 256, shard_rows: int = 65_536,
                   block_rows: int = 512, id_col: str = "vec_id", vec_col: str = "embedding",
                   label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchors`` are rows of ``vectors``. Scores are integer inner products of the
    components floor(scale * x). The ``positives`` best other rows of an anchor's
    label (fewer where there are fewer) each get the ``negatives`` best rows of
    other labels with from * positive <= base * negative <= to * positive,
    (base, from, to) = ``window``; ties go to the smaller id. A positive without
    such rows gives none; under a negative positive score the window is empty.

    Rows without an id, a label or a vector, with an empty vector or null or
    non-finite components take no part. Of several rows of one id the one with the
    least label, then vector, counts. Only vectors of one length meet. Scores
    beyond a long are held to its range. Very long vectors only make rows wider. An
    empty table gives an empty table; other columns are not read.
    """
    spark = vectors.sparkSession
    x = _usable(vectors, id_col, vec_col, label_col, scale)
    a = (_usable(anchors, id_col, vec_col, label_col, scale).groupBy("id")
         .agg(F.min(F.struct("label", "v", "d")).alias("r")).select("id", "r.*"))
    shards = max(2 * spark.sparkContext.defaultParallelism, math.ceil(x.count() / shard_rows))
    dealt = x.select(F.pmod(F.xxhash64("id", F.lit("shard")), F.lit(shards)).cast("int").alias("shard"), "d",
                     F.lit(None).cast("long").alias("block"), F.col("id").alias("ids"), F.col("label").alias("labels"), "v",
                     F.lit(None).cast("array<struct<slot:int,score:long>>").alias("slots"))
    blocks = (global_index(a.withColumn("near", _direction(F.col("v"))), ["d", "near", "id"], "at")
              .withColumn("block", F.floor(F.col("at") / block_rows)).select("id", "label", "v", "d", "block"))

    def round_of(queries: DataFrame, k: int, span: tuple[int, int, int] | None) -> DataFrame:
        sent = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "d", "block",
                              F.col("id").alias("ids"), F.col("label").alias("labels"), "v", "slots")

        def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            d, shard, pieces = key[1].as_py(), None, []
            held: list[pa.RecordBatch] = []

            def answer(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
                t = pa.Table.from_batches(rows).combine_chunks()
                lists = [[(s["slot"], s["score"]) for s in own or ()] for own in t.column("slots").to_pylist()]
                block = Block(t.column("ids").to_numpy(), t.column("labels").to_numpy(), _matrix(t.column("v").combine_chunks(), d), lists)
                found = list(zip(*search(shard, block, k, span))) or [[]] * 4
                return pa.record_batch([pa.array(c, f.type) for c, f in zip(found, _FOUND)], schema=_FOUND)

            for b in batches:  # candidates first, then block by block
                own = b.filter(pc.is_null(b.column("block")))
                if own.num_rows:
                    pieces.append((own.column("ids").to_numpy(), own.column("labels").to_numpy(), _matrix(own.column("v"), d)))
                asked = b.filter(pc.is_valid(b.column("block")))
                if not asked.num_rows:
                    continue
                if shard is None:
                    if not pieces:
                        return
                    shard = Shard(*(np.concatenate(c) for c in zip(*pieces)))
                    pieces = []
                numbers = asked.column("block").to_numpy()
                for n in np.unique(numbers):
                    if held and held[0].column("block")[0].as_py() != n:
                        yield answer(held)
                        held = []
                    held.append(asked.filter(pa.array(numbers == n)))
            if held and shard is not None:
                yield answer(held)

        met = dealt.unionByName(sent).repartition(shards, "shard", "d").sortWithinPartitions("shard", "d", F.col("block").asc_nulls_first())
        return met.groupBy("shard", "d").applyInArrow(run, FOUND)

    def ranked(found: DataFrame, k: int, *by: str) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    none = F.lit(None).cast("array<struct<slot:int,score:long>>")
    best = ranked(round_of(blocks.withColumn("slots", none), positives, None), positives, "anchor_id")
    # read by the windows and by the result: the first round runs once
    best = cut(best.select("anchor_id", F.col("rank").alias("slot"), F.col("vec_id").alias("positive_id"),
                           F.col("score").alias("positive_score")))
    slots = best.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("slot", F.col("positive_score").alias("score")))).alias("slots"))
    asked = blocks.join(slots, blocks.id == slots.anchor_id).drop("anchor_id")
    worst = ranked(round_of(asked, negatives, window), negatives, "anchor_id", "slot")
    return best.join(worst, ["anchor_id", "slot"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three negatives for each of five positives of every fiftieth row; every
    seventh row is relabelled first."""
    e = table(spark, sf_dir, "embeddings").select(
        "vec_id", "embedding",
        F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label").cast("long") + 1, F.lit(10))).otherwise(F.col("label").cast("long")).alias("label"))
    return hard_negatives(e, e.filter("vec_id % 50 = 0"))


OP12_SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, x.vec_id, a.label = x.label AS same,
    CAST(list_sum(list_transform(list_zip(a.v, x.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM (SELECT * FROM e WHERE vec_id % 50 = 0) a JOIN e x ON x.vec_id <> a.vec_id AND len(x.v) = len(a.v)),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.anchor_id, positive_id, s.vec_id AS negative_id, positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
    AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM n WHERE rank <= 3
"""
