"""Connected components of an edge table, by large-star / small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwise.llm.common import cut, spread_join


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is linked to the node's least neighbour."""
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return (spread_join(both, least, ["u"]).filter(F.col("v") > F.col("u"))
            .select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a != b").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    stars = spread_join(down, least, ["u"]).select(F.col("v").alias("a"), F.col("m").alias("b"))
    return stars.union(least.toDF("a", "b")).filter("a != b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (two long columns); ``root`` is
    the least node of its component.

    Each round is two aggregates and two equi-joins on narrow rows; a node with
    many neighbours is pre-aggregated by ``min`` and its join
    is open to skew handling. The rounds (logarithmic in the diameter) end when
    the edge set no longer changes: only its count and checksum reach the
    driver. Null or equal endpoints are no edge; an empty table gives none.
    """
    a, b = edges.columns
    e = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).filter("a != b").distinct()
    before = None
    while True:
        e = cut(_small_star(_large_star(e)))
        state = e.agg(F.count("a"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == before or state[0] == 0:
            break
        before = tuple(state)
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        e.select("b", "b").distinct().toDF("node", "root"))
