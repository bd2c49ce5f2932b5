"""Connected components as DataFrame steps: alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import discard, materialize

#: A node with more edges than this, and more than one in HOT_NODES of all, is joined by broadcast;
#: there are fewer than HOT_NODES of them.
HOT_EDGES = 1000
HOT_NODES = 1 << 16


def _tied(edges: DataFrame, least: DataFrame, most: int) -> DataFrame:
    """(larger, smaller) of b and m for edges (a, b) and least (a, m, n). Nodes of very many edges meet
    them where these are, all others by a join."""
    named = least.select(F.col("a").alias("_a"), "m", "n")
    hot = named.where(F.col("n") > most).select("_a", "m")
    tried = edges.join(F.broadcast(hot), F.col("a") == F.col("_a"), "left")
    rest = tried.where("_a IS NULL").select("a", "b").join(named.where(F.col("n") <= most), F.col("a") == F.col("_a"))
    both = tried.where("_a IS NOT NULL").select("b", "m").union(rest.select("b", "m"))
    return both.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _large_star(edges: DataFrame, most: int) -> DataFrame:
    """Tie each larger neighbour of a node to the node's smallest neighbour, itself included."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n"))
    return _tied(both.where("b > a"), least, most)


def _small_star(edges: DataFrame, most: int) -> DataFrame:
    """Tie a node and its smaller neighbours to the smallest of them. Edges come as a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    return _tied(edges, least, most).union(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge; component is the smallest node reachable.

    edges: columns a and b, longs, in any order, repeats and loops allowed. Minima are aggregated
    before the shuffle, so a node of any degree is safe; each round's edges are written out, so a
    lost executor costs no more than that round, and those of the round before are deleted. Rounds
    go on until the edges stay as they are; each takes every node's edges to smaller nodes, so that
    they end. An empty input gives an empty result.
    """
    now = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    n, mark = now.count(), None
    while True:
        most = max(HOT_EDGES, n // HOT_NODES)
        step = materialize(_small_star(_large_star(now, most).distinct(), most).distinct(), "edges")
        n, sums = step.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(now)
        now = step
        if mark == (n, sums):
            break
        mark = (n, sums)
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(now.select("b", "b").distinct())
