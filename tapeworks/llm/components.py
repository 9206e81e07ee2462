"""Connected components over a table of links, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Point the neighbours of each node at its least neighbour.

    edges: (a, b) with a > b. large: the greater neighbours of every node; else the lesser ones and the node.
    Least neighbours come from a combining aggregate and are written first, so the join of a hot
    node's links can be split.
    """
    if large:
        sym = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = materialize(sym.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("m", "a").alias("m")), "stars")
        out = sym.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        low = materialize(edges.groupBy("a").agg(F.min("b").alias("m")), "stars")
        moved = edges.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        out = moved.union(low.select("a", F.col("m").alias("b")))
    return out.where("a > b").distinct()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the least node that each linked node reaches.

    links: two long columns a, b, in any order; nulls and self links are ignored, repeats too. Nodes
    without a link are not returned. An empty table gives an empty one. Each round shuffles
    the links twice and writes them to the shared folder; the number of rounds grows with
    the logarithm of the longest path.
    """
    edges = links.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")
    )
    edges, before = materialize(edges.distinct(), "links"), None
    for _ in range(max_rounds):
        row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if row[0] == 0 or row == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        before = row
        edges = materialize(_star(materialize(_star(edges, True), "links"), False), "links")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
