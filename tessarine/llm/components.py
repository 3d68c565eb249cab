"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 50) -> DataFrame:
    """(node, root): the smallest node reachable from each node with an edge.

    Each round joins every node's larger neighbours, then its smaller ones, to
    the smallest of its neighbourhood (large star, small star) until nothing
    changes.  Neighbourhoods are only ever reduced by ``min``, which combines
    before the shuffle, so a hub costs its edges and is never collected.  Each
    round's edges are a table in the shared folder.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    e = materialize(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        big = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        big = big.where("u <> v").distinct()
        low = big.groupBy("u").agg(F.min("v").alias("m"))
        small = big.join(low, "u")
        nxt = small.select("u", F.col("m").alias("v")).unionByName(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        nxt = materialize(nxt.distinct(), "edges")
        parents = nxt.groupBy("u").agg(F.count("*").alias("n"))
        roots = nxt.select(F.col("v").alias("u")).distinct()
        # done when every node has one parent and no parent has one itself
        busy = parents.where("n > 1").select("u").unionByName(nxt.join(roots, "u", "left_semi").select("u")).limit(1)
        e = nxt
        if not busy.take(1):
            break
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
