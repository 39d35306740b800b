"""Connected components by alternating stars (Kiveris et al., Connected Components in MapReduce and Beyond, 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, stored


def _to_least(pairs: DataFrame, keep) -> tuple[DataFrame, DataFrame]:
    """For each u of the pairs (u, v): u's least neighbour, itself included, joined to the neighbours that `keep` takes; and the table of least neighbours."""
    # Stored, so that the join has an exchange on either side and Spark can split a node with very many neighbours.
    least = stored(pairs.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least")))
    return pairs.join(least, "u").where(keep).select(F.col("v").alias("u"), F.col("least").alias("v")), least


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (its least node) for every node of an edge; nodes are of any orderable type.

    The least neighbour of a node is an aggregate with map-side combining, and the join that hands it out is
    one that Spark can split where a node has very many neighbours. Each round's edges, never more
    than the first, are written to the shared folder; rounds are about logarithmic in the longest path.
    """
    ends = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u != v")
    ends = stored(ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = _mark(ends)
    while mark[0]:
        both = ends.unionByName(ends.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large, nearest = _to_least(both, F.col("v") > F.col("u"))
        large = large.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        large = stored(large)
        least = stored(large.groupBy("u").agg(F.min("v").alias("least")))
        small = large.join(least, "u").where(F.col("v") != F.col("least")).select(F.col("v").alias("u"), F.col("least").alias("v"))
        before, ends = ends, stored(small.unionByName(least.select("u", F.col("least").alias("v"))).distinct())
        forget(before, nearest, large, least)  # what they held is in `ends`
        now = _mark(ends)
        if now == mark:
            break
        mark = now
    own = lambda node: F.struct(F.col(node).alias("node"), F.col("v").alias("component"))
    return ends.select(F.explode(F.array(own("u"), own("v"))).alias("x")).select("x.*").distinct()


def _mark(ends: DataFrame) -> tuple:
    row = ends.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["x"], row["s"]
