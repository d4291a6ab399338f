"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studylake.llm.common import materialize


def _stars(near: DataFrame) -> DataFrame:
    """near(u, v): joins each u's neighbours with the smallest of them and u itself, as (u, v, m).

    The minima combine before their shuffle and are written out, so that the join meets two plain exchanges and adaptive
    execution can split the rows of a node with very many neighbours.
    """
    least = materialize(near.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m")), "star-minima")
    return near.join(least, "u")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for each node that has an edge; root is the smallest node it can reach.

    Direction, repeats, loops and rows with a NULL end do not matter; no edges give no rows. Each round writes its edges to the
    shared folder; rounds grow with the logarithm of the longest path in practice, not with the path.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    loops = pairs.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("root"))
    current = materialize(
        pairs.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    mark = None
    while not current.isEmpty():
        both = current.union(current.select("v", "u"))
        large = materialize(_stars(both).where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        # Every edge now points from a node to a smaller one, as the small step needs.
        small = _stars(large)
        moved = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        current = materialize(moved.union(small.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    found = current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("root"))
    return found.union(roots).union(loops).groupBy("node").agg(F.min("root").alias("root"))
