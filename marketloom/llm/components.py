"""Connected components of an edge table, by alternating large and small stars.

The least neighbours are written before edges are joined to them, so that Spark can split the join for a node with very many edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from marketloom.llm.text import cut, discard


def _neighbours(edges: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """Edges in both directions, the least of each node's neighbourhood, and whether all components are stars around their least node:
    then each node has one neighbour or only larger ones."""
    both = edges.union(edges.select("dst", "src"))
    seen = Observation()
    least = both.groupBy("src").agg(F.least(F.col("src"), F.min("dst")).alias("least"), F.count(F.lit(1)).alias("n"))
    least = cut(least.observe(seen, F.count_if((F.col("least") < F.col("src")) & (F.col("n") > 1)).alias("open")).select("src", "least"))
    return both, least, not seen.get["open"]


def _large_star(both: DataFrame, least: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least of its neighbourhood."""
    return both.where("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("least").alias("dst")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them."""
    least = cut(edges.groupBy("src").agg(F.min("dst").alias("least")))
    inner = edges.join(least, "src").where("dst <> least").select(F.col("dst").alias("src"), F.col("least").alias("dst"))
    return inner.union(least.select("src", F.col("least").alias("dst"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): each node of an edge (src, dst) with the least node of its component, roots included. Rounds are logarithmic in the longest path."""
    current = cut(edges.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())
    while True:
        both, least, stars = _neighbours(current)
        if stars:
            break
        last, current = current, cut(_small_star(cut(_large_star(both, least))))
        discard(last)
    return current.select(F.col("src").alias("node"), F.col("dst").alias("root")).union(current.select("dst", "dst").distinct())
