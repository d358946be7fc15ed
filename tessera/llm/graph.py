"""Connected components with DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialise, release


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Nodes of an undirected graph with the smallest node each can reach.

    edges has columns ``a`` and ``b`` of one orderable type; the result has
    ``node`` and ``component``. Nulls, loops and repeated edges are ignored; a
    graph without edges gives no rows.

    Large-star and small-star rounds alternate until every node hangs directly on
    one smaller node that itself hangs on none. The
    minima are written before they are joined back, so both join sides are plain
    shuffles and adaptive execution can split the rows of a node with very many
    neighbours. No node's neighbours are ever gathered in a list.
    """
    plain = edges.where("a is not null and b is not null and a <> b")
    stars = materialise(plain.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(max_rounds):
        # Large star: larger neighbours of a node go to the smallest node around it.
        both = stars.union(stars.select("b", "a"))
        first = materialise(both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m")), "minima")
        large = both.where("b > a").join(first, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # Small star: smaller neighbours, and the node itself, go to the smallest of them.
        large = materialise(large.where("a <> b").distinct(), "large")
        least = materialise(large.groupBy("a").agg(F.min("b").alias("m")), "minima")
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = small.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        before, stars = stars, materialise(after, "edges")
        release(before, first, large, least)
        ends = stars.select(F.col("a").alias("x"), F.lit(1).alias("low"), F.lit(0).alias("top")).union(stars.select("b", F.lit(0), F.lit(1)))
        seen = ends.groupBy("x").agg(F.sum("low").alias("low"), F.max("top").alias("top"))
        if seen.where("low > 1 or low = 1 and top = 1").isEmpty():
            break
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    nodes = stars.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(stars.select("b", "b").distinct())
