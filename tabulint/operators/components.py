"""Connected components of an undirected graph by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulint.plans.durable import saved


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """edges: (u, v) of one orderable type.  Returns (node, root), the smallest
    node of its component, for every node with an edge to another one.

    A round points every node's larger neighbours to its smallest one, then its
    smaller ones; the graph ends as stars in O(log^2 n) rounds.  A hub's edges
    never meet in one task: minima are combined on the map side, and the joins
    are plain ones whose large partitions adaptive execution splits.
    """
    pairs = saved(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    last = None
    for _ in range(most_rounds):
        both = pairs.unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.join(low.hint("merge"), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low.hint("merge"), "u")
        small = joined.select("u", F.col("m").alias("v")).unionAll(joined.select(F.col("v").alias("u"), F.col("m").alias("v"))).filter("u <> v").distinct()
        pairs = saved(small, "edges")
        # two numbers tell whether the edges changed
        state = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == last:
            break
        last = state
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = pairs.select("v").distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots.select(F.col("v").alias("node"), F.col("v").alias("root")))
