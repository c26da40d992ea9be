"""Connected components of undirected links, by labels that sink to the least node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave.sources.shared import Kept


def least_reachable(links: DataFrame, keys: list[str], rounds: int = 64) -> DataFrame:
    """(*keys, node, root) of all nodes in ``links`` (*keys, a, b); root is the least node that a path inside the same keys reaches.

    In a round a node takes the least root of itself and its neighbours, and then that root's own root, so the rounds grow with the logarithm of
    the longest path for the most part. Each round is two joins and a grouped minimum over a table written to the shared folder; no group is gathered.
    """
    both = links.select(*keys, "a", "b").union(links.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct()
    edges = Kept(both, "links")
    now = Kept(edges.df.groupBy(*keys, F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("root")), "roots")
    for _ in range(rounds):
        near = edges.df.join(now.df.withColumnRenamed("node", "b"), [*keys, "b"]).groupBy(*keys, F.col("a").alias("node")).agg(F.min("root").alias("near"))
        sunk = now.df.join(near, [*keys, "node"]).select(*keys, "node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        # a root is a node too: what it has sunk to itself, nodes under it sink to as well
        onward = now.df.select(*keys, F.col("node").alias("root"), F.col("root").alias("deeper"))
        after = Kept(sunk.join(onward, [*keys, "root"], "left").select(*keys, "node", "was", F.least("root", "deeper").alias("root")), "roots")
        moved = after.df.where("was != root").limit(1).count()
        now.drop()
        now = Kept(after.df.drop("was"), "roots")
        after.drop()
        if not moved:
            edges.drop()
            return now.df
    raise RuntimeError("components did not settle")
