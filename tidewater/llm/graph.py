"""Connected components by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stash, join_counted


def components(edges: DataFrame, stash: Stash, max_rounds: int = 100) -> DataFrame:
    """edges (a long, b long) -> (node, root): the smallest node that can be reached. Each round is a written table."""
    both = stash.put(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    label = stash.put(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")))
    for _ in range(max_rounds):
        near = both.join(label.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near"))
        hop = label.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        hop = stash.put(hop)
        ups = label.select(F.col("node").alias("root"), F.col("root").alias("up")).join(hop.groupBy("root").agg(F.count("*").alias("n")), "root")
        jump = join_counted(hop, ups, "root", "n", hop.count()).select("node", "old", F.least("root", "up").alias("root"))  # a root may have a third of all nodes
        nxt = stash.put(jump)
        moved = nxt.filter("old != root").limit(1).count()
        stash.drop(label)
        stash.drop(hop)
        label = nxt.select("node", "root")
        label._stash_path = nxt._stash_path
        if not moved:
            return label
    raise RuntimeError("components did not settle")
