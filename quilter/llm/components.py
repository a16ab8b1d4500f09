"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quilter.llm.common import Staged, spread_join

#: More than enough for any graph that fits a cluster: the number of rounds is logarithmic.
MAX_ROUNDS = 60


def components(edges: DataFrame, staged: Staged, name: str = "cc") -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the smallest node of its component.

    Each round points every node at its neighbourhood's minimum. Minima and degrees are partial
    aggregates; edges get them by joins that leave a hub's edges where they stand. All of a
    round is written to the shared folder, so lineage stays short. It ends when each node points straight at its root.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    cur = staged.put(pairs, f"{name}_0")  # u > v in every row
    for i in range(1, MAX_ROUNDS + 1):
        total = cur.count()
        low = cur.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        degrees = cur.groupBy("v").agg(F.count(F.lit(1)).alias("w"))
        lowest = staged.put(degrees.join(low, degrees["v"] == low["u"], "left").select("v", F.coalesce("m", "v").alias("m"), "w"), f"{name}_low_{i}")
        if not total or lowest.where("m <> v").isEmpty() and low.where("n > 1").isEmpty():
            break
        # large star: each larger neighbour of a node goes to the node's least neighbour
        large = spread_join(cur, lowest, "v", "w", total, "inner").select("u", F.col("m").alias("v")).distinct()
        large = staged.put(large, f"{name}_large_{i}")
        # small star: a node and its smaller neighbours go to the least of these
        down = staged.put(large.groupBy("u").agg(F.min("v").alias("d"), F.count(F.lit(1)).alias("n")), f"{name}_down_{i}")
        moved = spread_join(large, down.where("n > 1"), "u", "n", total, "inner").where("v <> d").select(F.col("v").alias("u"), F.col("d").alias("v"))
        new = staged.put(down.select("u", F.col("d").alias("v")).union(moved).distinct(), f"{name}_{i}")
        for old in (f"{name}_{i - 1}", f"{name}_low_{i}", f"{name}_large_{i}", f"{name}_down_{i}"):
            staged.drop(old)
        cur = new
    else:
        raise RuntimeError("components did not settle")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).union(lowest.select(F.col("v").alias("node"), F.col("v").alias("root")))
