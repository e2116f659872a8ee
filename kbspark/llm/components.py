"""Connected components by random contraction, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from kbspark.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` -> ``(node, root)``: equal roots for nodes that are connected.

    Each round draws a random order of the nodes and moves every node to the least of its closed
    neighbourhood, so that the number of nodes at least halves in expectation, also on chains. The
    least neighbour is a partially aggregated minimum, thus a node with very many neighbours costs
    one row per map task. Its edges are joined to its new name between two plain shuffles, where adaptive
    execution splits a partition that is too large. Only the contracted edges and the node maps are kept, both as tables in the
    shared folder: a table has the size of its files, while a checkpoint keeps the size that Spark estimates for its plan, which
    joins multiply, so that it would have three times as many digits after each round and soon fill the driver.
    Nodes without edges do not appear. Self-loops and repeated edges are allowed.
    """
    left, n = counted(edges.select("a", "b").where("a <> b").distinct())
    maps: list[DataFrame] = []
    while n:
        seed = F.lit(len(maps))
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = lambda c: F.struct(F.xxhash64(seed, F.col(c)).alias("o"), F.col(c).alias("n"))
        moved = stored(
            both.groupBy("a")
            .agg(F.min(order("b")).alias("least"))
            .select(F.col("a").alias("node"), F.least(order("a"), F.col("least"))["n"].alias("root"))
        )
        maps.append(moved)
        ends = [moved.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "ab"]
        left, n = counted(
            left.join(ends[0], "a")
            .join(ends[1], "b")
            .where("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
            .distinct()
        )
    if not maps:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = maps[0]
    for later in maps[1:]:
        then = later.select(F.col("node").alias("root"), F.col("root").alias("next"))
        found = found.join(then, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return found


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """``df`` as a table in the shared folder, and the number of its rows, counted while it is written."""
    seen = Observation()
    held = stored(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return held, seen.get["n"]
