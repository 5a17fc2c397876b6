"""Connected components of a table of links, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagemill.llm.tables import checkpointed


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (longs ``a, b``); nodes of one component share a root.

    In each round every node moves to the neighbour, or itself, of the smallest hash, which is reduced in each task
    before the shuffle; links between moved nodes that still differ go on. As the hash changes with the round, the
    number of nodes falls by a constant factor in expectation, on chains too. Nothing is collected but whether a
    link is left. Rounds are checkpointed.
    """
    left = checkpointed(links.filter("a <> b").distinct())
    roots: DataFrame | None = None
    turn = 0
    while not left.isEmpty():
        order = lambda node: F.struct(F.xxhash64(F.col(node), F.lit(turn)).alias("h"), F.col(node).alias("n"))
        both = left.union(left.select("b", "a"))
        moves = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min(order("b")), F.min(order("a")))["n"].alias("to"))
        moves = checkpointed(moves)
        by_a = moves.select(F.col("node").alias("a"), F.col("to").alias("to_a"))
        by_b = moves.select(F.col("node").alias("b"), F.col("to").alias("to_b"))
        moved = left.join(by_a, "a").join(by_b, "b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b"))
        left = checkpointed(moved.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        if roots is None:
            roots = moves.select("node", F.col("to").alias("root"))
        else:
            onward = moves.select(F.col("node").alias("root"), "to")
            roots = checkpointed(roots.join(onward, "root", "left").select("node", F.coalesce("to", "root").alias("root")))
        turn += 1
    if roots is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots
