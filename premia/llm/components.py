"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from premia.llm.common import write_table


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``node`` and ``component_id`` (the smallest node reachable) of every node that has a link.

    ``links`` has the columns ``a`` and ``b``. Nulls and links of a node with itself are ignored, repeated
    links count once, an empty table has no nodes. Neighbours are never gathered: each step takes the
    smallest neighbour by a pre-aggregated minimum and joins it back to the links. The minima are written
    before, so that both sides of the join are read anew: adaptive execution splits the partition of a node
    with very many links, which it cannot where one side is an aggregate in the same stage.
    """
    ordered = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v")
    table = write_table(ordered.distinct(), "links")
    state = None
    for _ in range(rounds):
        # Large star: larger neighbours of a node move to the smallest of its neighbourhood.
        both = table.union(table.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = write_table(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = write_table(large.where("u > v").distinct(), "large")
        # Small star: a node and its smaller neighbours move to the smallest of them.
        least = write_table(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        moved = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        table = write_table(moved.union(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        new = table.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == state:
            return table.select(F.col("u").alias("node"), F.col("v").alias("component_id")).union(
                table.select(F.col("v").alias("node"), F.col("v").alias("component_id")).distinct()
            )
        state = new
    raise RuntimeError(f"components did not settle in {rounds} rounds")
