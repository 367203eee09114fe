"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotweave.storage import materialise


def _lowest(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The lowest value of each key, written so that a hot key's join can be split."""
    return materialise(rows.groupBy(key).agg(F.min(value).alias("low")), "low")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of (a, b) edges whose root is another, lower node.

    Rounds grow with the logarithm of the longest path.  A round aggregates
    before it shuffles and joins written tables, so hubs stay small or are
    split; nothing but a count and a checksum reaches the driver.
    """
    edges = materialise(
        edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    seen = None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = mark
        # Large star: higher neighbours of a node move to the lowest of its neighbourhood.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _lowest(both, "u", "v")
        large = materialise(
            both.where("v > u").join(low, "u")
            .select(F.col("v").alias("u"), F.least("u", "low").alias("v")).where("u > v").distinct(),
            "large",
        )
        # Small star: a node and its lower neighbours move to the lowest of them.
        low = _lowest(large, "u", "v")
        moved = large.join(low, "u").where("v > low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        edges = materialise(moved.unionByName(low.select("u", F.col("low").alias("v"))).distinct(), "edges")
