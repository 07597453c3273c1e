"""Connected components by alternating large and small stars.

Every round is a few joins and sums by node. The least neighbours are written
before they are joined, so the edges of a node with many can be split. Edges, nodes and labels stay in
tables in the shared folder; only two numbers per round reach the driver, to
see whether anything changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.session import settle


def _large_star(edges: DataFrame) -> DataFrame:
    """Each greater neighbour of a node is tied to the node's least neighbour (or itself)."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = settle(both.groupBy("a").agg(F.min("b").alias("m")))
    return (
        both.join(least, "a")
        .filter("b > a")
        .select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the least of them."""
    least = settle(edges.groupBy("a").agg(F.min("b").alias("m")))
    moved = edges.join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and label (the least node reachable) of every node that has an edge to another.

    ``edges`` has columns a and b of one comparable type.
    """
    now = settle(
        edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )

    def seen(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    before = seen(now)
    while before[0]:
        now = settle(_small_star(settle(_large_star(now))))
        after = seen(now)
        if after == before:
            break
        before = after
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return stars.unionByName(stars.select(F.col("label").alias("node"), "label").distinct())
