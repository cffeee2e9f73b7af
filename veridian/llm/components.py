"""Connected components of a link table by alternating large-star and small-star steps.

Both steps are a minimum for each node and a join with it, so a hub's links are never gathered in
one place; links stay in tables and never reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridian.llm._shared import drop, materialize


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour (itself included)."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    out = both.filter(F.col("b") > F.col("a")).join(low, "a").select(F.col("m").alias("a"), F.col("b"))
    return out.filter("a < b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to its smallest neighbour.  Links have a < b."""
    low = links.groupBy("b").agg(F.min("a").alias("m"))
    out = links.join(low, "b").select(F.col("m").alias("a"), F.col("a").alias("b"))
    out = out.union(low.select(F.col("m").alias("a"), "b"))
    return out.filter("a < b").distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``links`` (a, b) of any ordered type -> (node, label): the smallest node of its component.

    Only nodes with a link to another node appear.  Null ends and self-links are ignored.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    e = materialize(links.filter("a is not null and b is not null and a <> b").select(low.alias("a"), high.alias("b")).distinct(), "links")
    state = None
    for _ in range(most_rounds):
        n = materialize(_small_star(_large_star(e)), "links")
        now = n.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop(e)
        e = n
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return e.select(F.col("b").alias("node"), F.col("a").alias("label")).union(e.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct())
