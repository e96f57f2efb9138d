"""Connected components by alternating stars, with each round's links written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sleuthgraph.plans.lineage import cut


def _hung(links: DataFrame, least: DataFrame) -> DataFrame:
    """Each (u, v) as (v, least of u)."""
    return links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % 1_000_003).alias("x"), F.sum("v").alias("s")).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b): the least node it is connected with.

    The least neighbour is pre-aggregated before the shuffle, and a hub's links
    join it as a skewed join that Spark splits, so a star of any size is fine.
    """
    now = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = cut(_hung(both.where("v > u"), least).distinct())  # larger neighbours hang on the least
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _hung(large, least).unionByName(least.select("u", F.col("m").alias("v"))).where("u > v")
        now = cut(small.distinct())
        new = _state(now)
        if new == state:
            break
        state = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
