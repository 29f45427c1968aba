"""Connected components of a link table, distributed and in few rounds.

Alternating large-star and small-star steps (Kiveris et al., 2014): links shrink to
stars around each component's smallest node in O(log n) rounds, each a pair of
aggregations; no component is ever gathered in a task, and hubs are pre-aggregated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle


def _star(links: DataFrame) -> DataFrame:
    """links (u > v), distinct. One large-star and one small-star step."""
    both = links.union(links.select("v", "u").toDF("u", "v"))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    # Large star: each larger neighbour moves to the least of the neighbourhood.
    large = (
        links.select(F.col("v").alias("u"), F.col("u").alias("w"))
        .join(low, "u")
        .select(F.col("w").alias("u"), F.col("m").alias("v"))
        .where("u > v")
        .distinct()
    )
    down = large.groupBy("u").agg(F.min("v").alias("m"))
    # Small star: each smaller neighbour, and the node itself, move to the least.
    small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
    return small.union(down.select("u", F.col("m").alias("v"))).distinct()


def connected(links: DataFrame, rounds: int = 60) -> DataFrame:
    """links (u, v) -> (node, component): the smallest node reachable, for all nodes in links."""
    now = settle(
        links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links"
    )
    for _ in range(rounds):
        new = settle(_star(now), "links")
        state = F.struct(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"))
        if now.select(state).first() == new.select(state).first():
            break
        now = new
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    centres = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return leaves.union(centres)
