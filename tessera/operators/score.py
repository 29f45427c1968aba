"""What to look at first: a score of each function."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def caller_bonus(count: Column, scoring: dict) -> Column:
    """By brackets of the number of callers; few are interesting, many are utilities."""
    ladder = [(count <= most, F.lit(float(v))) for most, v in scoring["caller_brackets"]]
    return reduce(lambda w, cv: w.when(*cv), ladder[1:], F.when(*ladder[0])).otherwise(float(scoring["caller_beyond"]))


def node_score(config: dict) -> Column:
    s = config["scoring"]
    complexity = F.greatest(F.lit(0), F.col("basic_block_count") - 1)
    rare = F.col("caller_count") <= s["high_complexity_caller_max"]
    return (
        F.when(F.size("dangerous_sink_calls") > 0, float(s["sink_bonus"])).otherwise(0.0)
        + F.when(F.col("input_reachable"), float(s["input_reachable_bonus"])).otherwise(0.0)
        + F.when(complexity <= s["low_complexity_threshold"], float(s["low_complexity_bonus"]))
        .when((complexity >= s["high_complexity_threshold"]) & rare, float(s["high_complexity_bonus"]))
        .otherwise(0.0)
        + caller_bonus(F.col("caller_count"), s)
    )


def scored(nodes: DataFrame, depths: DataFrame, config: dict) -> DataFrame:
    """nodes with score, depth and their total."""
    return (
        nodes.join(depths, "address", "left")
        .withColumn("depth", F.coalesce("depth", F.lit(0)))
        .withColumn("score", node_score(config))
        .withColumn("total", F.col("score") + F.col("depth"))
    )


def top(scores: DataFrame, n: int = 50) -> DataFrame:
    return scores.orderBy(F.desc("total"), "address").limit(n)


def suspicious(scores: DataFrame, n: int, config: dict) -> DataFrame:
    """The n best still unnamed among the best n times the pool factor."""
    pool = top(scores, n * config["scoring"]["candidate_pool_multiplier"])
    prefixes = "|".join(config["policy"]["analysis_candidate_prefixes"])
    return pool.where(F.col("name").rlike(f"^({prefixes})")).orderBy(F.desc("total"), "address").limit(n)
