"""Plans of an analysis run: what to analyse, in which order, at what cost; and the run
itself, level by level, with the model and the extractor passed in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import duration, hex_address
from ..operators import graph, kb, validate
from .ranks import places, running


def scope(nodes: DataFrame, edges: DataFrame, targets: DataFrame | None = None, best: DataFrame | None = None) -> DataFrame:
    """Addresses to consider: targets or the best scored, each with all it calls; else all."""
    seeds = targets if targets is not None else best
    return nodes.select("address") if seeds is None else graph.reachable(edges, seeds)


def build_plan(
    nodes: DataFrame, order: DataFrame, rows: DataFrame, config: dict, forced: DataFrame | None = None, limit: int | None = None
) -> DataFrame:
    """Candidates that are not analysed yet, in bottom-up order: (address, name, place).

    forced addresses are in whatever their name and state; addresses that the order lacks
    come last; limit counts what is left after these filters."""
    done = rows.where("analyzed").select("address")
    named = nodes.select("address", "name", hex_address(F.col("address")).alias("key"))
    fresh = named.where(validate.is_candidate(F.col("name"), config)).join(done.withColumnRenamed("address", "key"), "key", "left_anti")
    chosen = fresh if forced is None else fresh.union(named.join(forced, "address", "left_semi").select(fresh.columns)).distinct()
    placed = chosen.join(order.select("address", "place"), "address", "left")
    ranked = places(placed.withColumnRenamed("place", "given"), F.asc_nulls_last("given"), "address").select("address", "name", "place")
    return ranked if limit is None else ranked.where(F.col("place") <= limit)


def estimate(plan: DataFrame, seconds_per_call: float) -> DataFrame:
    n = F.count("*").alias("calls")
    return plan.agg(n).select("calls", (F.col("calls") * seconds_per_call).alias("seconds"), duration(F.col("calls") * seconds_per_call).alias("text"))


def budgeted(rows: DataFrame, limit: int) -> DataFrame:
    """rows (place, rejection): all cheap rejections before the limit-th call, and that many calls."""
    counted = running(rows, F.when(F.col("rejection").isNull(), 1).otherwise(0).cast("long"), "place", name="calls")
    return counted.where((F.col("calls") < limit) | ((F.col("calls") == limit) & F.col("rejection").isNull()))


def run_level(context: DataFrame, rows: DataFrame, analyze: Callable[[DataFrame], DataFrame], config: dict, seq: int) -> DataFrame:
    """One level: context (address key, old_name, code) -> replies -> verdicts -> rows.

    analyze takes (address, old_name, code) and returns (address, reply: JSON text). Rows
    whose reply is null stay as they are, to be tried again."""
    cheap = context.withColumn("rejection", validate.cheap_rejection(F.col("code"), config))
    replies = analyze(cheap.where("rejection IS NULL").select("address", "old_name", "code"))
    judged = validate.validate(replies.where("reply IS NOT NULL"), config)
    field = lambda k: F.get_json_object("reply", f"$.{k}")
    decided = judged.join(context.select("address", "old_name"), "address").select(
        "address",
        "old_name",
        F.col("name").alias("new_name"),
        field("confidence").try_cast("double").alias("confidence"),
        field("summary").alias("summary"),
        F.when(F.col("ok"), "approved").otherwise("rejected").alias("status"),
        F.col("why").alias("rejection_reason"),
        F.lit(True).alias("analyzed"),
        F.lit(seq).cast("long").alias("seq"),
    )
    rejected = cheap.where("rejection IS NOT NULL").select(
        "address",
        "old_name",
        F.lit(None).cast("string").alias("new_name"),
        F.lit(None).cast("double").alias("confidence"),
        F.lit(None).cast("string").alias("summary"),
        F.lit("rejected").alias("status"),
        F.col("rejection").alias("rejection_reason"),
        F.lit(True).alias("analyzed"),
        F.lit(seq).cast("long").alias("seq"),
    )
    return kb.upsert(rows, decided.unionByName(rejected))
