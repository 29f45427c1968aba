"""From decisions to names: what is applied, and what runs next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import graph, kb, score, validate
from ..sources import files
from .lineage import settle


def apply(rows: DataFrame, live: DataFrame, config: dict, least: float | None = None, dry_run: bool = False) -> dict[str, DataFrame]:
    """Approved names that are not applied yet, against live (address, name).

    actions: one row each with what is done; counts: applied, skipped, errors; rows and names:
    the knowledge base and the names afterwards, unchanged by a dry run."""
    floor = config["analysis"]["confidence_threshold"] if least is None else least
    pending = kb.approved_unapplied(rows, floor).select(
        text.parse_address(F.concat(F.lit("0x"), F.substring("address", 3, 32))).alias("address"),
        F.col("address").alias("key"), "new_name", "applied_name", "confidence",
    )
    # The most confident first, as they would be applied one by one.
    ordered = pending.withColumn("seq", F.struct((-F.coalesce("confidence", F.lit(0.0))).alias("c"), "key"))
    acted = validate.apply_actions(ordered, live, config)
    actions = settle(acted.join(pending.select("address", "key"), "address"), "actions")
    done = F.col("action").isin("apply", "same")
    counts = actions.agg(
        F.count_if(done).alias("applied"), F.count_if(F.col("action") == "skip").alias("skipped"), F.count_if(F.col("action") == "error").alias("errors")
    )
    if dry_run:
        return {"actions": actions, "counts": counts, "rows": rows, "names": live}
    hits = actions.where(done)
    after = kb.mark(rows, hits.select(F.col("key").alias("address"), "final_name"), applied=F.lit(True), applied_name=F.col("__final_name"))
    names = files.rename_cached(live, hits.select("address", F.col("final_name").alias("new_name")))
    return {"actions": actions, "counts": counts, "rows": after, "names": names}


def resolve_graph(
    spark: SparkSession, path: str, build: Callable[[], DataFrame], live: int | None = None, targeted: bool = False, rebuild: bool = False
) -> tuple[DataFrame | None, str]:
    """(the graph's nodes, a note). A targeted run without a stored graph goes without one; a
    stored one with another number of functions than ``live`` is used, with a note."""
    if targeted and not rebuild and not files.exists(spark, path):
        return None, "no stored graph: running without callee context"
    nodes = files.load_or_build(spark, path, build, rebuild)
    if live is not None and not rebuild and (n := nodes.count()) != live:
        return nodes, f"the graph has {n} functions, the program {live}: its structure may be stale"
    return nodes, ""


def resolve_scope(
    nodes: DataFrame, edges: DataFrame, scores: DataFrame, config: dict, names: list[str] | None = None, top: int | None = None
) -> tuple[DataFrame, DataFrame | None, str]:
    """(addresses, forced addresses, a label): named functions and all they call, the best
    suspicious ones and all they call, or every auto-named function."""
    if names:
        asked = nodes.where(F.col("name").isin(names)).select("address")
        return graph.reachable(edges, asked), asked, f"{len(names)} named function(s) and what they call"
    if top:
        best = score.suspicious(scores, top, config).select("address")
        return graph.reachable(edges, best), None, f"top {top} and what they call"
    return nodes.where(validate.is_auto_named(F.col("name"), config)).select("address"), None, "every auto-named function"


def functions_by_name(nodes: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """targets (place, target: a name or an address) -> (place, address, name) and those
    without a match. An address inside a function is that function's; each function once,
    at its first place. nodes: address, name, size_bytes."""
    t = targets.withColumn("at", text.parse_address(F.when(F.col("target").rlike("^0[xX]"), F.concat(F.lit("0x"), F.substring("target", 3, 16)))))
    by_name = t.where("at IS NULL").join(nodes, t["target"] == nodes["name"]).select("place", "target", "address", "name")
    # An address lies in the function that starts last at or below it.
    starts = nodes.select(F.col("address").alias("at"), F.struct("address", "name", "size_bytes").alias("f"), F.lit(None).cast("int").alias("place"), F.lit(None).cast("string").alias("target"))
    asked = t.where("at IS NOT NULL").select("at", F.lit(None).cast(starts.schema["f"].dataType).alias("f"), F.col("place").cast("int").alias("place"), "target")
    by_address = last_start(starts, asked)
    inside = F.col("at") < F.col("f.address") + F.greatest(F.col("f.size_bytes").cast("long"), F.lit(1))
    hits = by_name.union(by_address.where(inside).select("place", "target", "f.address", "f.name"))
    found = hits.groupBy("address", "name").agg(F.min("place").alias("place")).select("place", "address", "name")
    missed = targets.join(hits.select("target").distinct(), "target", "left_anti").select("place", "target")
    return found, missed


def last_start(starts: DataFrame, asked: DataFrame) -> DataFrame:
    """asked with f: the start at or below its address. Starts and questions are dealt out
    together by ranges of 2**16 addresses; a range without a start of its own before a
    question takes the last start of the ranges before it."""
    from pyspark.sql import Window as W

    span = F.shiftright("at", 16).alias("span")
    heads = starts.groupBy(span).agg(F.max_by("f", "at").alias("f"))
    upto = W.orderBy("span").rowsBetween(W.unboundedPreceding, -1)
    spans = heads.select("span", "f").unionByName(asked.select(span).distinct().join(heads.select("span"), "span", "left_anti").withColumn("f", F.lit(None).cast(heads.schema["f"].dataType)))
    # One row a range of addresses that is used.
    before = spans.select("span", F.last("f", ignorenulls=True).over(upto).alias("before"))
    inside = W.partitionBy("span").orderBy("at", F.col("target").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    every = starts.select(span, "*").unionByName(asked.select(span, "*"))
    met = every.withColumn("own", F.last("f", ignorenulls=True).over(inside)).where("target IS NOT NULL")
    return met.join(before, "span", "left").select("at", "place", "target", F.coalesce("own", "before").alias("f"))


def summary(rows: DataFrame, calls: int, errors: int) -> DataFrame:
    """The end of a run: its calls and failures, and where the knowledge base stands."""
    return kb.stats(rows).select(F.lit(calls).alias("calls"), F.lit(errors).alias("errors"), "*")
