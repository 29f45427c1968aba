"""A second look at uncertain names, now that callers are known."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import payload, text
from ..plans.lineage import settle
from . import context, kb, prompts

REPLY = "struct<suggested_name:string,summary:string,confidence:string,security_relevant:string,changed:string,no_change:string,interesting_behaviors:array<string>>"


def plan(rows: DataFrame, edges: DataFrame, skip: float) -> DataFrame:
    """Candidates with what becomes of them before a call: (address, outcome: null where one is
    due, else why not). edges (caller, callee) have the key form."""
    some = kb.unrefined(rows, skip).select("address")
    known = rows.where(F.col("analyzed") & F.col("summary").isNotNull()).select(F.col("address").alias("caller"))
    called = edges.join(known, "caller", "left_semi").select(F.col("callee").alias("address")).distinct().withColumn("called", F.lit(True))
    bad = text.parse_address(F.col("address")).isNull()
    outcome = F.when(bad, "unparseable address").when(F.col("called").isNull(), "no analyzed caller")
    return some.join(called, "address", "left").select("address", outcome.alias("outcome"))


def refine(
    rows: DataFrame, edges: DataFrame, facts: DataFrame, ask: Callable[[DataFrame], DataFrame], config: dict
) -> tuple[DataFrame, DataFrame]:
    """One pass: (rows after it, outcomes (address, outcome)).

    facts (address, live_name, trivial, return_blind, dangerous_sink_calls, input_reachable,
    and call_sites: map caller's address -> text). ask takes (address, prompt) and returns
    (address, reply: JSON text, null where the call failed). A failed call leaves its row to
    be tried again; all other candidates are marked refined."""
    due = settle(plan(rows, edges, config["kb"]["refinement_confidence_skip"]), "plan")
    todo = due.where("outcome IS NULL").select("address")
    callers = context.neighbour_rows(rows, edges, "callee", "caller", "caller_rows")
    callees = context.neighbour_rows(rows, edges, "caller", "callee", "callee_rows")
    name = lambda r: F.coalesce(F.nullif(r["new_name"], F.lit("")), F.nullif(r["old_name"], F.lit("")), F.lit("?"))
    full = todo.join(rows.select("address", "new_name", "old_name", "summary", "confidence"), "address").join(facts, "address", "left")
    full = full.join(callers, "address").join(callees, "address", "left").join(context.family_rows(rows), "address", "left")
    site = lambda r: F.element_at("call_sites", r["address"])
    no_family = F.array().cast("array<struct<address:string,new_name:string,old_name:string,summary:string>>")
    full = full.select(
        "address", "new_name", "old_name", "summary", "confidence", "live_name",
        F.coalesce("trivial", F.lit(False)).alias("trivial"), F.coalesce("return_blind", F.lit(False)).alias("return_blind"),
        F.coalesce("dangerous_sink_calls", F.array().cast("array<string>")).alias("dangerous_sink_calls"),
        F.coalesce("input_reachable", F.lit(False)).alias("input_reachable"),
        F.coalesce("family_members", no_family).alias("family_members"), F.coalesce("family_size", F.lit(0)).alias("family_size"),
        F.transform("caller_rows", lambda r: F.struct(name(r).alias("name"), r["confidence"].alias("confidence"), r["summary"].alias("summary"), site(r).alias("call_site"))).alias("callers"),
        F.transform(F.coalesce("callee_rows", F.array().cast(prompts.known_type())), lambda r: F.struct(name(r).alias("name"), r["summary"].alias("summary"))).alias("callees"),
    )
    replies = settle(ask(prompts.refine_prompt(full)).select("address", "reply"), "replies")
    said = replies.withColumn("r", F.from_json("reply", REPLY)).join(rows, "address")
    changed = F.coalesce(payload.response_changed(F.col("r"), F.coalesce("new_name", F.lit(""))), F.lit(False))
    judged = settle(
        said.select(
            "address",
            F.when(F.col("reply").isNull(), "error").when(changed, "updated").otherwise("no change").alias("outcome"),
            payload.refined(F.col("r"), F.struct("new_name", "summary", "confidence", "security_relevant")).alias("n"),
        ),
        "judged",
    )
    updates = judged.where("outcome = 'updated'").select("address", "n.*")
    out = kb.after_refinement(rows, updates)
    outcomes = due.where("outcome IS NOT NULL").union(judged.select("address", "outcome"))
    out = kb.mark(out, outcomes.where("outcome NOT IN ('error', 'updated')").select("address"), refined=F.lit(True))
    return out, outcomes
