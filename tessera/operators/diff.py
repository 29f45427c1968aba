"""What a model says of two versions of functions, sample against sample."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import payload, text
from ..plans.lineage import settle
from . import graph, match, prompts

Ask = Callable[[DataFrame], DataFrame]


def pair_all(old: DataFrame, new: DataFrame, old_edges: DataFrame, new_edges: DataFrame) -> dict[str, DataFrame]:
    """The whole comparison of two versions: pairs with categories, what each side has alone
    (noise apart), and the calls among changed functions of each side."""
    a, b = match.named_callees(old, old_edges), match.named_callees(new, new_edges)
    pairs = match.pair(a, b)
    classified = settle(match.classify(a, b, pairs), "classified")
    alone = settle(match.new_and_removed(a, b, pairs), "alone")
    changed = classified.where("category = 'candidate'")
    old_items = changed.select(F.col("old_address").alias("address"), F.col("old_name").alias("name")).union(
        alone.where("situation = 'removed' AND NOT noise").select("address", "name")
    )
    new_items = changed.select(F.col("new_address").alias("address"), F.col("new_name").alias("name")).union(
        alone.where("situation = 'new' AND NOT noise").select("address", "name")
    )
    return {
        "pairs": classified,
        "new": alone.where("situation = 'new' AND NOT noise"),
        "removed": alone.where("situation = 'removed' AND NOT noise"),
        "noise": alone.where("noise"),
        "old_related": graph.relatedness(old_edges, old_items),
        "new_related": graph.relatedness(new_edges, new_items),
    }


def with_summaries(related: DataFrame, summaries: DataFrame) -> DataFrame:
    """related (address, other, other_name, relation) with what is already said of others
    (address, summary), each relation once: (address, related: array of structs)."""
    said = summaries.select(F.col("address").alias("other"), "summary")
    one = related.join(said, "other", "left").select("address", "other", F.col("other_name").alias("name"), "relation", F.coalesce("summary", F.lit("")).alias("summary"))
    entry = F.struct("other", "name", "relation", "summary")
    each = one.distinct().groupBy("address").agg(F.array_sort(F.collect_list(entry)).alias("r"))
    return each.select("address", F.transform("r", lambda x: F.struct(x["name"].alias("name"), x["relation"].alias("relation"), x["summary"].alias("summary"))).alias("related"))


def note_of(related: Column, config: dict) -> Column:
    return F.coalesce(text.related_note(related, config["analysis"]["max_related_summary_chars"]), F.lit(""))


def verdict(reply: Column) -> Column:
    """A reply as one verdict and its differences; null for a null reply."""
    each = payload.differences(reply)
    whole = payload.rolled_up(each)
    fields = ("meaningful_diff_found", "diff_summary", "security_relevant", "risk", "explanation")
    return F.when(reply.isNotNull(), F.struct(*(whole[f].alias(f) for f in fields), each.alias("differences")))


def draft_view(v: Column) -> Column:
    """What of a verdict is kept where drafts disagree."""
    return F.struct(*(v[f].alias(f) for f in ("meaningful_diff_found", "security_relevant", "risk", "differences")))


def compare(pairs: DataFrame, ask: Ask, reconcile: Ask, config: dict, system_chars: int = 0) -> DataFrame:
    """pairs (id, name, old_code, new_code, related) -> id, verdict, samples, checked, agreed,
    flagged, error, draft_1, draft_2.

    ask and reconcile take (id, sample, prompt) and return (id, reply: JSON text, error). A
    prompt of at least ``self_consistency_min_prompt_chars`` is asked twice; where the two
    disagree, reconcile sees both, and both are kept for a person to look at. A second sample
    or a reconciliation that fails leaves the first verdict standing."""
    least = config["diff"]["self_consistency_min_prompt_chars"]
    note = note_of(F.col("related"), config)
    asked = settle(pairs.select("id", "name", "old_code", "new_code", note.alias("note"), prompts.pair_prompt(F.col("name"), F.col("old_code"), F.col("new_code"), note).alias("prompt")), "asked")
    big = F.length("prompt") + system_chars >= least
    one = settle(ask(asked.select("id", F.lit(1).alias("sample"), "prompt")).select("id", "reply", "error"), "first")
    again = asked.where(big).join(one.where("reply IS NOT NULL").select("id"), "id", "left_semi")
    two = settle(ask(again.select("id", F.lit(2).alias("sample"), "prompt")).select("id", F.col("reply").alias("reply2"), F.col("error").alias("error2")), "second")
    both = one.join(two, "id", "left").select("id", verdict(F.col("reply")).alias("a"), verdict(F.col("reply2")).alias("b"), "error", "error2")
    agree = payload.drafts_agree(F.col("a"), F.col("b"))
    judged = settle(both.withColumn("agreed", F.when(F.col("b").isNotNull(), agree)), "judged")
    torn = judged.where("agreed = false").join(asked, "id")
    third_prompt = prompts.reconcile_prompt(F.col("name"), F.col("old_code"), F.col("new_code"), F.col("note"), F.col("a.differences"), F.col("b.differences"))
    three = settle(reconcile(torn.select("id", F.lit(3).alias("sample"), third_prompt.alias("prompt"))).select("id", F.col("reply").alias("reply3"), F.col("error").alias("error3")), "third")
    full = judged.join(three, "id", "left").withColumn("c", verdict(F.col("reply3")))
    apart = F.coalesce(~F.col("agreed"), F.lit(False))
    return full.select(
        "id",
        F.coalesce("c", "a").alias("verdict"),
        F.when(F.col("a").isNull(), 0).when(F.col("b").isNull(), 1).when(F.col("c").isNull(), 2).otherwise(3).alias("samples"),
        F.col("b").isNotNull().alias("checked"),
        "agreed",
        apart.alias("flagged"),
        F.coalesce("error", "error2", "error3").alias("error"),
        F.when(apart, draft_view(F.col("a"))).alias("draft_1"),
        F.when(apart, draft_view(F.col("b"))).alias("draft_2"),
    )


SINGLE = "struct<summary:string,security_relevant:boolean,risk:string,explanation:string>"


def summarize(functions: DataFrame, ask: Ask, config: dict) -> DataFrame:
    """functions (id, situation: new or removed, name, code, related) -> id, situation,
    summary, security_relevant, risk, explanation, error; other situations are an error."""
    known = F.col("situation").isin("new", "removed")
    prompt = prompts.single_prompt(F.col("name"), F.col("code"), note_of(F.col("related"), config))
    replies = ask(functions.where(known).select("id", F.lit(1).alias("sample"), prompt.alias("prompt"))).select("id", "reply", "error")
    full = functions.select("id", "situation").join(replies, "id", "left").withColumn("r", F.from_json("reply", SINGLE))
    or_else = lambda k, v: F.when(F.col("reply").isNotNull(), F.coalesce(F.col(f"r.{k}"), F.lit(v))).alias(k)
    return full.select(
        "id", "situation", or_else("summary", ""), or_else("security_relevant", False), or_else("risk", "low"), or_else("explanation", ""),
        F.when(~known, "situation must be new or removed").otherwise(F.col("error")).alias("error"),
    )


def save_progress(results: DataFrame, path: str, batch: int) -> None:
    """Adds a batch of results; one that is written again takes the place of its first writing."""
    results.write.mode("overwrite").parquet(f"{path}/batch={batch}")
