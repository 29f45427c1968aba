"""Replies of a model: parsing, defaults, merging."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import settle
from ..schema import DIFFERENCE
from . import bits, text


def unfenced(content: Column) -> Column:
    """Without a Markdown fence around it."""
    inner = F.regexp_replace(F.regexp_replace(content, r"\A```[^\n]*\n?", ""), r"\n?[ \t]*```[ \t]*\s*\z", "")
    return F.when(content.startswith("```"), F.trim(inner)).otherwise(content)


def parse_reply(content: Column) -> Column:
    """struct(value variant, error): the JSON of a reply, or why there is none."""
    value = F.try_parse_json(unfenced(content))
    return F.struct(value.alias("value"), F.when(value.isNull(), "LLM response is not valid JSON").alias("error"))


def reply_content(response: Column) -> Column:
    """struct(content, error) of a server's response, given as JSON text."""
    message = F.get_json_object(response, "$.message.content")
    thinking = F.get_json_object(response, "$.message.thinking")
    plain = F.get_json_object(response, "$.response")
    has_message = F.get_json_object(response, "$.message").isNotNull()
    only_thinking = has_message & (F.trim(F.coalesce(message, F.lit(""))) == "") & (F.coalesce(thinking, F.lit("")) != "")
    return F.struct(
        F.when(only_thinking, None).when(has_message, F.trim(F.coalesce(message, F.lit("")))).otherwise(F.trim(plain)).alias("content"),
        F.when(only_thinking, "Model returned only reasoning")
        .when(~has_message & plain.isNull(), "Unrecognised response structure")
        .alias("error"),
    )


def difference(d: Column) -> Column:
    """A difference with its defaults."""
    return F.struct(
        F.coalesce(d["meaningful"], F.lit(True)).alias("meaningful"),
        F.coalesce(d["summary"], F.lit("")).alias("summary"),
        F.coalesce(d["security_relevant"], F.lit(False)).alias("security_relevant"),
        F.coalesce(d["risk"], F.lit("low")).alias("risk"),
        F.coalesce(d["explanation"], F.lit("")).alias("explanation"),
    )


def differences(raw: Column) -> Column:
    """The differences of a verdict given as JSON text: its list, or its flat form as one."""
    listed = F.from_json(F.get_json_object(raw, "$.differences"), f"array<struct<{DIFFERENCE.replace(' ', ': ').replace(',:', ',')}>>")
    flat = F.from_json(raw, "map<string,string>")
    key = F.get(
        F.filter(F.map_keys(flat), lambda k: F.lower(k).contains("meaning") & F.lower(k).contains("found")), F.lit(0)
    )
    summary = F.coalesce(flat["diff_summary"], F.lit(""))
    meaningful = F.when(key.isNotNull(), F.coalesce(F.element_at(flat, key), F.lit("")).isin("true", "1")).otherwise(summary != "")
    one = F.struct(
        meaningful.alias("meaningful"),
        summary.alias("summary"),
        (F.coalesce(flat["security_relevant"], F.lit("false")) == "true").alias("security_relevant"),
        F.coalesce(flat["risk"], F.lit("low")).alias("risk"),
        F.coalesce(flat["explanation"], F.lit("")).alias("explanation"),
    )
    none = F.from_json(F.lit("[]"), f"array<struct<{DIFFERENCE.replace(' ', ': ').replace(',:', ',')}>>")
    found = F.filter(F.coalesce(listed, none), lambda d: d.isNotNull())
    return F.when(F.size(F.coalesce(listed, none)) > 0, F.transform(found, difference)).otherwise(
        F.when(summary != "", F.array(one)).otherwise(none)
    )


def rolled_up(items: Column) -> Column:
    """One verdict of an array of differences: any, any, the highest risk, texts joined."""
    rank = lambda r: F.when(r == "high", 2).when(r == "medium", 1).otherwise(0)
    top = F.aggregate(
        items,
        F.lit(None).cast("string"),
        lambda best, d: F.when(best.isNull() | (rank(d["risk"]) > rank(best)), d["risk"]).otherwise(best),
    )
    texts = lambda k: F.array_join(F.filter(F.transform(items, lambda d: d[k]), lambda x: x != ""), "\n")
    return F.struct(
        F.exists(items, lambda d: d["meaningful"]).alias("meaningful_diff_found"),
        texts("summary").alias("diff_summary"),
        F.exists(items, lambda d: d["security_relevant"]).alias("security_relevant"),
        F.coalesce(top, F.lit("low")).alias("risk"),
        texts("explanation").alias("explanation"),
    )


def drafts_agree(a: Column, b: Column) -> Column:
    same = F.lit(True)
    for k in ("meaningful_diff_found", "security_relevant", "risk"):
        same = same & a[k].eqNullSafe(b[k])
    return same


def refined(raw: Column, row: Column) -> Column:
    """A row's fields after a refinement: what the reply (a struct of strings) states wins."""
    said = lambda k: F.when(F.trim(raw[k]) != "", F.trim(raw[k]))
    return F.struct(
        F.coalesce(said("suggested_name"), row["new_name"]).alias("new_name"),
        F.coalesce(said("summary"), row["summary"], F.lit("")).alias("summary"),
        F.coalesce(raw["confidence"].try_cast("double"), row["confidence"], F.lit(0.0)).alias("confidence"),
        F.coalesce(raw["security_relevant"].try_cast("boolean"), row["security_relevant"], F.lit(False)).alias("security_relevant"),
    )


def response_changed(raw: Column, current: Column) -> Column:
    """Whether a reply changes a row; a different name outweighs the reply's own flag."""
    name = F.trim(F.coalesce(raw["suggested_name"], F.lit("")))
    return (
        F.coalesce(raw["changed"].try_cast("boolean"), F.lit(False))
        | F.coalesce(~raw["no_change"].try_cast("boolean"), F.lit(False))
        | ((name != "") & ~name.eqNullSafe(current))
    )


def behaviors(raw: Column, most: int = 5) -> Column:
    return F.slice(F.filter(F.transform(raw, lambda x: F.trim(x)), lambda x: x != ""), 1, most)


def is_truncation(error: Column) -> Column:
    return error.contains("is not valid JSON") | error.contains("only reasoning")


def decoded(rows: DataFrame) -> DataFrame:
    """Stored rows with lists as lists and flags as booleans: lists are kept as JSON texts
    (null or broken is empty), flags as numbers."""
    lists = ("interesting_behaviors", "callee_summaries_used")
    flags = ("security_relevant", "analyzed", "refined", "applied", "pseudocode_truncated")
    out = {}
    for c, kind in rows.dtypes:
        if c in lists and kind == "string":
            out[c] = F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))
        elif c in flags and kind != "boolean":
            out[c] = F.coalesce(F.col(c) != 0, F.lit(False))
    return rows.withColumns(out) if out else rows


def call_sized(
    requests: DataFrame, call: Callable[[DataFrame], DataFrame], system_chars: int = 0, free_text: bool = False
) -> DataFrame:
    """requests (id, prompt) -> id, reply, error, num_ctx, prompt_chars. call takes (id, prompt,
    num_ctx) and returns (id, content, error). A reply that was cut off is asked for once more
    at the next context size, if there is one; other failures are not. Free text needs no JSON."""
    chars = F.length("prompt") + system_chars
    sized = requests.select("id", "prompt", chars.alias("prompt_chars"), bits.context_size(chars).alias("num_ctx"))

    def judged(answers: DataFrame) -> DataFrame:
        broken = F.when(F.col("content").isNotNull() & F.lit(not free_text), parse_reply(F.col("content"))["error"])
        error = F.coalesce("error", broken)
        return answers.select("id", F.when(error.isNull(), F.col("content")).alias("reply"), error.alias("error"))

    first = settle(judged(call(sized.select("id", "prompt", "num_ctx"))), "first")
    larger = F.try_element_at(F.filter(F.array(*map(F.lit, bits.CONTEXT_SIZES)), lambda s: s > F.col("num_ctx")), F.lit(1))
    cut = sized.join(first.where(is_truncation(F.col("error"))).select("id"), "id", "left_semi").withColumn("num_ctx", larger).where("num_ctx IS NOT NULL")
    again = settle(judged(call(cut.select("id", "prompt", "num_ctx"))).join(cut.select("id", "num_ctx"), "id"), "again")
    more = again.select("id", F.struct("reply", "error", "num_ctx").alias("more"))
    full = sized.join(first, "id", "left").join(more, "id", "left")
    pick = lambda c: F.when(F.col("more").isNotNull(), F.col(f"more.{c}")).otherwise(F.col(c)).alias(c)
    return full.select("id", pick("reply"), pick("error"), pick("num_ctx"), "prompt_chars")


def resolve_model(models: DataFrame, wanted: str) -> DataFrame:
    """models (name, parameter_size, size) -> (name, changed): the wanted one where a name
    holds it or is held by it, else the largest by parameters; no rows without models."""
    held = F.col("name").contains(wanted) | F.lit(wanted).contains(F.col("name"))
    size = F.coalesce(text.billions(F.coalesce("parameter_size", F.lit("")), F.coalesce("size", F.lit(0))), F.lit(0.0))
    best = models.agg(F.bool_or(held).alias("there"), F.max_by("name", F.struct(size, "name")).alias("largest")).where("there IS NOT NULL")
    return best.select(F.when(F.col("there"), wanted).otherwise(F.col("largest")).alias("name"), (~F.col("there")).alias("changed"))
