"""Decisions on proposals: whether a reply is accepted, and what becomes of a name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import snake_case, with_call_number

REQUIRED = ("should_rename", "suggested_name", "confidence", "reason")


def starts_with_any(name: Column, prefixes: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, prefixes)), lambda p: name.startswith(p))


def is_auto_named(name: Column, config: dict) -> Column:
    return starts_with_any(name, config["policy"]["auto_generated_prefixes"])


def is_candidate(name: Column, config: dict) -> Column:
    return starts_with_any(name, config["policy"]["analysis_candidate_prefixes"])


def validate(replies: DataFrame, config: dict) -> DataFrame:
    """replies (reply: JSON text, and more) with ok, why and name. Gates in order; the
    first that a reply fails gives the reason."""
    a = config["analysis"]
    keys = F.coalesce(F.json_object_keys("reply"), F.array().cast("array<string>"))
    missing = F.array_sort(F.array_except(F.array(*map(F.lit, REQUIRED)), keys))
    field = lambda k: F.get_json_object("reply", f"$.{k}")
    rename = F.regexp_extract("reply", r'"should_rename"\s*:\s*(true|false|"[^"]*"|[^,}\s]+)', 1)
    confidence = field("confidence").try_cast("double")
    reason = F.trim(F.coalesce(field("reason"), F.lit("")))
    given = F.trim(F.coalesce(field("suggested_name"), F.lit("")))
    risk = F.lower(F.trim(F.coalesce(field("risk"), F.lit(""))))
    behaviors = F.coalesce(F.from_json(field("interesting_behaviors"), "array<string>"), F.array().cast("array<string>"))
    name = with_call_number(snake_case(given), reason, behaviors)
    risky = (risk == "high") & F.lit(a["skip_high_risk"]) & (confidence < a["high_risk_confidence_override"])
    why = (
        F.when(F.size(missing) > 0, F.concat(F.lit("Missing required fields: "), F.array_join(missing, ", ")))
        .when(~rename.isin("true", "false"), "should_rename must be a boolean")
        .when(rename == "false", "no rename needed")
        .when(confidence.isNull(), "confidence must be a number")
        .when(confidence < a["confidence_threshold"], "confidence below threshold")
        .when(risky, "high risk below override")
        .when(F.length(reason) < 8, "reason too short or missing")
        .when(given == "", "suggested_name is empty")
        .when(name == "", "name empty after sanitization")
        .when(~name.rlike("^[a-z]"), "name does not start with a letter")
        .when(~name.rlike("^[a-z][a-z0-9_]{3,63}$"), "name fails validation")
        .when(F.length(name) > a["max_name_length"], "name too long")
        .when(name.isin(config["policy"]["vague_names"]), "name too vague")
    )
    hedged = F.concat(F.lit(a["uncertain_prefix"]), name)
    most = a["max_name_length"]
    hedged = F.when(F.length(hedged) > most, F.regexp_replace(F.substring(hedged, 1, most), "_+$", "")).otherwise(hedged)
    final = F.when(confidence < a["uncertain_prefix_max_confidence"], hedged).otherwise(name)
    return replies.withColumns({"ok": why.isNull(), "why": F.coalesce(why, F.lit("")), "name": F.when(why.isNull(), final)})


def cheap_rejection(code: Column, config: dict) -> Column:
    """Why a body is not worth a call, or null."""
    n = F.size(F.split(code, "\n"))
    least = config["analysis"]["min_pseudocode_lines"]
    return F.when(F.trim(F.coalesce(code, F.lit(""))) == "", "no pseudocode").when(n < least, "body too short")


def may_rename(current: Column, applied: Column, config: dict) -> Column:
    """Only provisional names, and names of our own making, may be overwritten."""
    provisional = is_auto_named(current, config) | current.startswith(config["analysis"]["uncertain_prefix"]) | current.startswith("unknown_libname")
    return provisional | F.coalesce((applied != "") & (applied == current), F.lit(False))


def apply_actions(pending: DataFrame, live: DataFrame, config: dict) -> DataFrame:
    """pending (address long, new_name, applied_name, confidence, seq) against live
    (address, name): per row an action and the name it gets. Several rows that propose one
    name, or a name that is taken, get _2 to _10, then the address, in order of seq."""
    suffixes = config["policy"]["conflict_suffix_max"]
    now = pending.join(live.select("address", F.col("name").alias("current")), "address", "left")
    action = (
        F.when(F.col("current").isNull(), "error")
        .when(F.col("current") == F.col("new_name"), "same")
        .when(~may_rename(F.col("current"), F.col("applied_name"), config), "skip")
        .otherwise("apply")
    )
    acted = now.withColumn("action", action)
    base = F.regexp_replace("name", r"_([2-9]|10)$", "")
    n = F.coalesce(F.regexp_extract("name", r"_([2-9]|10)$", 1).try_cast("int"), F.lit(1))
    asked = acted.where("action = 'apply'").select("new_name").distinct()
    taken = (
        live.select(F.explode(F.array(F.struct(F.col("name").alias("new_name"), F.lit(1).alias("n")), F.struct(base.alias("new_name"), n.alias("n")))).alias("t"))
        .select("t.*")
        .join(asked, "new_name", "left_semi")
        .groupBy("new_name")
        .agg(F.collect_set("n").alias("used"))
    )
    place = F.row_number().over(W.partitionBy("new_name", "action").orderBy("seq", "address"))
    ranked = acted.withColumn("place", place).join(taken, "new_name", "left")
    free = F.array_except(F.sequence(F.lit(1), F.lit(suffixes + 1)), F.coalesce("used", F.array().cast("array<int>")))
    slot = F.get(free, F.col("place") - 1)
    unique = (
        F.when(slot == 1, F.col("new_name"))
        .when(slot.isNotNull(), F.concat_ws("_", "new_name", slot.cast("string")))
        .otherwise(F.concat(F.col("new_name"), F.lit("_"), F.lower(F.hex("address"))))
    )
    return ranked.select(
        "address",
        "current",
        "new_name",
        "action",
        F.when(F.col("action") == "apply", unique).when(F.col("action") == "same", F.col("current")).alias("final_name"),
    )
