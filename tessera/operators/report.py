"""Texts for reports and prompts, from ordered aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import hex_address


def shown(row: str = "") -> Column:
    c = lambda n: F.col(f"{row}{n}")
    return F.coalesce(F.nullif(c("new_name"), F.lit("")), F.nullif(c("old_name"), F.lit("")), c("address"))


def risk_rank(risk: Column) -> Column:
    r = F.lower(F.coalesce(risk, F.lit("")))
    return F.when(r == "high", 0).when(r == "medium", 1).when(r == "low", 2).otherwise(3)


def function_line(behaviors: Column | None = None) -> Column:
    head = F.concat(
        F.lit("- "), shown(), F.lit(" [risk="), F.coalesce(F.nullif("risk", F.lit("")), F.lit("?")), F.lit("]: "), F.coalesce("summary", F.lit(""))
    )
    if behaviors is None:
        return head
    return F.when(F.size(behaviors) > 0, F.concat(head, F.lit("\n    evidence: "), F.array_join(behaviors, " | "))).otherwise(head)


def joined(pairs: Column, sep: str, key: str = "t") -> Column:
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x[key]), sep)


def capability_context(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row with the report's context: entry points, security rows by risk, other names.

    The text is one value by nature; it holds approved, analysed rows only."""
    some = rows.where(F.col("analyzed") & (F.col("status") == "approved"))
    lone = nodes.where("caller_count = 0").select(hex_address(F.col("address")).alias("address"), F.lit(True).alias("entry"))
    full = some.join(lone, "address", "left").withColumn("rank", risk_rank(F.col("risk")))
    sec = F.col("security_relevant")
    item = lambda cond, t: F.collect_list(F.when(cond, F.struct("rank", "address", t.alias("t"))))
    entry = sec & F.coalesce("entry", F.lit(False))
    out = full.agg(
        F.count_if(entry).alias("n_entries"),
        joined(item(entry, shown()), ", ").alias("entries"),
        F.count_if(sec).alias("n_security"),
        joined(item(sec, function_line()), "\n").alias("security"),
        F.count_if(~sec).alias("n_other"),
        F.array_join(F.array_sort(F.collect_set(F.when(~sec, shown()))), ", ").alias("other"),
    )
    text = F.concat(
        F.lit("=== ENTRY POINTS ("), F.col("n_entries"), F.lit(") ===\n"), F.col("entries"),
        F.lit("\n\n=== SECURITY-RELEVANT FUNCTIONS ("), F.col("n_security"), F.lit(") ===\n"), F.col("security"),
        F.lit("\n\n=== OTHER (NON-SECURITY-RELEVANT) FUNCTIONS ("), F.col("n_other"), F.lit(", names only) ===\n"), F.col("other"), F.lit("\n"),
    )
    return out.select("n_entries", "n_security", "n_other", text.alias("context"))


def is_reportable() -> Column:
    """Of a diff's results: no error, and new, removed, or judged to matter."""
    judged = F.coalesce("meaningful_diff_found", F.lit(False)) | F.coalesce("security_relevant", F.lit(False))
    return F.col("error").isNull() & (F.col("situation").isNotNull() | judged)


def diff_line() -> Column:
    tag = F.when(F.col("security_relevant"), "SECURITY")
    pair = F.concat(
        F.lit("- ["), F.coalesce(tag, F.lit("DIFF")), F.lit(" risk="), F.coalesce("risk", F.lit("?")), F.lit("] "),
        F.when(F.col("old_name") == F.col("new_name"), F.col("old_name")).otherwise(F.concat_ws(" / ", "old_name", "new_name")),
    )
    kind = F.upper("situation")
    alone = F.concat(
        F.lit("- ["), F.coalesce(tag, kind), F.lit(" risk="), F.coalesce("risk", F.lit("?")), F.lit("] ("), kind, F.lit(") "),
        F.coalesce("new_name", "old_name", F.lit("?")),
    )
    head = F.when(F.col("situation").isNull(), pair).otherwise(alone)
    summary = F.coalesce("summary", F.lit(""))
    return F.when(summary != "", F.concat(head, F.lit("\n    summary: "), summary)).otherwise(head)


def diff_context(results: DataFrame) -> DataFrame:
    some = results.where(is_reportable())
    lines = joined(F.collect_list(F.struct("ordinal", diff_line().alias("t"))), "\n")
    return some.agg(F.count("*").alias("n"), lines.alias("block")).select(
        "n", F.concat(F.lit("=== REPORTABLE CHANGES ("), F.col("n"), F.lit(") ===\n"), F.col("block"), F.lit("\n")).alias("context")
    )


def neighbour_lines(known: DataFrame, threshold: float) -> DataFrame:
    """known (address, place, shown, confidence, security_relevant, summary) -> (address, lines)."""
    low = F.coalesce("confidence", F.lit(0.0)) < threshold
    text = F.coalesce(F.nullif("summary", F.lit("")), F.lit("(no summary)"))
    weak = F.format_string("  %s  [LOW CONFIDENCE %.2f] %s", F.col("shown"), F.coalesce("confidence", F.lit(0.0)), text)
    sure = F.concat(F.lit("  "), F.col("shown"), F.when(F.col("security_relevant"), " [security-relevant]").otherwise(""), F.lit(" — "), text)
    line = F.when(low, weak).otherwise(sure)
    return known.groupBy("address").agg(joined(F.collect_list(F.struct("place", line.alias("t"))), "\n").alias("lines"))


def signal_lines(nodes: DataFrame, referrers: int = 20) -> DataFrame:
    """Per function, what the graph says of it: (address, signals).

    nodes may have indirectly_referenced and code_referrers."""
    n = F.col("caller_count")
    indirect = F.coalesce(F.col("indirectly_referenced"), F.lit(False)) if "indirectly_referenced" in nodes.columns else F.lit(False)
    refs = F.col("code_referrers") if "code_referrers" in nodes.columns else F.array().cast("array<string>")
    role = F.when(n <= 3, " (few — likely a distinct code path, not shared utility)").when(n >= 20, " (many — likely shared utility/glue)").otherwise("")
    sinks = F.array_distinct("dangerous_sink_calls")
    lines = F.array(
        F.when(F.size(sinks) > 0, F.concat(F.lit("  Calls memory/allocation primitive(s): "), F.array_join(sinks, ", "))),
        F.when(F.col("input_reachable"), F.lit("  Reachable from an external input source")),
        F.when((n == 0) & indirect, "  No direct callers — invoked indirectly")
        .when(n == 0, "  No callers and not referenced as data")
        .otherwise(F.concat(F.lit("  Called from "), n.cast("string"), F.lit(" direct call site(s)"), role, F.lit("."))),
        F.when((n > 0) & indirect, F.lit("  Also referenced indirectly")),
        F.when(F.size(refs) > 0, F.concat(F.lit("  Its address is taken in the code of: "), F.array_join(F.slice(F.array_distinct(refs), 1, referrers), ", "))),
    )
    return nodes.select("address", F.array_join(F.array_compact(lines), "\n").alias("signals"))
