"""Texts that a model is asked with: one row a function, built from columns by built-in
functions. Sections without content leave no line."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bits, text

NO_LINES = "array<string>"


def load_prompt(folder: str, name: str) -> str:
    """A prompt as it stands; one that is missing or empty is an error, never a default."""
    path = Path(folder) / name
    found = path.read_text(encoding="utf-8") if path.is_file() else ""
    if not found.strip():
        raise FileNotFoundError(f"prompt {path} is missing or empty")
    return found


def prompt_of_profile(profile: Column, prompts: dict[str, str], default: str) -> Column:
    """The system prompt of a profile; of an unknown one or none, that of the default."""
    out = F.lit(prompts[default])
    for name, body in prompts.items():
        out = F.when(profile == name, body).otherwise(out)
    return out


def section(head: str, lines: Column) -> Column:
    """A heading and indented lines, or null without any."""
    body = F.array_join(F.transform(lines, lambda x: F.concat(F.lit("  "), x)), "\n")
    return F.when(F.size(lines) > 0, F.concat(F.lit(f"\n{head}\n"), body))


def neighbour_lines(known: Column, bare: Column, live: Column, low: float, most_bare: int) -> Column:
    """Lines on callees or callers. known: array of structs of knowledge-base rows in the
    order shown, all of them; bare: names of neighbours, of which those that no row accounts
    for follow, the first ``most_bare``; live: map hex address -> the name shown now."""
    rows = F.coalesce(known, F.array().cast(known_type()))
    names = text.live_substitutions(rows, live)
    blank = lambda c: F.coalesce(c, F.lit(""))

    def line(r: Column) -> Column:
        label = text.display_label(r, live, names)
        said = F.coalesce(F.nullif(r["summary"], F.lit("")), F.lit("(no summary)"))
        sure = F.coalesce(r["confidence"], F.lit(0.0))
        weak = F.format_string("%s  [LOW CONFIDENCE %.2f] %s", label, sure, said)
        mark = F.when(r["security_relevant"], " [security-relevant]").otherwise("")
        return F.when(sure < low, weak).otherwise(F.concat(label, mark, F.lit(" — "), said))

    own = F.flatten(
        F.transform(rows, lambda r: F.array(text.display_label(r, live, names), blank(r["old_name"]), blank(r["new_name"]), blank(r["applied_name"])))
    )
    rest = F.filter(F.coalesce(bare, F.array().cast(NO_LINES)), lambda n: ~F.array_contains(own, n))
    return F.concat(F.transform(rows, line), F.transform(F.slice(rest, 1, most_bare), lambda n: F.concat(n, F.lit("  (not yet analyzed)"))))


def known_type() -> str:
    return (
        "array<struct<address:string,new_name:string,old_name:string,applied_name:string,"
        "summary:string,confidence:double,security_relevant:boolean>>"
    )


def family_lines(members: Column, size: Column) -> Column:
    """members: array of structs (address, new_name, old_name, summary) -> lines, none without members."""
    name = lambda m: F.coalesce(F.nullif(m["new_name"], F.lit("")), F.nullif(m["old_name"], F.lit("")), m["address"])
    said = lambda m: F.coalesce(F.nullif(m["summary"], F.lit("")), F.lit("(not yet analyzed)"))
    head = F.concat(F.lit("One body shape with "), size.cast("string"), F.lit(" other function(s); only literals or addresses differ, so a shared name is fine:"))
    lines = F.transform(members, lambda m: F.concat(name(m), F.lit(" — "), said(m)))
    return F.when(F.size(members) > 0, F.concat(F.array(head), lines)).otherwise(F.array().cast(NO_LINES))


def user_prompt(context: DataFrame, config: dict) -> DataFrame:
    """context (see context.contexts) -> address, prompt. Sections in order: name, prototype,
    type where it differs, method names, other strings, imports, signals of the graph, family,
    callees, callers, comments, body under the callees' proposed names."""
    a = config["analysis"]
    methods = text.method_names(F.col("strings"))
    others = F.filter("strings", lambda s: ~F.array_contains(methods, F.trim(s)))
    quoted = F.transform(F.slice(others, 1, a["max_referenced_strings_shown"]), lambda s: F.concat(F.lit("'"), s, F.lit("'")))
    kind = F.trim(F.coalesce("type_signature", F.lit("")))
    prototype = F.trim(F.coalesce("prototype", F.lit("")))
    low, bare = a["confidence_threshold"], a["max_unanalyzed_neighbours_shown"]
    body = text.replace_words(F.col("pseudocode"), text.live_substitutions(F.coalesce("callee_rows", F.array().cast(known_type())), F.col("callee_addr_names")))
    parts = F.array(
        F.concat(F.lit("Current name     : "), "current_name"),
        F.when(prototype != "", F.concat(F.lit("Prototype        : "), "prototype")),
        F.when((kind != "") & (kind != prototype), F.concat(F.lit("IDA type         : "), kind)),
        section("Embedded method names, one likely its own:", methods),
        section("Referenced strings:", quoted),
        section("Imported APIs called:", F.slice("imported_apis", 1, a["max_imported_apis_shown"])),
        F.when(F.coalesce("signals", F.lit("")) != "", F.concat(F.lit("\nCall-graph signals:\n"), "signals")),
        section("Structural family:", family_lines(F.col("family_members"), F.col("family_size"))),
        section("Internal callees:", neighbour_lines(F.col("callee_rows"), F.col("callees"), F.col("callee_addr_names"), low, bare)),
        section("Direct callers:", neighbour_lines(F.col("caller_rows"), F.col("callers"), F.col("caller_addr_names"), low, bare)),
        section("Analyst comments:", F.col("comments")),
        F.when(F.coalesce("pseudocode", F.lit("")) != "", F.concat(F.lit("\nPseudocode:\n```c\n"), bits.annotate(body), F.lit("\n```"))),
        F.lit("\nRespond with JSON only."),
    )
    return context.select("address", F.array_join(F.array_compact(parts), "\n").alias("prompt"))


def refine_prompt(rows: DataFrame, snippets: int = 3) -> DataFrame:
    """rows (address, new_name, old_name, live_name, summary, confidence, dangerous_sink_calls,
    input_reachable, family_members, family_size, callers: array of structs (name, confidence,
    summary, call_site), callees: array of structs (name, summary), trivial, return_blind)
    -> address, prompt. Call sites and the live name are shown where the body tells too little
    (trivial, or its return value is what callers compare), the first ``snippets`` of them."""
    base = F.coalesce(F.nullif("new_name", F.lit("")), F.nullif("old_name", F.lit("")), F.lit("?"))
    little = F.col("trivial") | F.col("return_blind")
    live = F.when(little, F.nullif("live_name", F.lit("")))
    shown = F.coalesce(live, base)
    site = lambda c: F.coalesce(c["call_site"], F.lit(""))
    with_site = F.filter(F.transform("callers", lambda c, i: F.when(site(c) != "", i)), lambda i: i.isNotNull())
    allowed = F.slice(with_site, 1, snippets)

    def caller(c: Column, i: Column) -> Column:
        head = F.format_string("  %s (conf=%.2f): %s", c["name"], F.coalesce(c["confidence"], F.lit(0.0)), F.coalesce(F.nullif(c["summary"], F.lit("")), F.lit("(no summary)")))
        quoted = F.concat(F.lit("\n    Call site of "), shown, F.lit(":\n      "), F.regexp_replace(site(c), "\n", "\n      "))
        return F.when(live.isNotNull() & F.array_contains(allowed, i), F.concat(head, quoted)).otherwise(head)

    callee = lambda c: F.concat(F.lit("  "), c["name"], F.lit(": "), F.coalesce(F.nullif(c["summary"], F.lit("")), F.lit("(no summary)")))
    family = family_lines(F.col("family_members"), F.col("family_size"))
    why = F.when(F.col("trivial"), "Its body is too small to tell its purpose").otherwise("Its return value, which callers compare, is what matters")
    parts = F.array(
        F.concat(F.lit("Function : "), shown),
        F.when(live.isNotNull() & (live != base), F.concat(F.lit("           (proposed as '"), base, F.lit("'; both are this function)"))),
        F.concat(F.lit("Address  : "), "address"),
        F.concat(F.lit("Summary  : "), F.coalesce(F.nullif("summary", F.lit("")), F.lit("(none)"))),
        F.format_string("Confidence: %.2f", F.coalesce("confidence", F.lit(0.0))),
        F.when(F.size("dangerous_sink_calls") > 0, F.concat(F.lit("Calls memory/allocation primitive(s): "), F.array_join(F.array_distinct("dangerous_sink_calls"), ", "))),
        F.when(F.col("input_reachable"), F.lit("Reachable from an external input source via the call graph.")),
        section("Structural family:", family),
        F.concat(F.lit("\nCallers, as analyzed; a call site is the evidence, a summary is background:\n"), F.array_join(F.transform("callers", caller), "\n")),
        F.when(F.size("callees") > 0, F.concat(F.lit("\nCallees; never take a callee's name or its work for this function's own:\n"), F.array_join(F.transform("callees", callee), "\n"))),
        F.when(live.isNotNull(), F.concat(F.lit("\n"), why, F.lit(". Do not repeat '"), F.array_join(F.array_distinct(F.array(shown, base)), "', '"), F.lit("' unchanged."))),
        F.lit("\nHas this context changed what the function is? Respond with JSON only."),
    )
    return rows.select("address", F.array_join(F.array_compact(parts), "\n").alias("prompt"))


def pair_prompt(name: Column, old_code: Column, new_code: Column, note: Column) -> Column:
    """Two versions of a function, to be compared."""
    return F.concat(
        F.lit("Function: "), name, F.lit("\n"), note, F.lit("\n=== OLD (pre-patch) ===\n"), old_code,
        F.lit("\n\n=== PATCHED (post-patch) ===\n"), new_code, F.lit("\n\nWhat differs in logic, if anything?\n"),
    )


def single_prompt(name: Column, code: Column, note: Column) -> Column:
    """A function that one side alone has."""
    return F.concat(F.lit("Function: "), name, F.lit("\n"), note, F.lit("\n"), code, F.lit("\n\nSummarize it and judge its security relevance.\n"))


def draft_lines(label: str, differences: Column) -> Column:
    line = lambda d: F.format_string(
        "  * meaningful=%s security_relevant=%s risk=%s: %s", d["meaningful"].cast("string"), d["security_relevant"].cast("string"), d["risk"], d["summary"]
    )
    return F.array_join(F.concat(F.array(F.lit(f"--- Independent analysis {label} ---")), F.transform(differences, line)), "\n")


def reconcile_prompt(name: Column, old_code: Column, new_code: Column, note: Column, first: Column, second: Column) -> Column:
    """Both versions with two analyses of them that disagree (arrays of differences)."""
    return F.concat(
        pair_prompt(name, old_code, new_code, note), F.lit("\n"), draft_lines("draft 1", first), F.lit("\n\n"), draft_lines("draft 2", second),
        F.lit("\n\nThe drafts disagree: read the code again and list all differences yourself.\n"),
    )
