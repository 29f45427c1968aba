"""Views of a graph as they are listed: lines of functions, search results, one function with
its neighbours, paths. Every view is a table whose rows are lines in a given order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import hex_address
from . import graph, kb

# How much of a function a view shows.
SINKS_SHOWN, SINKS_IN_PATH, IMPORTS_SHOWN, STRINGS_SHOWN, NEIGHBOURS_SHOWN, BEHAVIORS_SHOWN = 3, 2, 10, 8, 15, 5
LISTED = 40


def describe(name: Column, total: Column) -> Column:
    """One line on a function: address, name, score, callers, blocks, flags."""
    flags = F.concat_ws(
        " ",
        F.when(F.col("input_reachable"), "INPUT"),
        F.when(F.size("dangerous_sink_calls") > 0, F.concat(F.lit("SINK:"), F.array_join(F.slice("dangerous_sink_calls", 1, SINKS_SHOWN), ","))),
    )
    scored = F.when(total.isNull(), "     ").otherwise(F.format_string("%5.1f", total))
    return F.format_string(
        "  0x%s %s %s  callers=%s bb=%s %s",
        F.rpad(F.hex("address"), 12, " "), F.rpad(F.substring(name, 1, 34), 34, " "), scored,
        F.rpad(F.col("caller_count").cast("string"), 5, " "), F.rpad(F.col("basic_block_count").cast("string"), 4, " "), flags,
    )


def listed(nodes: DataFrame, rows: DataFrame, scores: DataFrame, chosen: DataFrame, limit: int = LISTED) -> DataFrame:
    """chosen (address, place) -> (place, address, line): the first ``limit`` as lines, under
    the knowledge base's names, with its mark and summary. Only these few rows meet the graph."""
    few = chosen.select("address", "place").orderBy("place").limit(limit)
    shown = kb.overlay(nodes.join(F.broadcast(few), "address"), rows.drop("score"))
    known = rows.select(F.col("address").alias("key"), "summary", "security_relevant")
    full = shown.join(known, "key", "left").join(scores.select("address", "total"), "address", "left")
    mark = F.when(F.col("security_relevant"), " [SEC]").otherwise("")
    said = F.trim(F.coalesce("summary", F.lit("")))
    tail = F.when(said != "", F.concat(F.lit("\n" + " " * 17), said)).otherwise("")
    line = F.concat(describe(F.col("shown_name"), F.col("total")), mark, tail)
    return full.select("place", "address", line.alias("line"))


def found(nodes: DataFrame, query: str, limit: int = LISTED) -> DataFrame:
    """Matches by kind, each with the number of matches shown in all: (kind, address, name, total)."""
    hits = graph.find(nodes, query, limit)
    return hits.join(F.broadcast(hits.agg(F.count("*").alias("total"))))


def explore(nodes: DataFrame, edges: DataFrame, rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """chosen (address) -> one row each: the function's facts, what the knowledge base says
    of it, how many call it and are called, and the first of both under their shown names."""
    some = kb.overlay(nodes.join(F.broadcast(chosen), "address", "left_semi"), rows.drop("score"))
    known = rows.select(F.col("address").alias("key"), "summary", "security_relevant")
    names = kb.overlay(nodes.select("address", "name"), rows.drop("score")).select(F.col("address").alias("other"), "shown_name")

    def side(key: str, other: str, name: str) -> DataFrame:
        pairs = edges.select(F.col(key).alias("address"), F.col(other).alias("other"))
        near = pairs.join(F.broadcast(chosen), "address", "left_semi").join(names, "other")
        place = F.row_number().over(W.partitionBy("address").orderBy("other"))
        count = F.count("*").over(W.partitionBy("address"))
        top = near.withColumn("place", place).withColumn("n", count).where(F.col("place") <= NEIGHBOURS_SHOWN)
        return top.groupBy("address").agg(
            F.max("n").alias(f"n_{name}"),
            F.transform(F.array_sort(F.collect_list(F.struct("place", "shown_name"))), lambda x: x["shown_name"]).alias(name),
        )

    none = F.array().cast("array<string>")
    full = (
        some.join(known, "key", "left")
        .join(side("callee", "caller", "callers"), "address", "left")
        .join(side("caller", "callee", "callees"), "address", "left")
    )
    return full.select(
        "address", "shown_name", "size_bytes", "basic_block_count", "caller_count", "input_reachable",
        "dangerous_sink_calls", F.slice("import_refs", 1, IMPORTS_SHOWN).alias("imports"),
        F.transform(F.slice("string_refs", 1, STRINGS_SHOWN), lambda s: F.substring(s, 1, 70)).alias("strings"),
        "status", "summary", F.coalesce("security_relevant", F.lit(False)).alias("security_relevant"),
        F.coalesce("n_callers", F.lit(0)).alias("n_callers"), F.coalesce("callers", none).alias("callers"),
        F.coalesce("n_callees", F.lit(0)).alias("n_callees"), F.coalesce("callees", none).alias("callees"),
    )


def describe_paths(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """paths (path_no, path: addresses) -> (path_no, text): a step a line, indented, with its sinks."""
    steps = paths.select("path_no", F.posexplode("path").alias("step", "address"))
    full = steps.join(nodes.select("address", "name", "dangerous_sink_calls"), "address", "left")
    sinks = F.when(F.size("dangerous_sink_calls") > 0, F.concat(F.lit("   ["), F.array_join(F.slice("dangerous_sink_calls", 1, SINKS_IN_PATH), ","), F.lit("]")))
    line = F.concat(
        F.lit("    "), F.expr("repeat('  ', step)"), F.when(F.col("step") > 0, "└─ ").otherwise(""),
        hex_address(F.col("address")), F.lit("  "), F.coalesce("name", F.lit("?")), F.coalesce(sinks, F.lit("")),
    )
    each = full.groupBy("path_no").agg(F.array_sort(F.collect_list(F.struct("step", line.alias("line")))).alias("l"))
    return each.select("path_no", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))


def distinct_on_paths(paths: DataFrame) -> DataFrame:
    """(paths, functions): how many paths, over how many different functions."""
    return paths.select("path_no", F.explode("path").alias("address")).agg(
        F.count_distinct("path_no").alias("paths"), F.count_distinct("address").alias("functions")
    )


def hit_line(rank: Column, similarity: Column | None = None) -> Column:
    """A search result: rank, address, name, confidence, marks, then summary and behaviors."""
    name = F.coalesce(F.nullif("new_name", F.lit("")), F.nullif("old_name", F.lit("")), F.lit("?"))
    mark = F.when(F.col("security_relevant"), " [SECURITY]").otherwise("")
    sim = F.lit("") if similarity is None else F.format_string("  sim=%.3f", similarity)
    head = F.concat(
        F.format_string("  #%3d  %s %s conf=%.2f", rank, F.rpad("address", 14, " "), F.rpad(name, 40, " "), F.coalesce("confidence", F.lit(0.0))), mark, sim
    )
    return F.concat_ws("\n         ", head, F.nullif("summary", F.lit("")))


def status_line(stats: DataFrame, graph_nodes: int | None, vectors: int, stale: bool) -> DataFrame:
    """What has been done for a program, as one row: its counts, and the state of graph and index."""
    graph_state = "not built" if graph_nodes is None else "cached"
    index = "not built" if not vectors else f"stale ({vectors} vectors)" if stale else f"{vectors} vectors"
    return stats.select("*", F.lit(graph_state).alias("call_graph"), F.lit(index).alias("semantic_index"))
