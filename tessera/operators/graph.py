"""Walks over a call graph, breadth first: one join of the frontier with the edges a
step, against what has been seen. Each step's state is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.lineage import counted, settle
from ..plans.ranks import places
from .scan import in_call_order

# Names that mark an entry point.
ENTRY_NAMES = "main wmain winmain wwinmain dllmain start tlscallback dllentrypoint entry".split()

#: Rows of a frontier that are sent to all tasks; larger ones meet the edges in a shuffle.
SENT_ROWS = 200_000


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("callee").alias("caller"), F.col("caller").alias("callee"))


def distances(edges: DataFrame, seeds: DataFrame, depth: int | None = None) -> DataFrame:
    """seeds (address) -> (address, hop): steps along calls from the nearest seed."""
    frontier, n = counted(seeds.select("address").distinct().withColumn("hop", F.lit(0)), "seen")
    seen, hop = frontier, 0
    while n and (depth is None or hop < depth):
        hop += 1
        near = F.broadcast(frontier) if n <= SENT_ROWS else frontier
        step = (
            edges.join(near, near["address"] == edges["caller"])
            .select(F.col("callee").alias("address"))
            .distinct()
            .join(seen.select("address"), "address", "left_anti")
            .withColumn("hop", F.lit(hop))
        )
        frontier, n = counted(step, "frontier")
        seen = seen.union(frontier)
        if hop % 8 == 0:
            seen = settle(seen, "seen")
    return seen


def reachable(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    return distances(edges, seeds).select("address")


def depth_from_leaves(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Steps to the nearest leaf; 0 where no leaf can be reached.

    The true distance; a sweep that never revises a node can come out larger."""
    leaves = nodes.select("address").join(edges.select(F.col("caller").alias("address")), "address", "left_anti")
    found = distances(reversed_edges(edges), leaves)
    return nodes.select("address").join(found, "address", "left").select(
        "address", F.coalesce("hop", F.lit(0)).alias("depth")
    )


def neighbours(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per function its callees in the order of their first calls, and its callers by address."""
    out = edges.groupBy(F.col("caller").alias("address")).agg(in_call_order(edges, "callee").alias("callees"))
    back = edges.groupBy(F.col("callee").alias("address")).agg(F.array_sort(F.collect_set("caller")).alias("callers"))
    none = F.array().cast("array<long>")
    return (
        nodes.select("address", "name")
        .join(out, "address", "left")
        .join(back, "address", "left")
        .select("address", "name", F.coalesce("callees", none).alias("callees"), F.coalesce("callers", none).alias("callers"))
    )


def shortest_paths(edges: DataFrame, sources: DataFrame, max_depth: int = 24) -> DataFrame:
    """sources (source) -> (source, address, hop, path): one shortest path each, of equal ones
    that which a walk in the order of calls finds first (edges may have ``first``, the place of
    a call; else by address). Each source has a row for each node it reaches, so sources are few."""
    calls = edges if "first" in edges.columns else edges.withColumn("first", F.col("callee"))
    none = F.array().cast("array<long>")
    seen = settle(
        sources.select("source", F.col("source").alias("address"), F.lit(0).alias("hop"), none.alias("calls"), F.array("source").alias("path")),
        "paths",
    )
    frontier = seen
    for hop in range(1, max_depth + 1):
        step = (
            frontier.join(calls, frontier["address"] == calls["caller"])
            .groupBy("source", F.col("callee").alias("next"))
            .agg(F.min(F.struct(F.concat("calls", F.array("first")).alias("calls"), "path")).alias("best"))
            .withColumnRenamed("next", "address")
            .join(seen.select("source", "address"), ["source", "address"], "left_anti")
            .select("source", "address", F.lit(hop).alias("hop"), "best.calls", F.concat("best.path", F.array("address")).alias("path"))
        )
        frontier, n = counted(step, "paths")
        if not n:
            break
        seen = seen.union(frontier)
    return seen.drop("calls")


def entry_points(nodes: DataFrame) -> DataFrame:
    """Named entries by name, then functions that none calls, the largest first: (address, place)."""
    bare = F.regexp_replace(F.lower("name"), "^_+", "")
    named = bare.rlike("^(" + "|".join(ENTRY_NAMES) + ")")
    found = nodes.where(named | (F.col("caller_count") == 0)).select(
        "address",
        "name",
        F.when(named, 0).otherwise(1).alias("segment"),
        F.when(named, F.col("name")).alias("by_name"),
        F.when(named, 0).otherwise(-F.col("size_bytes")).alias("by_size"),
    )
    ranked = places(found, "segment", F.asc_nulls_last("by_name"), "by_size", "address")
    return ranked.select("address", "name", "segment", "place")


def paths_to_sinks(nodes: DataFrame, edges: DataFrame, scores: DataFrame, limit: int = 15, sources: int = 12) -> DataFrame:
    """For the best-scored functions that call a sink: the path from the first entry point that reaches them."""
    starts = entry_points(nodes).where(F.col("place") <= sources).select(F.col("address").alias("source"), "place")
    paths = shortest_paths(edges, starts.select("source")).where("hop > 0").join(starts, "source")
    sinks = nodes.where(F.size("dangerous_sink_calls") > 0).select("address").join(scores.select("address", "total"), "address")
    first = W.partitionBy("address").orderBy("place")
    return (
        paths.join(sinks, "address")
        .withColumn("rank", F.row_number().over(first))
        .where("rank = 1")
        .orderBy(F.desc("total"), "address")
        .limit(limit)
        .select("address", "source", "hop", "path", "total")
    )


def find(nodes: DataFrame, query: str, limit: int = 40) -> DataFrame:
    """What matches a text by name, else by string, else by import, each up to limit: (kind, address, name)."""
    q = query.strip().lower()
    inside = lambda c: F.exists(F.coalesce(c, F.array().cast("array<string>")), lambda s: F.lower(s).contains(q))
    kind = (
        F.when(F.lower("name").contains(q), "name")
        .when(inside(F.col("string_refs")), "string")
        .when(inside(F.col("import_refs")), "import")
    )
    if not q:
        return nodes.where(F.lit(False)).select(F.lit("").alias("kind"), "address", "name")
    if q.startswith("0x") and all(c in "0123456789abcdef" for c in q[2:]) and len(q) > 2:
        hit = nodes.where(F.col("address") == int(q, 16)).select(F.lit("name").alias("kind"), "address", "name")
        if not hit.isEmpty():
            return hit
    rank = F.row_number().over(W.partitionBy("kind").orderBy("address"))
    found = nodes.select(kind.alias("kind"), "address", "name").where("kind IS NOT NULL")
    return found.withColumn("rank", rank).where(F.col("rank") <= limit).drop("rank")


def resolve(nodes: DataFrame, kb: DataFrame, names: DataFrame) -> DataFrame:
    """names (query) -> (query, address, how): by address, exact name, the only partial
    match, or the only row of the knowledge base with that new name."""
    q = names.select("query").distinct()
    typed = q.where(F.col("query").rlike("^0[xX][0-9A-Fa-f]+$")).select(
        "query", F.conv(F.substring("query", 3, 16), 16, 10).cast("long").alias("address"), F.lit(0).alias("rank")
    )
    exact = q.join(nodes, q["query"] == nodes["name"]).groupBy("query").agg(F.min("address").alias("address")).withColumn("rank", F.lit(1))
    partial = (
        q.join(nodes, F.lower(nodes["name"]).contains(F.lower(q["query"])))
        .groupBy("query")
        .agg(F.min("address").alias("address"), F.count("*").alias("n"))
        .select("query", F.when(F.col("n") == 1, F.col("address")).alias("address"), F.lit(2).alias("rank"))
    )
    known = (
        q.join(kb, q["query"] == kb["new_name"])
        .groupBy("query")
        .agg(F.min("address").alias("a"), F.count("*").alias("n"))
        .where("n = 1")
        .select("query", F.conv(F.substring("a", 3, 16), 16, 10).cast("long").alias("address"), F.lit(3).alias("rank"))
    )
    best = typed.union(exact).union(partial).union(known).groupBy("query").agg(F.min_by("address", "rank").alias("address"), F.min("rank").alias("rank"))
    how = F.element_at(F.array(*map(F.lit, ("address", "exact", "partial", "knowledge base"))), F.col("rank") + 1)
    return best.select("query", "address", F.when(F.col("address").isNull(), "ambiguous").otherwise(how).alias("how"))


def relatedness(edges: DataFrame, items: DataFrame) -> DataFrame:
    """Calls among items (address, name), seen from both ends: (address, other, other_name, relation)."""
    a = items.select(F.col("address").alias("caller"), F.col("name").alias("caller_name"))
    b = items.select(F.col("address").alias("callee"), F.col("name").alias("callee_name"))
    both = edges.where("caller <> callee").join(a, "caller").join(b, "callee")
    return both.select(
        F.inline(
            F.array(
                F.struct(F.col("caller").alias("address"), F.col("callee").alias("other"), F.col("callee_name").alias("other_name"), F.lit("calls").alias("relation")),
                F.struct(F.col("callee").alias("address"), F.col("caller").alias("other"), F.col("caller_name").alias("other_name"), F.lit("called_by").alias("relation")),
            )
        )
    )


def leaves_first(items: DataFrame, related: DataFrame) -> DataFrame:
    """Items by how many others of the set they call: (address, name, calls_within, place)."""
    calls = related.where("relation = 'calls'").groupBy("address").agg(F.count("*").alias("calls_within"))
    counted = items.join(calls, "address", "left").select("address", "name", F.coalesce("calls_within", F.lit(0)).alias("calls_within"))
    return places(counted, "calls_within", "address")


def overview(nodes: DataFrame, analyzed: DataFrame, prefixes: list[str]) -> DataFrame:
    auto = F.col("name").rlike("^(" + "|".join(prefixes) + ")")
    bare = F.regexp_replace(F.lower("name"), "^_+", "")
    entry = bare.rlike("^(" + "|".join(ENTRY_NAMES) + ")") | (F.col("caller_count") == 0)
    counts = nodes.agg(
        F.count("*").alias("functions"),
        F.count_if(auto).alias("auto_named"),
        F.count_if(entry).alias("entry_points"),
        F.count_if(F.size("dangerous_sink_calls") > 0).alias("sink_callers"),
        F.count_if("input_reachable").alias("input_reachable"),
        F.count_if(F.size("import_refs") > 0).alias("with_imports"),
    )
    static = (F.col("sink_callers") == 0) & (F.col("input_reachable") == 0) & (F.col("with_imports") == 0)
    return counts.join(F.broadcast(analyzed.agg(F.count_if("analyzed").alias("analyzed")))).withColumn("statically_linked", static)


def top_imports(nodes: DataFrame, most: int = 12) -> DataFrame:
    each = nodes.select(F.explode("import_refs").alias("api"))
    return each.groupBy("api").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "api").limit(most)
