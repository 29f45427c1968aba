"""From cross-references to a call graph: edges, and per function its imports, sinks,
strings, constants and degrees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import bits
from ..functions.text import hex_address
from ..plans.lineage import settle


def import_names(imports: DataFrame) -> DataFrame:
    """address, module, name; nameless imports are named by their ordinal."""
    return imports.select(
        "address", "module", F.coalesce("name", F.concat(F.lit("ord_"), F.col("ordinal").cast("string"))).alias("name")
    )


def long_strings(strings: DataFrame) -> DataFrame:
    return strings.where(F.length(F.trim("value")) >= 2)


def edges(xrefs: DataFrame, functions: DataFrame) -> DataFrame:
    """Distinct calls between functions, without calls to oneself; first: the place of the
    first such call in the caller."""
    known = functions.select(F.col("address").alias("target"))
    return (
        xrefs.where(F.col("is_code") & (F.col("caller") != F.col("target")))
        .groupBy("caller", "target")
        .agg(F.min("item").alias("first"))
        .join(known, "target", "left_semi")
        .select("caller", F.col("target").alias("callee"), "first")
    )


def in_call_order(edges: DataFrame, other: str):
    """Distinct others of a group, by their first call where edges have it, else by address."""
    order = ["first", other] if "first" in edges.columns else [other]
    pairs = F.array_sort(F.collect_list(F.struct(*order, F.col(other).alias("other"))))
    return F.array_distinct(F.transform(pairs, lambda p: p["other"]))


def targets(functions: DataFrame, imports: DataFrame, strings: DataFrame) -> DataFrame:
    """What an address can be, as one table: (target, internal, api, string)."""
    none = F.lit(None).cast("string")
    inside = functions.select(F.col("address").alias("target"), F.lit(True).alias("internal"), none.alias("api"), none.alias("string"))
    api = import_names(imports).select("address", F.lit(None).cast("boolean"), "name", none)
    text = long_strings(strings).select("address", F.lit(None).cast("boolean"), none, "value")
    every = inside.union(api).union(text)
    return every.groupBy("target").agg(F.bool_or("internal").alias("internal"), F.max("api").alias("api"), F.max("string").alias("string"))


def imports_of(xrefs: DataFrame, functions: DataFrame, imports: DataFrame) -> DataFrame:
    """All imports that each function calls, uncapped: (address, imported_apis) in scan order."""
    api = import_names(imports).select(F.col("address").alias("target"), F.col("name").alias("api"))
    known = functions.select(F.col("address").alias("target"))
    called = xrefs.where("is_code").join(known, "target", "left_anti").join(api, "target")
    firsts = called.groupBy(F.col("caller").alias("address"), "api").agg(F.min("item").alias("item"))
    return firsts.groupBy("address").agg(_ordered("item", "api").alias("imported_apis"))


def _ordered(order: str, column: str):
    return F.transform(F.array_sort(F.collect_list(F.struct(order, column))), lambda s: s[column])


def _first(rows: DataFrame, most: int, *order: str) -> DataFrame:
    """The first rows of each caller; each task drops the others before they are dealt out."""
    place = F.row_number().over(W.partitionBy("caller").orderBy(*order))
    return rows.withColumn("__place", place).where(F.col("__place") <= most).drop("__place")


def annotations(
    xrefs: DataFrame, functions: DataFrame, imports: DataFrame, strings: DataFrame, operands: DataFrame, config: dict
) -> DataFrame:
    """Per function: import_refs and string_refs (capped, then without repeats, in scan
    order), dangerous_sink_calls and input_calls (found before the cap), constant_operands.
    Caps hold before rows are gathered, so no caller's list outgrows them."""
    g = config["graph"]
    refs = settle(
        xrefs.join(targets(functions, imports, strings), "target")
        .select(
            "caller",
            "item",
            F.when(F.col("is_code") & F.col("internal").isNull(), F.col("api")).alias("api"),
            F.when(~F.col("is_code"), F.col("string")).alias("string"),
        )
        .where("api IS NOT NULL OR string IS NOT NULL"),
        "refs",
    )
    apis, texts = refs.where("api IS NOT NULL"), refs.where("string IS NOT NULL")
    some = _first(apis, g["max_import_refs_per_node"], "item", "api").groupBy("caller").agg(_ordered("item", "api").alias("apis"))
    said = _first(texts, g["max_string_refs_per_node"], "item", "string").groupBy("caller").agg(_ordered("item", "string").alias("texts"))
    special = apis.where(F.col("api").isin(*g["dangerous_sinks"], *g["input_sink_apis"]))
    marked = special.groupBy("caller", "api").agg(F.min("item").alias("item")).groupBy("caller").agg(_ordered("item", "api").alias("marked"))
    values = operands.where(~F.col("is_offset")).select("caller", bits.signed64(F.col("value")).alias("constant"))
    values = values.where(bits.tracked_constant(F.col("constant"))).distinct()
    numbers = _first(values, g["max_constant_operands_per_node"], "constant").groupBy("caller").agg(
        F.array_sort(F.collect_list("constant")).alias("constants")
    )
    none = F.array().cast("array<string>")
    of = lambda names: F.filter(F.coalesce("marked", none), lambda x: x.isin(names))
    out = functions.withColumnRenamed("address", "caller")
    for found in (some, said, marked, numbers):
        out = out.join(found, "caller", "left")
    return out.withColumnRenamed("caller", "address").select(
        *functions.columns,
        F.coalesce(F.array_distinct("apis"), none).alias("import_refs"),
        F.coalesce(F.array_distinct("texts"), none).alias("string_refs"),
        of(g["dangerous_sinks"]).alias("dangerous_sink_calls"),
        of(g["input_sink_apis"]).alias("input_calls"),
        F.coalesce("constants", F.array().cast("array<long>")).alias("constant_operands"),
    )


def degrees(nodes: DataFrame, calls: DataFrame) -> DataFrame:
    """nodes with caller_count and callee_addresses (in the order of their first calls)."""
    ins = calls.groupBy(F.col("callee").alias("address")).agg(F.count("*").alias("caller_count"))
    outs = calls.groupBy(F.col("caller").alias("address")).agg(in_call_order(calls, "callee").alias("callee_addresses"))
    return (
        nodes.join(ins, "address", "left")
        .join(outs, "address", "left")
        .withColumn("caller_count", F.coalesce("caller_count", F.lit(0)))
        .withColumn("callee_addresses", F.coalesce("callee_addresses", F.array().cast("array<long>")))
    )


def indirect(refs: DataFrame) -> DataFrame:
    """Data references (target, section, referrer): whether a function's address is taken
    outside unwind data, and by which code."""
    real = refs.where(~F.col("section").isin(".pdata", ".xdata"))
    return real.groupBy("target").agg(
        F.lit(True).alias("indirectly_referenced"), F.array_sort(F.collect_set("referrer")).alias("code_referrers")
    )


def tainted_arguments(call_args: DataFrame, params: DataFrame) -> DataFrame:
    """Arguments (function, sink, arg_no, variable) that a parameter of the function reaches."""
    own = params.select("function", "variable")
    hit = call_args.join(own, ["function", "variable"], "left_semi")
    return hit.groupBy("function", "sink").agg(F.array_sort(F.collect_set("arg_no")).alias("tainted_args"))


def call_names(edges: DataFrame, names: DataFrame) -> DataFrame:
    """names (address, shown) -> per function the maps callee_names and caller_names, hex
    address -> the name that is shown, all of them."""
    shown = names.select(F.col("address").alias("other"), "shown")

    def side(key: str, other: str, name: str) -> DataFrame:
        pairs = edges.select(F.col(key).alias("address"), F.col(other).alias("other")).distinct().join(shown, "other")
        entry = F.struct(hex_address(F.col("other")), "shown")
        return pairs.groupBy("address").agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias(name))

    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return (
        names.select("address")
        .join(side("caller", "callee", "callee_names"), "address", "left")
        .join(side("callee", "caller", "caller_names"), "address", "left")
        .select("address", F.coalesce("callee_names", empty).alias("callee_names"), F.coalesce("caller_names", empty).alias("caller_names"))
    )
