"""What is known of a function, gathered in one row for a prompt."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from ..functions.text import hex_address
from . import kb, scan
from .prompts import known_type

#: The fields of an extracted context.
FIELDS = (
    "address current_name prototype type_signature pseudocode pseudocode_truncated strings imported_apis callees"
    " callee_addr_names callers caller_addr_names indirectly_referenced indirect_code_referrers comments"
).split()


def extracted(functions: DataFrame, sources: dict[str, DataFrame], config: dict) -> DataFrame:
    """One row a function with FIELDS (address as hexadecimal text).

    functions: address, name. sources: bodies (address, code), types (address, signature),
    comments (address, comment), xrefs, imports, strings, data_refs (target, section,
    referrer); the first is needed, others may be absent."""
    spark = functions.sparkSession
    given = lambda name, ddl: sources[name] if name in sources else spark.createDataFrame([], ddl)
    most = config["analysis"]["max_pseudocode_lines"]
    bodies = sources["bodies"].select("address", text.trim_lines(text.strip_own_comment(F.col("code")), most).alias("b"))
    types = given("types", "address long, signature string").select("address", F.col("signature").alias("type_signature"))
    notes = given("comments", "address long, comment string").where(~text.is_own_comment(F.col("comment")))
    notes = notes.groupBy("address").agg(F.array_sort(F.collect_set("comment")).alias("comments"))
    xrefs = given("xrefs", "caller long, item long, target long, is_code boolean")
    apis = scan.imports_of(xrefs, functions, given("imports", "address long, module string, name string, ordinal long"))
    said = scan.long_strings(given("strings", "address long, value string")).select(F.col("address").alias("target"), "value")
    said = xrefs.where("NOT is_code").join(said, "target").groupBy(F.col("caller").alias("address"), "value").agg(F.min("item").alias("item"))
    said = said.groupBy("address").agg(F.transform(F.array_sort(F.collect_list(F.struct("item", "value"))), lambda x: x["value"]).alias("strings"))
    taken = scan.indirect(given("data_refs", "target long, section string, referrer string")).withColumnRenamed("target", "address")
    names = scan.call_names(scan.edges(xrefs, functions), functions.select("address", F.col("name").alias("shown")))
    full = functions.select("address", F.col("name").alias("current_name"))
    for part in (bodies, types, notes, apis, said, taken, names):
        full = full.join(part, "address", "left")
    none = F.array().cast("array<string>")
    return full.select(
        hex_address(F.col("address")).alias("address"), "current_name", text.prototype(F.col("b.text")).alias("prototype"),
        F.coalesce("type_signature", F.lit("")).alias("type_signature"), F.coalesce("b.text", F.lit("")).alias("pseudocode"),
        F.coalesce("b.truncated", F.lit(False)).alias("pseudocode_truncated"), text.methods_first(F.coalesce("strings", none)).alias("strings"),
        F.coalesce("imported_apis", none).alias("imported_apis"), F.map_values("callee_names").alias("callees"),
        F.col("callee_names").alias("callee_addr_names"), F.map_values("caller_names").alias("callers"), F.col("caller_names").alias("caller_addr_names"),
        F.coalesce("indirectly_referenced", F.lit(False)).alias("indirectly_referenced"),
        F.coalesce("code_referrers", none).alias("indirect_code_referrers"), F.coalesce("comments", none).alias("comments"),
    )


def neighbour_rows(rows: DataFrame, edges: DataFrame, key: str, other: str, name: str) -> DataFrame:
    """edges (caller, callee: keys) -> (address, name): the analysed rows of the neighbours, in the order shown."""
    pairs = edges.select(F.col(key).alias("address"), F.col(other).alias("other")).distinct()
    ranked = kb.neighbour_rows(rows, pairs)
    fields = F.struct(
        F.col("other").alias("address"), "new_name", "old_name", "applied_name", "summary", F.col("confidence").cast("double").alias("confidence"), "security_relevant"
    )
    listed = ranked.groupBy("address").agg(F.array_sort(F.collect_list(F.struct("place", fields.alias("row")))).alias("l"))
    return listed.select("address", F.transform("l", lambda x: x["row"]).alias(name))


def family_rows(rows: DataFrame, most: int = 6) -> DataFrame:
    """(address, family_members, family_size): the rows of the same body that are shown."""
    families = kb.families(rows, most)
    each = families.select("address", "family_size", F.posexplode("members").alias("place", "member"))
    names = rows.select(F.col("address").alias("member"), "new_name", "old_name", "summary")
    fields = F.struct(F.col("member").alias("address"), "new_name", "old_name", "summary")
    listed = each.join(names, "member").groupBy("address").agg(
        F.max("family_size").alias("family_size"), F.array_sort(F.collect_list(F.struct("place", fields.alias("row")))).alias("l")
    )
    return listed.select("address", "family_size", F.transform("l", lambda x: x["row"]).alias("family_members"))


def contexts(extracted: DataFrame, rows: DataFrame, edges: DataFrame, signals: DataFrame) -> DataFrame:
    """extracted with what the knowledge base and the graph add: callee_rows, caller_rows,
    family_members, family_size, signals. edges and signals go by the key form."""
    full = extracted
    for part in (
        neighbour_rows(rows, edges, "caller", "callee", "callee_rows"),
        neighbour_rows(rows, edges, "callee", "caller", "caller_rows"),
        family_rows(rows),
        signals,
    ):
        full = full.join(part, "address", "left")
    family = "array<struct<address:string,new_name:string,old_name:string,summary:string>>"
    return (
        full.withColumn("callee_rows", F.coalesce("callee_rows", F.array().cast(known_type())))
        .withColumn("caller_rows", F.coalesce("caller_rows", F.array().cast(known_type())))
        .withColumn("family_members", F.coalesce("family_members", F.array().cast(family)))
        .withColumn("family_size", F.coalesce("family_size", F.lit(0)))
    )


def first_callers(edges: DataFrame, most: int = 5) -> DataFrame:
    """The first callers of each function by address: (address, caller)."""
    place = F.row_number().over(W.partitionBy("callee").orderBy("caller"))
    return edges.select("caller", "callee").distinct().withColumn("place", place).where(F.col("place") <= most).select(F.col("callee").alias("address"), "caller")


def return_blind(functions: DataFrame, bodies: DataFrame, edges: DataFrame, lines: int = 20) -> DataFrame:
    """Functions (address, name, prototype) that return something which one of their first
    callers compares with == or != in a line that calls them: (address)."""
    returns = functions.where((F.trim(F.coalesce("prototype", F.lit(""))) != "") & ~F.lower(F.trim("prototype")).startswith("void "))
    calls = first_callers(edges).join(returns.select("address", "name"), "address").join(bodies.select(F.col("address").alias("caller"), "code"), "caller")
    site = F.split(text.call_site(F.col("code"), F.col("name"), lines), "\n")
    compared = F.exists(site, lambda x: x.contains(F.col("name")) & (x.contains("==") | x.contains("!=")))
    return calls.where(compared).select("address").distinct()
