"""Naming defects, and rounds of correction until none is left."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import settle

DELEGATES = r"(?:forwards?|delegates?|calls?|returns?(?: the result of)?)"


def is_specific(name: Column) -> Column:
    """Not one of the shared wrapper_ labels, unless it carries a number of its own."""
    return ~name.startswith("wrapper_") | name.rlike(r"_\d+$")


def current(rows: DataFrame) -> DataFrame:
    return rows.where((F.col("status") == "approved") & (F.trim(F.coalesce("new_name", F.lit(""))) != ""))


def conflicts(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """(address, defect): collision, the name of one's own callee; self-reference, a
    description that hands over to one's own name. edges (caller, callee) have the key form."""
    mine = current(rows).where(is_specific(F.col("new_name"))).select("address", "new_name", "summary", "reason")
    shown = F.trim(F.coalesce(F.nullif("new_name", F.lit("")), "old_name"))
    callee = rows.select(F.col("address").alias("callee"), shown.alias("callee_name")).where("callee_name <> ''")
    same = (
        mine.join(edges, mine["address"] == edges["caller"])
        .join(callee, "callee")
        .where("new_name = callee_name")
        .select("address")
        .distinct()
        .withColumn("collides", F.lit(True))
    )
    text = F.concat_ws(" ", F.coalesce("summary", F.lit("")), F.coalesce("reason", F.lit("")))
    own = F.regexp_replace(F.col("new_name"), r"([^A-Za-z0-9_])", r"\\$1")
    pattern = F.concat(F.lit(rf"(?i)\b{DELEGATES}\b[^.]{{0,60}}\b"), own, F.lit(r"\b"))
    found = mine.join(same, "address", "left").withColumn(
        "defect", F.when(F.col("collides"), "collision").when(F.regexp_like(text, pattern), "self-reference")
    )
    return found.where("defect IS NOT NULL").select("address", "new_name", "defect")


def duplicates(rows: DataFrame, most: int = 3) -> DataFrame:
    """(address, new_name, others): specific names that 1 to ``most`` rows with another
    body share; rows with equal bodies may share a name. Larger groups are left alone."""
    some = current(rows).where(is_specific(F.col("new_name"))).select("address", "new_name", "body_hash")
    by_body = some.groupBy("new_name", "body_hash").agg(F.count("*").alias("same_body"))
    by_name = some.groupBy("new_name").agg(F.count("*").alias("same_name"))
    twins = F.when(F.col("body_hash").isNotNull(), F.col("same_body")).otherwise(1)
    return (
        some.join(by_body, (some["new_name"] == by_body["new_name"]) & some["body_hash"].eqNullSafe(by_body["body_hash"]))
        .select(some["*"], "same_body")
        .join(by_name, "new_name")
        .withColumn("others", F.col("same_name") - twins)
        .where((F.col("others") >= 1) & (F.col("others") <= most))
        .select("address", "new_name", "others")
    )


def repair(rows: DataFrame, edges: DataFrame, correct: Callable[[DataFrame], DataFrame], rounds: int = 3) -> tuple[DataFrame, int]:
    """Detect, correct, write, until a round changes nothing or ``rounds`` have passed.

    correct takes (address, new_name, defect) and returns (address, new_name); a name that
    an address had before in this call is refused, so that names cannot oscillate."""
    tried = settle(rows.select("address", F.array(F.coalesce("new_name", F.lit(""))).alias("tried")), "tried")
    total = 0
    for _ in range(rounds):
        found = conflicts(rows, edges).unionByName(
            duplicates(rows).select("address", "new_name", F.lit("duplicate").alias("defect"))
        )
        first = found.groupBy("address").agg(F.min("defect").alias("defect"), F.first("new_name").alias("new_name"))
        fixed = correct(first).select("address", F.col("new_name").alias("fixed_name")).join(tried, "address")
        fixed = settle(fixed.where(~F.array_contains("tried", F.col("fixed_name"))).select("address", "fixed_name"), "fixed")
        n = fixed.count()
        if not n:
            break
        total += n
        rows = settle(
            rows.join(fixed, "address", "left").withColumn("new_name", F.coalesce("fixed_name", "new_name")).drop("fixed_name"), "rows"
        )
        tried = settle(
            tried.join(fixed, "address", "left")
            .withColumn("tried", F.when(F.col("fixed_name").isNotNull(), F.concat("tried", F.array("fixed_name"))).otherwise(F.col("tried")))
            .drop("fixed_name"),
            "tried",
        )
    return rows, total
