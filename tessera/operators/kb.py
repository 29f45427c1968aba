"""The knowledge base: a current-state table, kept by merging decisions into it, and
the queries over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import hex_address

KEPT_ON_UPDATE = ("applied", "applied_name", "embedding_id")


def evolve(rows: DataFrame, schema: str) -> DataFrame:
    """rows with every column of schema, missing ones null, and status filled in for
    rows of an older form: analysed with a name means approved, without rejected."""
    spark = rows.sparkSession
    want = spark.createDataFrame([], schema).schema
    out = rows.select(*(F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in want))
    old = F.col("status").isNull() & F.col("analyzed")
    named = F.coalesce(F.col("new_name"), F.lit("")) != ""
    return out.withColumn("status", F.when(old & named, "approved").when(old, "rejected").otherwise(F.col("status")))


def latest(log: DataFrame, key: str = "address", order: str = "seq") -> DataFrame:
    """The last decision of each key; combines before the shuffle."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("last")).select(key, *(F.col(f"last.{c}").alias(c) for c in rest))


def upsert(current: DataFrame, decisions: DataFrame, order: str = "seq") -> DataFrame:
    """current after decisions: the last one of each address replaces its row but for
    what was applied; an approval of higher confidence than each before it makes the row
    pending again."""
    fields = [c for c in current.columns if c != "address" and c not in KEPT_ON_UPDATE and c in decisions.columns]
    prior = current.select("address", F.lit(-1).cast("long").alias(order), F.lit(None).cast("string").alias("status"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
    steps = decisions.select("address", F.col(order).cast("long").alias(order), "status", "confidence").unionByName(prior)
    by = W.partitionBy("address").orderBy(order)
    before = F.coalesce(F.lag("confidence").over(by), F.lit(0.0))
    better = (F.col("status") == "approved") & (F.col("confidence") > before) & (F.col(order) >= 0)
    reset = steps.withColumn("better", better).groupBy("address").agg(F.coalesce(F.bool_or("better"), F.lit(False)).alias("better"))
    news = latest(decisions, order=order).select("address", F.struct(*fields).alias("new"))
    joined = current.alias("c").join(news, "address", "full_outer").join(reset, "address", "left")
    has = F.col("new").isNotNull()
    out = []
    for c in current.columns:
        if c == "address":
            out.append(F.col("address"))
        elif c in fields:
            out.append(F.when(has, F.col(f"new.{c}")).otherwise(F.col(f"c.{c}")).alias(c))
        elif c == "applied":
            pending = has & F.coalesce(F.col("c.applied"), F.lit(False)) & F.col("better")
            out.append(F.when(pending, False).otherwise(F.col("c.applied")).alias("applied"))
        else:
            out.append(F.col(f"c.{c}").alias(c))
    return joined.select(*out)


def mark(current: DataFrame, keys: DataFrame, **values: Column) -> DataFrame:
    """current with columns set in the rows whose address is in keys; values may use keys' columns."""
    hits = keys.withColumn("__hit", F.lit(True)).withColumnsRenamed({c: f"__{c}" for c in keys.columns if c != "address"})
    joined = current.join(hits, "address", "left")
    return joined.select(*(F.when(F.col("__hit"), values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in current.columns))


def after_refinement(current: DataFrame, updates: DataFrame) -> DataFrame:
    names = ("new_name", "summary", "confidence", "security_relevant", "interesting_behaviors")
    values = {c: F.col(f"__{c}") for c in names if c in updates.columns}
    return mark(current, updates, refined=F.lit(True), applied=F.lit(False), **values)


def add_edges(current: DataFrame, new: DataFrame) -> DataFrame:
    return current.unionByName(new).dropDuplicates(["caller", "callee"])


def stats(rows: DataFrame) -> DataFrame:
    """All counts in one pass."""
    named = F.coalesce(F.col("new_name"), F.lit("")) != ""
    pending = (F.col("status") == "approved") & ~F.coalesce("applied", F.lit(False)) & named
    return rows.agg(
        F.count_if("analyzed").alias("analyzed"),
        F.count_if(F.col("status") == "approved").alias("approved"),
        F.count_if(F.col("status") == "rejected").alias("rejected"),
        F.count_if("applied").alias("applied"),
        F.count_if(pending).alias("pending_apply"),
        F.count_if("refined").alias("refined"),
        F.count_if("security_relevant").alias("security"),
        F.count_if(F.coalesce(F.col("summary"), F.lit("")) != "").alias("with_summary"),
        F.count_if("pseudocode_truncated").alias("pseudocode_truncated"),
    )


def approved_unapplied(rows: DataFrame, least: float = 0.0) -> DataFrame:
    named = F.coalesce(F.col("new_name"), F.lit("")) != ""
    return rows.where(
        (F.col("status") == "approved") & ~F.coalesce("applied", F.lit(False)) & named & (F.coalesce("confidence", F.lit(0.0)) >= least)
    ).orderBy(F.desc_nulls_last("confidence"), "address")


def unrefined(rows: DataFrame, skip: float) -> DataFrame:
    unsure = F.col("confidence").isNull() | (F.col("confidence") < skip) | F.col("new_name").startswith("wrapper_")
    return rows.where(F.col("analyzed") & ~F.col("refined") & (F.col("status") == "approved") & unsure)


def truncated(rows: DataFrame) -> DataFrame:
    return rows.where("pseudocode_truncated").orderBy("address")


def for_embedding(rows: DataFrame) -> DataFrame:
    return rows.where(F.coalesce(F.col("summary"), F.lit("")) != "")


def security(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("security_relevant") & F.col("analyzed")).orderBy(F.desc_nulls_last("confidence"), "address")


def neighbour_rows(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (address, other: keys) -> analysed rows of others with a summary, in the
    order they are shown: security first, then confidence, then address."""
    known = rows.where(F.col("analyzed") & F.col("summary").isNotNull()).withColumnRenamed("address", "other")
    order = W.partitionBy("address").orderBy(F.desc("security_relevant"), F.desc_nulls_last("confidence"), "other")
    return pairs.join(known, "other").withColumn("place", F.row_number().over(order))


def families(rows: DataFrame, most: int = 6) -> DataFrame:
    """Per row with a body hash: how many other analysed rows share it, and up to
    ``most`` of them, approved first. A family's best most + 1 are found once and serve all
    its members, so nothing grows with the square of a family."""
    hashed = rows.where(F.coalesce(F.col("body_hash"), F.lit("")) != "")
    known = hashed.where("analyzed")
    rank = W.partitionBy("body_hash").orderBy(F.desc(F.coalesce(F.col("status") == "approved", F.lit(False))), F.desc_nulls_last("confidence"), "address")
    best = (
        known.withColumn("r", F.row_number().over(rank))
        .where(F.col("r") <= most + 1)
        .groupBy("body_hash")
        .agg(F.array_sort(F.collect_list(F.struct("r", "address"))).alias("best"))
    )
    sizes = known.groupBy("body_hash").agg(F.count("*").alias("size"))
    others = F.filter("best", lambda m: m["address"] != F.col("address"))
    return (
        hashed.join(sizes, "body_hash")
        .join(best, "body_hash")
        .select(
            "address",
            "body_hash",
            (F.col("size") - F.when(F.col("analyzed"), 1).otherwise(0)).alias("family_size"),
            F.transform(F.slice(others, 1, most), lambda m: m["address"]).alias("members"),
        )
    )


def review(rows: DataFrame) -> DataFrame:
    """Analysed rows as they are exported for review."""
    return rows.where("analyzed").select(
        "address",
        F.coalesce("old_name", F.lit("")).alias("old_name"),
        F.coalesce("new_name", F.lit("")).alias("new_name"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("summary", F.lit("")).alias("summary"),
        F.coalesce("risk", F.lit("")).alias("risk"),
        F.coalesce("status", F.lit("")).alias("status"),
        F.coalesce("security_relevant", F.lit(False)).alias("security_relevant"),
        F.coalesce("applied", F.lit(False)).alias("applied"),
    )


def timing(runs: DataFrame, workspace: str | None = None) -> DataFrame:
    """runs (seq, calls, elapsed, and a workspace's column) -> seconds_per_call of each
    workspace: a running average, 0.6 old and 0.4 new, each step rounded."""
    keys = [workspace] if workspace else []
    sound = runs.where("calls > 0 AND elapsed > 0").select(*keys, "seq", (F.col("elapsed") / F.col("calls")).alias("v"))
    fold = F.aggregate(
        F.array_sort(F.collect_list(F.struct("seq", "v"))),
        F.lit(None).cast("double"),
        lambda acc, x: F.round(F.when(acc.isNull(), x["v"]).otherwise(acc * 0.6 + x["v"] * 0.4), 4),
    )
    return sound.groupBy(*keys).agg(fold.alias("seconds_per_call"))


def all_rows(rows: DataFrame) -> DataFrame:
    """Every row in the order of its address as text."""
    return rows.orderBy("address")


def overlay(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """nodes under the names that the knowledge base has for them."""
    names = rows.select(F.col("address").alias("key"), "new_name", "old_name", "confidence", "status")
    joined = nodes.withColumn("key", hex_address(F.col("address"))).join(names, "key", "left")
    return joined.withColumn("shown_name", F.coalesce(F.nullif("new_name", F.lit("")), "old_name", "name"))
