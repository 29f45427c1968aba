"""Semantic search: cosine top-k over a vector table, boosts, and one result a family."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import dedup_key, entry_text


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(vector: Column, query: list[float]) -> Column:
    q = F.array(*(F.lit(float(x)) for x in query))
    return dot(vector, q) / (norm(vector) * norm(q))


def top_k(vectors: DataFrame, query: list[float], k: int, key: str = "address") -> DataFrame:
    """The k nearest: each task keeps its own k, so the driver sees k rows a task."""
    return vectors.select(key, cosine(F.col("embedding"), query).alias("sim")).orderBy(F.desc("sim"), key).limit(k)


def build_index(rows: DataFrame, embed: Callable[[list[str]], list[list[float] | None]]) -> DataFrame:
    """(address, embedding) of rows with a summary; what embed refuses is left out."""
    text = entry_text(F.col("new_name"), F.col("old_name"), F.col("summary"), F.col("interesting_behaviors"))

    def run(batches):
        for pdf in batches:
            pdf["embedding"] = embed(pdf["text"].tolist())
            yield pdf.loc[pdf["embedding"].notna(), ["address", "embedding"]]

    some = rows.where(F.coalesce(F.col("summary"), F.lit("")) != "").select("address", text.alias("text"))
    return some.mapInPandas(run, "address string, embedding array<float>")


def signature(rows: DataFrame) -> DataFrame:
    """One row: a hash of what would be embedded, whatever the order of rows. Hashes of
    rows are sorted and hashed in 4096 ranges, and then the ranges' hashes."""
    text = entry_text(F.col("new_name"), F.col("old_name"), F.col("summary"), F.col("interesting_behaviors"))
    some = rows.where(F.coalesce(F.col("summary"), F.lit("")) != "")
    one = some.select(F.sha1(F.concat(F.col("address"), F.lit("\x00"), text, F.lit("\x01"))).alias("h"))
    ranges = one.groupBy(F.substring("h", 1, 3).alias("r")).agg(F.sha1(F.array_join(F.array_sort(F.collect_list("h")), "")).alias("h"))
    return ranges.agg(F.sha1(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "h"))), lambda x: x["h"]), "")).alias("signature"))


def boost(config: dict) -> Column:
    s = config["search"]
    by_risk = F.create_map(*chain.from_iterable((F.lit(k), F.lit(float(v))) for k, v in s["risk_boost"].items()))
    risk = F.coalesce(by_risk[F.lower(F.trim("risk"))], F.lit(0.0))
    return risk + F.when(F.col("security_relevant"), float(s["security_relevant_boost"])).otherwise(0.0)


def one_per_family(hits: DataFrame) -> DataFrame:
    """hits (rank order: adjusted desc, address) -> the best of each body hash, or of each
    name without its number, with how many others it stands for."""
    name = F.coalesce(F.nullif("new_name", F.lit("")), F.nullif("old_name", F.lit("")), F.lit("?"))
    key = F.coalesce(F.nullif("body_hash", F.lit("")), dedup_key(name))
    by = W.partitionBy("family")
    ranked = (
        hits.withColumn("family", key)
        .withColumn("r", F.row_number().over(by.orderBy(F.desc("adjusted"), "address")))
        .withColumn("similar_count", F.count("*").over(by) - 1)
    )
    return ranked.where("r = 1").drop("r")


def semantic(vectors: DataFrame, rows: DataFrame, query: list[float], k: int, config: dict, security_only: bool = False) -> DataFrame:
    """Pool of the nearest, floor, boosts, one per family, best k."""
    s = config["search"]
    pool = top_k(vectors, query, k * s["semantic_candidate_pool_multiplier"])
    near = pool.where(F.col("sim") >= s["min_similarity"])
    hits = near.join(rows, "address")
    if security_only:
        hits = hits.where("security_relevant")
    hits = hits.withColumn("adjusted", F.col("sim") + boost(config))
    return one_per_family(hits).orderBy(F.desc("adjusted"), "address").limit(k)


def by_confidence(rows: DataFrame, k: int, security_only: bool = False) -> DataFrame:
    some = rows.where("analyzed")
    if security_only:
        some = some.where("security_relevant")
    return some.orderBy(F.desc(F.coalesce("confidence", F.lit(0.0))), "address").limit(k)


def stale(current: DataFrame, stored: str | None) -> bool:
    """Whether an index with the stored signature must be rebuilt; current has one row."""
    return stored is None or current.first()["signature"] != stored
