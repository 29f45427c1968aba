"""Lines that several documents share, dropped everywhere but in the first of them.

Normalised lines are exploded and hashed; the smallest and the largest doc_id of a
hash tell whether two documents hold it (an aggregation that combines before the
shuffle, so a line that a third of all documents hold costs one row a task). Hashes
that one document holds go; the others meet the lines again, only (row, position,
hash) travelling, hashes of more than ``hot`` lines by a salt. Each row then drops the
positions it lost, in one pass over its split text; the lost positions go to the rows by
broadcast where they were measured small, else rows meet them in a join. All of it is
built-in.

Defined results: null or empty text is one empty line; a document without doc_id
counts as one that comes after all others; rows that repeat a doc_id are the same
document, and each loses its own lines; keys are compared by 96 bits of hash plus
their length; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, settle

LAST = 2**63 - 1
#: Hot hashes up to this number are sent to all tasks; beyond it the join is left to Spark.
SENT_HASHES = 500_000
#: Bytes of lost positions that are sent to all tasks.
SENT_BYTES = 16 << 20


def line_keys(lines):
    """The keys of an array of lines."""
    return F.transform(
        lines,
        lambda x: F.translate(
            F.btrim(x, F.lit(BLANKS)), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
        ),
    )


def dedup_lines(
    docs: DataFrame,
    min_chars: int = 10,
    key: str = "doc_id",
    text: str = "text",
    carry: tuple[str, ...] = (),
    hot: int = 4096,
) -> DataFrame:
    """Per row of docs: doc_id, n_lines, n_dropped, kept_text, and a struct ``row`` of the columns in carry."""
    rows = docs.select(
        F.col(key).alias("doc_id"),
        *([F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row")] if carry else []),
        F.coalesce(F.col(key), F.lit(LAST)).alias("d"),
        F.coalesce(F.col(text), F.lit("")).alias("body"),
    ).withColumn("th", F.xxhash64("body"))
    lines = (
        rows.select("d", "th", F.posexplode(line_keys(F.split("body", "\n", -1))).alias("pos", "k"))
        .where(F.length("k") >= min_chars)
        .select("d", "th", "pos", F.xxhash64("k").alias("h"), F.hash("k", F.length("k")).alias("g"))
    )
    shared = settle(
        lines.groupBy("h", "g")
        .agg(F.min("d").alias("first"), F.max("d").alias("last"), F.count("*").alias("c"))
        .where(F.col("first") < F.col("last"))
        .select("h", "g", "first", F.ceil(F.col("c") / hot).cast("int").alias("salts")),
        "shared",
    )
    common = shared.where("salts > 1").select("h", "g", "salts")
    if 0 < common.count() <= SENT_HASHES:
        salt = F.coalesce(F.pmod(F.xxhash64("d", "th", "pos"), "salts"), F.lit(0)).cast("int")
        lines = lines.join(F.broadcast(common), ["h", "g"], "left").select("d", "th", "pos", "h", "g", salt.alias("salt"))
        spread = shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        met = lines.join(spread, ["h", "g", "salt"])
    else:
        met = lines.join(shared, ["h", "g"])
    lost = settle(
        met.where(F.col("d") != F.col("first")).groupBy("d", "th").agg(F.collect_set("pos").alias("gone")), "lost"
    )
    small = (lost.agg(F.sum(4 * F.size("gone") + 64)).first()[0] or 0) <= SENT_BYTES
    # Columns of their own: an expression inside transform() would be computed for each line.
    joined = (
        rows.join(F.broadcast(lost) if small else lost, ["d", "th"], "left")
        .withColumn("parts", F.split("body", "\n", -1))
        .withColumn("stay", F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.coalesce("gone", F.array().cast("array<int>"))))
    )
    return joined.select(
        "doc_id",
        F.size("parts").cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("gone").isNull(), F.col("body"))
        .otherwise(F.array_join(F.transform("stay", lambda i: F.get("parts", i)), "\n"))
        .alias("kept_text"),
        *(["row"] if carry else []),
    )
