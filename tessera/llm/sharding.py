"""Consistent-hash ring with virtual nodes and bounded loads.

The ring has 2**16 cells. Each shard owns ``vnodes`` cells at hashed places; a key
falls into the cell that the top bits of its hash name and belongs to the first
virtual node clockwise. A shard takes keys up to its bound; what overflows goes on
clockwise to the next shard with room. With ``slack`` 0 the bounds differ by one at
most, so counts do; with more slack fewer keys move when a shard is added.

Only counts by cell (a fixed number) reach the driver, which turns them into
intervals of ranks; each row then finds its interval by its rank in its cell. Rows of a
cell with more than ``HOT_SHARE`` of all rows (a key that many rows have) are ranked by
the task that read them, after those of the tasks before it, so no task ranks them all.
Facts of rows are written once, without the text, which is never shuffled.

Defined results: a null or empty text weighs 16 bytes and has CRC 0; a null doc_id
is a key like any other; repeated rows each get a slot of their own; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import settle

RING_BITS = 16
#: Share of all rows above which a cell is ranked in parts; fewer than 1 / HOT_SHARE cells.
HOT_SHARE = 1 / 512
#: Parts of hot cells that are sent to all tasks; more are joined by a shuffle.
SENT_PARTS = 500_000


def virtual_nodes(n_shards: int, vnodes: int, bits: int = RING_BITS) -> list[tuple[int, int]]:
    """(cell, shard) in ring order; a cell that two nodes hash to stays with the first."""
    taken: dict[int, int] = {}
    for shard in range(n_shards):
        for v in range(vnodes):
            digest = hashlib.blake2b(f"{shard}/{v}".encode(), digest_size=8).digest()
            taken.setdefault(int.from_bytes(digest, "big") >> (64 - bits), shard)
    return sorted(taken.items())


def bounds(total: int, n_shards: int, slack: float) -> list[int]:
    if slack > 0:
        most = -(-int(total * (1 + slack) + 1) // n_shards)
        return [most] * n_shards
    base, more = divmod(total, n_shards)
    return [base + (s < more) for s in range(n_shards)]


def place(
    counts: dict[int, int], n_shards: int, vnodes: int, slack: float, bits: int = RING_BITS
) -> list[tuple[int, int, int, int, int]]:
    """(cell, first rank, end rank, shard, first slot) for all keys of all cells."""
    ring = virtual_nodes(n_shards, vnodes, bits)
    cells = [c for c, _ in ring]
    room, used = bounds(sum(counts.values()), n_shards, slack), [0] * n_shards
    out: list[tuple[int, int, int, int, int]] = []
    waiting: list[tuple[int, int, int]] = []

    def take(cell: int, rank: int, n: int, shard: int) -> int:
        got = min(n, room[shard] - used[shard])
        if got:
            out.append((cell, rank, rank + got, shard, used[shard]))
            used[shard] += got
        return got

    for cell in sorted(counts):
        node = bisect.bisect_left(cells, cell) % len(ring)
        got = take(cell, 0, counts[cell], ring[node][1])
        if got < counts[cell]:
            waiting.append((cell, node, got))
    for cell, node, rank in waiting:
        while rank < counts[cell]:
            node = (node + 1) % len(ring)
            rank += take(cell, rank, counts[cell] - rank, ring[node][1])
    return out


def shard_rows(
    docs: DataFrame,
    n_shards: int = 40,
    vnodes: int = 256,
    slack: float = 0.0,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, shard, slot."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    spot = F.xxhash64(F.col(key))
    rows = settle(
        docs.select(
            F.col(key).alias("doc_id"),
            (F.octet_length(body) + 16).cast("long").alias("size"),
            F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
            spot.alias("spot"),
            F.shiftrightunsigned(spot, 64 - RING_BITS).cast("int").alias("cell"),
            F.spark_partition_id().alias("part"),
        ),
        "rows",
    )
    counts = {r.cell: r.n for r in rows.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    hot = [c for c, n in counts.items() if n > max(1000, HOT_SHARE * total)]
    intervals = spark.createDataFrame(
        place(counts, n_shards, vnodes, slack),
        "cell int, lo long, hi long, shard int, first long",
    )
    order = ("spot", "doc_id", "text_crc32", "size")
    if hot:
        rows = rows.withColumn("part", F.when(F.col("cell").isin(hot), F.col("part")).otherwise(-1))
        upto = W.partitionBy("cell").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
        before = (
            rows.where("part >= 0")
            .groupBy("cell", "part")
            .agg(F.count("*").alias("n"))
            .select("cell", "part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
        )
        ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy("cell", "part").orderBy(*order)) - 1)
        # A row for each hot cell and task that read some of it.
        ranked = ranked.join(F.broadcast(before) if before.count() <= SENT_PARTS else before, ["cell", "part"], "left")
        ranked = ranked.withColumn("rank", F.col("rank") + F.coalesce("before", F.lit(0)))
    else:
        ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy("cell").orderBy(*order)) - 1)
    # At most 2**16 cells plus one cut per full shard: a fixed bound, whatever the input.
    return (
        ranked.join(F.broadcast(intervals), "cell")
        .where((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
        .select(
            "doc_id",
            "size",
            "text_crc32",
            "shard",
            (F.col("first") + F.col("rank") - F.col("lo")).alias("slot"),
        )
    )
