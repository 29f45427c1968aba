"""Near duplicates by an LSH forest over MinHash signatures, confirmed on full sets.

Texts with equal shingle sets are one class from the start. Each class has a MinHash
signature, and each tree of the forest sorts the classes by another rotation of it;
classes that share a tree's first ``depth`` hashes form a region. With 32 trees of
depth 4 a pair at the threshold 0.8 misses all regions with a chance of 5e-8.

First, neighbours in a tree's order, whose common prefix is the longest, are confirmed and
joined into components; regions of one component are then done. In the others every pair
of different components whose signatures agree enough is a candidate, in the first tree
alone that has both, and full sets travel only with rows that have one. A task takes a
region's candidates from the longest common prefix down to ``depth``, confirms them by
intersecting full sets, and skips what its links have joined meanwhile, so each region goes
as deep as it must and stops when it is one component. Each pair above the signature bound
is confirmed, rejected, or joined by other links. A region above ``block`` rows (or as many
thousand shingles) is cut into blocks compared in pairs, those of one large component never
with each other, so no task grows with a region. In a dense region of many components that
do not link, the candidates grow with its square.

Sorting is by range, so a region with a third of all rows is spread over tasks.

Defined results: a text with fewer words than a shingle has them as its one shingle;
null and empty text, and text without words, links with nothing, not even its like;
rows without doc_id link with nothing and are kept; rows that repeat a doc_id are one
node with several texts; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle
from .components import connected

#: Hashes that classes of a region share at least.
DEPTH = 4
ODD = np.uint64(0x9E3779B97F4A7C15)
#: Standard deviations of signature agreement that a pair at the threshold may fall short.
SLACK = 3.7
#: Shingles that count as one more row of a block.
SHINGLES_A_ROW = 1024
#: Rows compared at once in a task, beyond those of one pair of blocks.
AT_ONCE = 4096
#: Ids up to this number are sent to all tasks (8 bytes each); more are joined by a shuffle.
SENT_IDS = 2_000_000


def hash_words(text: str | None, seen: dict[bytes, int]) -> np.ndarray:
    words = (text or "").encode("utf-8", "replace").lower().split()
    if len(seen) > 100_000:
        seen.clear()
    out = []
    for w in words:
        if (h := seen.get(w)) is None:
            h = seen[w] = xxhash.xxh3_64_intdigest(w)
        out.append(h)
    return np.array(out, np.uint64)


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text given by its words' hashes."""
    if not len(words):
        return words
    n = max(1, len(words) - width + 1)
    h = np.zeros(n, np.uint64)
    for k in range(min(width, len(words))):
        h = (h + words[k : k + n]) * ODD
        h ^= h >> np.uint64(29)
    return np.unique(h)


class MinHash:
    def __init__(self, size: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(1, 2**63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 2**63, size, dtype=np.uint64)

    def __call__(self, items: np.ndarray) -> np.ndarray:
        out = np.full(len(self.a), 2**32 - 1, np.uint64)
        for i in range(0, len(items), 4096):
            part = items[i : i + 4096, None]
            for k in range(0, len(self.a), 16):
                s = slice(k, k + 16)
                np.minimum(out[s], ((part * self.a[s] + self.b[s]) >> np.uint64(32)).min(0), out=out[s])
        return out


def sketch(docs: DataFrame, width: int, size: int) -> DataFrame:
    """(doc_id, text) -> doc_id, n, f, g (hashes of the set), sig (two bytes a hash)."""
    ddl = "doc_id long, n long, f long, g long, sig binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minhash, seen = MinHash(size), {}
        for batch in batches:
            rows = []
            for doc_id, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                s = shingles(hash_words(x.as_py(), seen), width)
                f = xxhash.xxh3_128_intdigest(s.tobytes())
                sig = minhash(s).astype("<u2").tobytes() if len(s) else None
                rows.append((doc_id, len(s), (f >> 64) - 2**63, (f & 2**64 - 1) - 2**63, sig))
            cols = list(zip(*rows)) or [()] * 5
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "n", "f", "g", "sig"]
            )

    return docs.mapInArrow(run, ddl)


def least_agreement(threshold: float, size: int) -> int:
    least = threshold - SLACK * math.sqrt(threshold * (1 - threshold) / size)
    return max(1, math.ceil(least * size))


def signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(len(column), -1)


def alike(n: np.ndarray, k: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Whether sizes allow sets k and j to reach the threshold."""
    return np.minimum(n[k], n[j]) >= threshold * np.maximum(n[k], n[j]) - 1e-9


def neighbours(forest: DataFrame, threshold: float, parts: int) -> DataFrame:
    """forest (key, tree, rep, n, sig) -> pairs (u, v) of next neighbours in a region."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            got = (*(batch.column(i).to_numpy() for i in range(3)), signatures(batch.column(3)))
            if held is not None:
                got = tuple(np.concatenate(x) for x in zip(held, got))
            held = tuple(x[-1:].copy() for x in got)
            key, rep, n, sig = got
            k = np.nonzero((key[1:] == key[:-1]) & (rep[1:] != rep[:-1]))[0]
            k = k[alike(n, k, k + 1, threshold)]
            k = k[(sig[k] == sig[k + 1]).sum(1) >= least_agreement(threshold, sig.shape[1])]
            u, v = np.minimum(rep[k], rep[k + 1]), np.maximum(rep[k], rep[k + 1])
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    # Neighbours on two sides of a range's border meet again in their region.
    ordered = forest.repartitionByRange(parts, "key", "sig", "rep").sortWithinPartitions("key", "sig", "rep")
    return ordered.select("key", "rep", "n", "sig").mapInArrow(run, "u long, v long").distinct()


def mixed(state: DataFrame) -> DataFrame:
    """The rows of state (key, tree, rep, n, sig, label) in regions of several components, with ``size``."""
    regions = state.groupBy("key").agg(F.sum(weight()).alias("size"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    return state.join(regions.where("lo <> hi").select("key", "size"), "key")


def weight():
    return 1 + F.floor(F.col("n") / SHINGLES_A_ROW)


ROWS = ["key", "tree", "rep", "n", "label", "sig"]


def in_blocks(live: DataFrame, block: int) -> DataFrame:
    """live (ROWS, size) -> also (a, b, side): blocks compared with each other.

    Blocks of a component with ``block`` rows of a region hold it alone."""
    whole = live.where(F.col("size") <= block)
    zero = [F.lit(0).cast("long").alias(c) for c in "ab"] + [F.lit(0).alias("side")]
    large = live.where(F.col("size") > block)
    held = large.groupBy("key", "label").agg(F.sum(weight()).alias("c"))
    pooled = held.groupBy("key").agg(F.sum(F.when(F.col("c") < block, F.col("c"))).alias("rest"))
    alone = F.col("c") >= block
    owner = F.when(alone, F.col("label"))
    salts = F.ceil(F.when(alone, F.col("c")).otherwise(F.col("rest")) / block)
    shares = held.join(pooled, "key").select("key", "label", owner.alias("owner"), salts.alias("salts"))
    salt = F.pmod(F.xxhash64(F.when(F.col("owner").isNull(), F.col("label")).otherwise(F.col("rep"))), "salts")
    rows = settle(large.join(shares, ["key", "label"]).select(*ROWS, "owner", F.xxhash64("owner", salt).alias("at")), "large")
    blocks = rows.select("key", "owner", "at").distinct()
    other = blocks.withColumnsRenamed({"owner": "owner2", "at": "at2"})
    pairs = (
        blocks.join(other, "key")
        .where("at <= at2 and not (owner is not null and owner2 is not null and owner = owner2)")
        .select("key", F.col("at").alias("a"), F.col("at2").alias("b"))
    )
    sides = pairs.select("*", F.col("a").alias("at"), F.lit(0).alias("side")).union(
        pairs.where("a <> b").select("*", F.col("b").alias("at"), F.lit(1).alias("side"))
    )
    return whole.select(*ROWS, *zero).union(rows.join(sides, ["key", "at"]).select(*ROWS, "a", "b", "side"))


def candidates(key, a, b, side, tree, rep, n, label, sig, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (k, j) of rows of other labels, of one block or of two paired ones, that agree
    enough and share no earlier tree, and their common prefixes. sig: rotated, so that a
    tree's own hashes come first; rows are sorted by (key, a, b)."""
    first = np.concatenate([[True], (key[1:] != key[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    start = np.nonzero(first)[0]
    place = np.arange(len(key)) - start[np.cumsum(first) - 1]
    least = least_agreement(threshold, sig.shape[1])
    found = []
    for o in range(1, int(place.max(initial=0)) + 1):
        k = np.nonzero(place >= o)[0]
        j = k - o
        ok = (label[k] != label[j]) & ((a[k] == b[k]) | (side[k] != side[j])) & alike(n, k, j, threshold)
        k, j = k[ok], j[ok]
        for at in range(0, len(k), 1 << 15):
            p, q = k[at : at + (1 << 15)], j[at : at + (1 << 15)]
            same = sig[p] == sig[q]
            good = np.nonzero(same.sum(1) >= least)[0]
            if len(good):
                found.append((p[good], q[good], same[good]))
    none = np.zeros(0, np.int64)
    if not found:
        return none, none, none
    k, j, same = (np.concatenate(x) for x in zip(*found))
    trees = same.reshape(len(k), -1, DEPTH).all(2)
    # Of this tree's rotation, the earlier trees are the last ones.
    earlier = np.arange(trees.shape[1])[None, :] >= trees.shape[1] - tree[k][:, None]
    new = ~(trees & earlier).any(1)
    return k[new], j[new], np.where(same[new].all(1), same.shape[1], same[new].argmin(1))


class Groups(dict):
    """Labels that links have joined."""

    def top(self, x: int) -> int:
        while (y := self.get(x, x)) != x:
            self[x] = x = self.get(y, y)
        return x


def across(blocks: DataFrame, threshold: float, parts: int, members: DataFrame | None = None) -> DataFrame:
    """blocks (see in_blocks). Without members: the rows that have a candidate. With members
    (node, items), the full sets: links (u, v) of other labels."""

    def test(got: list[np.ndarray], sets: list[np.ndarray], joined: Groups) -> pa.RecordBatch:
        k, j, prefix = candidates(*got, threshold)
        rep, label = got[5].tolist(), got[7].tolist()
        links = []
        for i in np.lexsort((k, j, -prefix)).tolist():
            x, y = int(k[i]), int(j[i])
            if (g := joined.top(label[x])) == (h := joined.top(label[y])):
                continue
            both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
            if both >= threshold * (len(sets[x]) + len(sets[y]) - both) - 1e-9:
                links.append((min(label[x], label[y]), max(label[x], label[y])))
                joined[max(g, h)] = min(g, h)
        u, v = zip(*links) if links else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    names = ["key", "a", "b", "side", "tree", "rep", "n", "label", "sig"]
    confirm = members is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        sets: list[np.ndarray] = []
        joined = Groups()

        def out(to: int) -> pa.RecordBatch:
            got = [x[:to] for x in held]
            if confirm:
                return test(got, sets[:to], joined)
            k, j, _ = candidates(*got, threshold)
            rows = np.unique(np.concatenate([k, j]))
            cols = [pa.array(x[rows]) for x in got[:8]]
            return pa.RecordBatch.from_arrays([*cols, pa.array([x.tobytes() for x in got[8][rows]], pa.binary())], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            got = [*(batch.column(i).to_numpy() for i in range(8)), signatures(batch.column(8))]
            held = [np.concatenate(x) for x in zip(held, got)] if held else got
            if confirm:
                items = batch.column(9)
                ends = items.offsets.to_numpy()
                flat = items.values.to_numpy()
                sets += [flat[x:y] for x, y in zip(ends, ends[1:])]
            if len(held[0]) < AT_ONCE:
                continue
            key, a, b = held[:3]
            last = (key == key[-1]) & (a == a[-1]) & (b == b[-1])
            if cut := len(key) - int(last.sum()):
                yield out(cut)
                held, sets = [x[cut:].copy() for x in held], sets[cut:]
        if held:
            yield out(len(held[0]))

    dealt = blocks.select(*names)
    if confirm:
        dealt = dealt.join(members.withColumnRenamed("node", "rep"), "rep").select(*names, "items")
    dealt = dealt.repartition(parts, "key", "a", "b").sortWithinPartitions("key", "a", "b")
    if confirm:
        return dealt.mapInArrow(run, "u long, v long").distinct()
    return dealt.mapInArrow(run, blocks.select(*names).schema)


def full_sets(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """Full shingle sets (node, items) of the documents in nodes (node)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = [shingles(hash_words(x.as_py(), seen), width).view(np.int64) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "items"]
                )

    if nodes.count() <= SENT_IDS:
        nodes = F.broadcast(nodes)
    rows = docs.join(nodes, docs["doc_id"] == nodes["node"], "left_semi")
    return settle(rows.mapInArrow(run, "node long, items array<long>"), "sets")


def near_duplicates(
    docs: DataFrame,
    width: int = 5,
    threshold: float = 0.8,
    trees: int = 32,
    block: int = 512,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id, kept."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sketches = settle(sketch(docs, width, trees * DEPTH), "sketches")
    linkable = sketches.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    classes = settle(linkable.groupBy("f", "g").agg(F.min("doc_id").alias("rep")), "classes")
    sets = linkable.join(
        classes.withColumnsRenamed({"f": "f2", "g": "g2"}),
        (F.col("doc_id") == F.col("rep")) & (F.col("f") == F.col("f2")) & (F.col("g") == F.col("g2")),
    ).select("rep", "n", "sig")
    own = 2 * DEPTH  # bytes of a tree's first hashes
    prefix = F.expr(f"substring(sig, 1 + tree * {own}, {own})")
    leaves = sets.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).select(
        "rep", "tree", F.xxhash64("tree", prefix).alias("key")
    )
    shared = leaves.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    rotated = F.expr(f"concat(substring(sig, 1 + tree * {own}), substring(sig, 1, tree * {own}))")
    forest = settle(
        leaves.join(shared, "key", "left_semi").join(sets, "rep").select("key", "tree", "rep", "n", rotated.alias("sig")),
        "forest",
    )
    members = full_sets(docs, forest.select(F.col("rep").alias("node")).distinct(), width)
    pairs = neighbours(forest, threshold, parts)
    links = settle(
        pairs.join(members.toDF("u", "a"), "u")
        .join(members.toDF("v", "b"), "v")
        .select("u", "v", F.size(F.array_intersect("a", "b")).alias("i"), (F.size("a") + F.size("b")).alias("s"))
        .where(F.col("i") >= threshold * (F.col("s") - F.col("i")) - 1e-9)
        .select("u", "v"),
        "links",
    )
    labels = settle(connected(links), "labels")
    state = (
        forest.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
        .withColumn("label", F.coalesce("component", "rep"))
        .drop("component")
    )
    live = settle(across(in_blocks(settle(mixed(state), "mixed"), block), threshold, parts), "live")
    # Links between components, then what they make of each component.
    joined = connected(settle(across(live, threshold, parts, members), "across"))
    joined = joined.select(F.col("node").alias("component"), F.col("component").alias("whole"))
    labels = labels.join(joined, "component", "left").select("node", F.coalesce("whole", "component").alias("component"))
    single = joined.join(labels.select(F.col("node").alias("component")), "component", "left_anti")
    labels = labels.union(single.select(F.col("component").alias("node"), F.col("whole").alias("component")))
    resolved = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(
        "f", "g", F.coalesce("component", "rep").alias("component_id")
    )
    linked = linkable.select("doc_id", "n", "f", "g").join(resolved, ["f", "g"]).select("doc_id", "n", "component_id")
    alone = sketches.where((F.col("n") == 0) | F.col("doc_id").isNull()).select(
        "doc_id", "n", F.col("doc_id").alias("component_id")
    )
    return linked.union(alone).select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of docs that ``near_duplicates`` keeps, with their own columns; of rows that
    repeat both doc_id and text, one."""
    found = settle(near_duplicates(docs, key=key, text=text, **options).select("doc_id", "kept"), "found")
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("__tessera_gone")).distinct()
    if gone.count() <= SENT_IDS:
        gone = F.broadcast(gone)
    rows = docs.join(gone, docs[key] == gone["__tessera_gone"], "left_anti")
    twice = found.where("kept AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1")
    twice = settle(twice.select(F.col("doc_id").alias("__tessera_twice")), "twice")
    if twice.isEmpty():
        return rows
    if twice.count() <= SENT_IDS:
        twice = F.broadcast(twice)
    repeated = docs[key] == twice["__tessera_twice"]
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    same = [F.col(key), F.xxhash64(F.col(text)), F.length(F.col(text))]
    one = rows.join(twice, repeated, "left_semi").select(whole, F.hash(*same).alias("__tessera_order"), *(c.alias(f"__tessera_{i}") for i, c in enumerate(same)))
    one = one.groupBy("__tessera_0", "__tessera_1", "__tessera_2").agg(F.min_by("row", "__tessera_order").alias("row")).select("row.*")
    return rows.join(twice, repeated, "left_anti").unionByName(one)
