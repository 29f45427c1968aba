"""A class-based bigram model over all training documents, and its perplexity.

Counts of all tokens are gathered from the whole training fold (combined in each
task, then by a shuffle). The ``head`` most frequent words, a fixed number, travel
to every task and are all assigned to classes by exchange clustering over the counts of
their bigrams: a round looks at each word and moves it to the class that raises the
likelihood of the class bigrams most, the ``one_by_one`` most frequent words in turn and
exactly, the others, each of which hardly changes the classes, in batches and to first order.
Bigrams stay a distributed table, packed in blocks by their first and, once more, by their
second symbol, so that a round gets from one scan, without a shuffle,
what stands before and after each head word by class (head x classes counts, whatever the
corpus), as of the round's start, as in distributed exchange clustering (Uszkoreit and
Brants, 2008). Rounds end when one does not raise the likelihood, moves few words, or is the
last of ``rounds``. Words beyond the head are four classes by their length, and the end of a
text is a class of its own. A text's probability is the product of class transitions, counted
over the whole training fold, and word emissions. Words beyond the head meet their counts in
a join; none of them holds more than a share 1/head of all tokens, or it is longer than
``LONGEST`` bytes, so a hot one is rare and Spark splits it.

Defined results: null or empty text is the end token alone; rows without doc_id
belong to the training fold; repeated rows are all returned; with no training rows
all counts are 0; words of any length count, those of more than LONGEST bytes never in the
head; further columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import learns_from, settle

#: The token that ends each text; no word is empty.
END = b""
ALPHA = 0.1
#: Length classes of words outside the clustered vocabulary, by bytes.
LENGTH_BOUNDS = (4, 7, 11)
N_LENGTHS = len(LENGTH_BOUNDS) + 1
FLUSH = 300_000
#: Bytes of the longest word that is sent to all tasks.
LONGEST = 64
#: Words that are moved at once.
BATCH = 4096
#: Distinct bigrams that a task holds.
PAIRS = 4_000_000
#: Bigrams that a task gathers before it counts them.
GATHER = 1 << 21
#: Blocks that bigrams are packed in.
BLOCKS = 256
#: Bytes of text that are split into words at once.
PORTION = 1 << 23


def portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that their texts are one or have at most PORTION bytes."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(ends):
            most = PORTION + (int(ends[at - 1]) if at else 0)
            to = max(at + 1, int(np.searchsorted(ends, most, "right")))
            yield batch.slice(at, to - at)
            at = to


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words (and maybe an empty one), the place of each text's words among them in
    their order, and each text's number of words."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    coded = parts.flatten().dictionary_encode()
    place = coded.indices.to_numpy()
    text = np.repeat(np.arange(len(parts)), pc.list_value_length(parts).to_numpy())
    empty = pc.index(coded.dictionary, pa.scalar("", coded.dictionary.type)).as_py()
    if empty >= 0:  # beside blanks at a text's ends
        there = place != empty
        place, text = place[there], text[there]
    return coded.dictionary.cast(pa.binary()), place, np.bincount(text, minlength=len(parts))


def length_class(n: int) -> int:
    return sum(n >= b for b in LENGTH_BOUNDS)


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: defaultdict[bytes, int] = defaultdict(int)

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays(
            [pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], names=["word", "n"]
        )
        seen.clear()
        return batch

    for batch in portions(batches):
        words, place, _ = tokens(batch.column("text"))
        for w, n in zip(words.to_pylist(), np.bincount(place, minlength=len(words)).tolist()):
            if n:
                seen[w] += n
        seen[END] += len(batch)
        if len(seen) > FLUSH:
            yield out()
    if seen:
        yield out()


def xlogx(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1)), 0.0)


def likelihood(table: np.ndarray) -> float:
    """Of class bigrams, but for a constant: sum n(c,d) log n(c,d) - n(c) log n(c) - n(d) log n(d)."""
    return float(xlogx(table).sum() - xlogx(table.sum(0)).sum() - xlogx(table.sum(1)).sum())


#: What stands around words: counts before and after each head word, by class, and its count after itself.
Contexts = tuple[np.ndarray, np.ndarray, np.ndarray]


def sweep(
    cls: np.ndarray, order: np.ndarray, contexts: Contexts, table: np.ndarray, n_classes: int, one_by_one: int
) -> tuple[np.ndarray, int]:
    """One round over the words: each goes where the likelihood is highest."""
    before, after, twice = contexts
    cls, table, moved = cls.copy(), table.copy(), 0
    for w in order[:one_by_one].tolist():
        old, own = int(cls[w]), twice[w]
        right, left = after[w].astype(float), before[w].astype(float)
        right[old] -= own
        left[old] -= own
        table[old, :] -= right
        table[:, old] -= left
        table[old, old] -= own
        row, col = table.sum(1), table.sum(0)
        r, c = right.sum() + own, left.sum() + own
        now = xlogx(table)
        gain = (xlogx(table[:n_classes] + right) - now[:n_classes]).sum(1)
        gain += (xlogx(table[:, :n_classes].T + left) - now[:, :n_classes].T).sum(1)
        k = np.arange(n_classes)
        diag = table[k, k]
        gain += xlogx(diag + right[k] + left[k] + own) - xlogx(diag + right[k]) - xlogx(diag + left[k]) + now[k, k]
        gain -= xlogx(row[k] + r) - xlogx(row[k]) + xlogx(col[k] + c) - xlogx(col[k])
        new = int(gain.argmax())
        if gain[new] <= gain[old] + 1e-9:
            new = old
        cls[w] = new
        table[new, :] += right
        table[:, new] += left
        table[new, new] += own
        moved += new != old
    rest = order[one_by_one:]
    for at in range(0, len(rest), BATCH):
        some = rest[at : at + BATCH]
        k = np.arange(len(some))
        level = 0.5 * len(table)
        table = np.maximum(table, 0)
        follows = np.log(table[:n_classes] + 0.5) - np.log(table.sum(1)[:n_classes, None] + level)
        precedes = np.log(table[:, :n_classes].T + 0.5) - np.log(table.sum(0)[:n_classes, None] + level)
        gain = after[some] @ follows.T + before[some] @ precedes.T
        old, new = cls[some], gain.argmax(1)
        new = np.where(gain[k, new] > gain[k, old] + 1e-9, new, old)
        change = np.zeros((len(table), len(some)))
        np.add.at(change, (new, k), 1)
        np.add.at(change, (old, k), -1)
        table += change @ after[some] + (change @ before[some]).T
        cls[some] = new
        moved += int((new != old).sum())
    return cls, moved


def exchange(
    look: Callable[[np.ndarray], tuple[Contexts, np.ndarray]],
    frequency: np.ndarray,
    n_classes: int,
    rounds: int,
    few: float = 0.005,
    one_by_one: int = 2000,
) -> np.ndarray:
    """Classes of the head words. look: classes -> contexts and class bigrams, exact."""
    cls = np.arange(len(frequency)) % n_classes
    order = np.argsort(-frequency, kind="stable")
    contexts, table = look(cls)
    best = likelihood(table)
    for _ in range(rounds):
        new, moved = sweep(cls, order, contexts, table, n_classes, one_by_one)
        if not moved:
            break
        contexts, table = look(new)
        if (now := likelihood(table)) <= best:
            break
        cls, best = new, now
        if moved <= few * len(cls):
            break
    return cls


class ClassModel:
    """Everything that scoring needs of fixed size: head words, classes, transitions."""

    def __init__(self, head: dict[bytes, int], ends: int, total: int, types: int):
        self.head, self.ends, self.total, self.types = head, ends, total, types
        self.symbol = {w: i for i, w in enumerate([*head, END])}
        self.n_symbols = len(self.symbol) + N_LENGTHS

    def symbols(self, words: pa.Array) -> np.ndarray:
        """Symbol of each word; of those beyond the head by their length."""
        known = np.array([self.symbol.get(w, -1) for w in words.to_pylist()], np.int64)
        lengths = np.searchsorted(LENGTH_BOUNDS, pc.binary_length(words).to_numpy(), "right")
        return np.where(known < 0, len(self.symbol) + lengths, known)

    def line(self, ids: np.ndarray, n_words: np.ndarray) -> np.ndarray:
        """The symbols of texts in a line, with an end before, between and after them: text i
        has n_words[i] + 1 bigrams there, as if it stood between two ends of its own."""
        line = np.full(len(ids) + len(n_words) + 1, self.symbol[END])
        line[np.arange(len(ids)) + np.repeat(np.arange(len(n_words)), n_words) + 1] = ids
        return line

    def classes(self, cls: np.ndarray, n_classes: int) -> np.ndarray:
        """Class of each symbol: the head's, then one for the end and one for each length."""
        return np.concatenate([cls, n_classes + np.arange(1 + N_LENGTHS)]).astype(np.int64)

    def fit(self, cls: np.ndarray, table: np.ndarray, length_tokens: list[int], length_types: list[int]) -> None:
        """cls: classes of all symbols; table: counts of class bigrams."""
        k = len(table)
        self.cls = cls
        self.logt = np.log10((table + ALPHA) / (table.sum(1, keepdims=True) + ALPHA * k))
        words = len(self.head)
        frequency = np.fromiter(self.head.values(), float, words)
        in_class = np.bincount(cls[:words], weights=frequency, minlength=k)
        sizes = np.bincount(cls[:words], minlength=k)
        self.emit = np.zeros(self.n_symbols)
        self.emit[:words] = np.log10((frequency + ALPHA) / (in_class + ALPHA * sizes)[cls[:words]])
        for r in range(N_LENGTHS):  # without log10(count + ALPHA), which each word adds
            self.emit[words + 1 + r] = -math.log10(length_tokens[r] + ALPHA * (length_types[r] + 1))


PACKED = "side int, block int, own binary, other binary, n binary"


def packed(side: int, block: np.ndarray, own: np.ndarray, other: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """A row per block that occurs, with its bigrams as bytes."""
    order = np.argsort(block, kind="stable")
    block = block[order]
    first = np.flatnonzero(np.diff(block, prepend=-1))
    cols = [pa.array(np.full(len(first), side, np.int32)), pa.array(block[first].astype(np.int32))]
    for x, kind in ((own, np.int32), (other, np.int32), (n, np.int64)):
        x = np.ascontiguousarray(x[order], kind)
        ends = (np.append(first, len(x)) * x.itemsize).astype(np.int32)
        cols.append(pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(x)]))
    return pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in PACKED.split(", ")])


def unpacked(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    for side, block, own, other, n in zip(*(c.to_pylist() for c in batch.columns)):
        yield side, block, np.frombuffer(own, np.int32), np.frombuffer(other, np.int32), np.frombuffer(n, np.int64)


class Bigrams:
    """Counts of bigrams (as first * n_symbols + second) that a task adds up."""

    def __init__(self) -> None:
        self.pending: list[tuple[np.ndarray, np.ndarray | None]] = []
        self.size = 0
        self.clear()

    def clear(self) -> None:
        self.codes, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, codes: np.ndarray, counts: np.ndarray | None = None) -> bool:
        """counts: of each, or each once. True when the sums should be taken."""
        self.pending.append((codes, counts))
        self.size += len(codes)
        if self.size > GATHER:
            self.merge()
        return len(self.codes) > PAIRS

    def merge(self) -> None:
        counted = [(self.codes, self.counts), *((c, n) for c, n in self.pending if n is not None)]
        if once := [c for c, n in self.pending if n is None]:
            counted.append(np.unique(np.concatenate(once), return_counts=True))
        self.pending, self.size = [], 0
        codes, counts = (np.concatenate(x) for x in zip(*counted))
        order = np.argsort(codes, kind="stable")
        codes = codes[order]
        first = np.flatnonzero(np.diff(codes, prepend=-1))
        self.codes, self.counts = codes[first], np.add.reduceat(counts[order], first) if len(first) else counts


def bigrams(train: DataFrame, model: ClassModel) -> DataFrame:
    """(text) -> packed bigrams of symbols, side 0 with all of a first symbol (own) in its
    block, side 1 with all of a second. They are counted in each task, then by a shuffle in
    blocks that a frequent symbol is spread over."""
    spark = train.sparkSession
    sent, n = spark.sparkContext.broadcast(model), model.n_symbols

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, seen = sent.value, Bigrams()

        def out() -> pa.RecordBatch:
            a, b = np.divmod(seen.codes, n)
            batch = packed(0, (31 * a + b) % BLOCKS, a, b, seen.counts)
            seen.clear()
            return batch

        for batch in portions(batches):
            words, place, n_words = tokens(batch.column("text"))
            line = m.line(m.symbols(words)[place], n_words)
            if seen.add(line[:-1] * n + line[1:]):
                yield out()
        seen.merge()
        yield out()

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Bigrams()

        def out() -> Iterator[pa.RecordBatch]:
            a, b = np.divmod(seen.codes, n)
            yield packed(0, a % BLOCKS, a, b, seen.counts)
            yield packed(1, b % BLOCKS, b, a, seen.counts)
            seen.clear()

        for batch in batches:
            for _, _, a, b, counts in unpacked(batch):
                if seen.add(a.astype(np.int64) * n + b, counts):
                    yield from out()
        seen.merge()
        yield from out()

    return train.mapInArrow(count, PACKED).repartition("block").mapInArrow(add_up, PACKED).repartition("side", "block")


def learn(train: DataFrame, head: int, n_classes: int, rounds: int) -> tuple[ClassModel, DataFrame]:
    """The model, and the table of all counts (word, n)."""
    spark = train.sparkSession
    counts = settle(
        train.mapInArrow(count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "counts"
    )
    size = F.octet_length("word")
    top = counts.where((size > 0) & (size <= LONGEST)).orderBy(F.desc("n"), "word").limit(head).collect()
    band = sum(((size >= b).cast("int") for b in LENGTH_BOUNDS), F.lit(0))
    bands = {
        r.b: (r.t, r.v)
        for r in counts.where(size > 0).groupBy(band.alias("b")).agg(F.sum("n").alias("t"), F.count("*").alias("v")).collect()
    }
    ends = counts.where(size == 0).agg(F.sum("n")).first()[0] or 0
    lookup = {bytes(r.word): r.n for r in top}
    tok, typ = [bands.get(r, (0, 0))[0] for r in range(N_LENGTHS)], [bands.get(r, (0, 0))[1] for r in range(N_LENGTHS)]
    model = ClassModel(lookup, ends, sum(tok) + ends, sum(typ) + (ends > 0))
    for w, n in lookup.items():
        tok[length_class(len(w))] -= n
        typ[length_class(len(w))] -= 1
    pairs = settle(bigrams(train, model), "bigrams")
    words = len(lookup)
    n_classes = max(1, min(n_classes, words))
    width, rows = n_classes + 1 + N_LENGTHS, -(-model.n_symbols // BLOCKS)
    tables: dict[bytes, np.ndarray] = {}

    def look(cls: np.ndarray) -> tuple[Contexts, np.ndarray]:
        """At most 2 * (head + 5 + BLOCKS) * (n_classes + 6) counts, whatever the input, from
        each task that shares in a block."""
        own = model.classes(cls, n_classes)
        sent = spark.sparkContext.broadcast(own)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Counts by class of the other symbol, and of the symbol beside itself."""
            of, sums = sent.value, {}
            for batch in batches:
                for side, block, s, other, n in unpacked(batch):
                    if (x := sums.get((side, block))) is None:
                        x = sums[side, block] = np.zeros(rows * (width + 1))
                    at = s // BLOCKS * (width + 1)
                    np.add.at(x, at + of[other], n.astype(float))
                    same = s == other
                    np.add.at(x, at[same] + width, n[same].astype(float))
            if sums:
                cols = [pa.array([k[i] for k in sums], pa.int32()) for i in range(2)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["side", "block", "x"])

        both = np.zeros((2, rows * BLOCKS, width + 1))
        seen = pairs.mapInArrow(run, "side int, block int, x binary").toArrow()
        for side, block, x in zip(*seen.columns):
            both[side.as_py(), block.as_py() :: BLOCKS] += np.frombuffer(x.as_buffer()).reshape(rows, -1)
        del seen
        sent.destroy()
        after, before = both[:, : model.n_symbols, :width]
        table = np.zeros((width, width))
        for c in range(width):
            table[c] = after[own == c].sum(0)
        tables[cls.tobytes()] = table.copy()
        return (before[:words], after[:words], both[0, :words, width]), table

    frequency = np.fromiter(lookup.values(), float, words)
    cls = exchange(look, frequency, n_classes, rounds) if words else np.zeros(0, np.int64)
    if (table := tables.get(cls.tobytes())) is None:
        table = look(cls)[1]
    model.fit(model.classes(cls, n_classes), table, tok, typ)
    return model, counts


ROW = (
    "doc_id long, text_hash long, held_out boolean, word binary, tf long, copies long, "
    "n_tokens long, n_known long, base double, score double"
)
NAMES = [x.split()[0] for x in ROW.split(", ")]


def score_texts(
    docs: DataFrame,
    head: int = 50_000,
    n_classes: int = 32,
    rounds: int = 5,
    modulus: int = 10,
    held_out: int = 0,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity."""
    learns = learns_from(F.col(key), modulus, held_out)
    model, counts = learn(docs.where(learns).select(F.col(text).alias("text")), head, n_classes, rounds)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per text a row of what the head words decide, under a word of its own
        (with a blank, so that it meets no count), and a row per other word."""
        m = sent.value
        head, k = len(m.head), len(m.logt)
        logs, known = np.zeros(m.n_symbols), np.zeros(m.n_symbols, np.int64)
        logs[:head] = np.log10(np.fromiter(m.head.values(), float, head) + ALPHA)
        known[:head] = 1
        logs[head], known[head] = math.log10(m.ends + ALPHA), int(m.ends > 0)

        def out(some: pa.RecordBatch, text: np.ndarray, word: pa.Array, *numbers: np.ndarray) -> pa.RecordBatch:
            cols = [*(c.take(pa.array(text)) for c in some.columns[:3]), word, *(pa.array(x) for x in numbers)]
            return pa.RecordBatch.from_arrays(cols, names=NAMES)

        for batch in portions(batches):
            texts = np.arange(len(batch))
            words, place, n_words = tokens(batch.column("text"))
            ids = m.symbols(words)[place]
            line = m.line(ids, n_words)
            cls = m.cls[line]
            at = np.cumsum(n_words + 1) - (n_words + 1)
            score = np.add.reduceat(m.logt.ravel()[cls[:-1] * k + cls[1:]] + m.emit[line[1:]], at)
            base, seen = np.add.reduceat(logs[line[1:]], at), np.add.reduceat(known[line[1:]], at)
            rare = ids >= len(m.symbol)
            pair, tf = np.unique(np.repeat(texts, n_words)[rare] * len(words) + place[rare], return_counts=True)
            for i in range(0, len(pair), FLUSH // 3):
                text, word = np.divmod(pair[i : i + FLUSH // 3], len(words))
                none, zero = np.zeros(len(text), np.int64), np.zeros(len(text))
                yield out(batch, text, words.take(pa.array(word)), tf[i : i + FLUSH // 3], none, none, none, zero, zero)
            own = [b" %d %d" % (i or 0, th) for i, th in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            one = np.ones(len(batch), np.int64)
            yield out(batch, texts, pa.array(own, pa.binary()), 0 * one, one, n_words + 1, seen, base, score)

    n, v = model.total, model.types
    rare = F.log10(F.coalesce(F.col("n"), F.lit(0)) + F.lit(ALPHA)) * F.col("tf")
    cut = min(model.head.values(), default=0) if len(model.head) >= head else 0
    beyond = counts.where((F.col("n") <= cut) | (F.octet_length("word") > LONGEST))
    parts = (
        docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), (~learns).alias("held"), F.col(text).alias("text"))
        .mapInArrow(local, ROW)
        .join(beyond, "word", "left")
        .groupBy("doc_id", "text_hash", "held_out")
        .agg(
            F.sum("copies").alias("copies"),
            F.sum("n_tokens").alias("n_tokens"),
            F.sum(F.col("n_known") + F.when(F.col("n").isNotNull(), F.col("tf")).otherwise(0)).alias("n_known"),
            F.sum(F.col("base") + rare).alias("base"),
            F.sum(F.col("score") + rare).alias("score"),
        )
    )
    one = lambda c: (F.col(c) / F.col("copies"))
    return (
        parts.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        .select(
            "doc_id",
            "held_out",
            one("n_tokens").cast("long").alias("n_tokens"),
            one("n_known").cast("long").alias("n_known"),
            F.lit(n).cast("long").alias("train_tokens"),
            (one("base") - one("n_tokens") * math.log10(n + ALPHA * (v + 1))).alias("base_score"),
            one("score").alias("score"),
        )
        .withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
    )
