"""Documents into training sequences, by tiers of context size.

One pass tokenizes each text once and packs where it is read. A document goes to the
shortest tier (512, 1024, 2048, 4096) that holds it; a longer one fills long windows, and
its rest goes to the tier that holds that. Each tier is packed with whole documents: the
longest opens a window of its tier, and documents of shorter tiers fill its gap, whole ones
as far as they fit (two that fill it exactly before the largest that fits); what is left of
the gap takes a cut off one of them, so every window but a last one is full. What a task has
left over (less than one window) goes on with its ids: the leftovers of ``together`` tasks
meet in one small group, where one sequence is padded. Sequences are dealt to step groups by
running totals over all tasks, so groups differ by at most one window.

Defined results: null and empty text is the closing id alone; repeated rows are
packed each; a null doc_id is kept as it is; an empty table gives no rows; a document of any
length is cut over as many sequences as it fills; the tokenizer's special tokens spelled out
in a text become their ids, as it has it; further columns are ignored.
"""

from __future__ import annotations

import functools
import math
import os
import re
import zlib
from array import array
from bisect import bisect_left, bisect_right, insort

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle

TIERS = (512, 1024, 2048, 4096)
END_ID = 2
PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\\[-`{-~]*)")
#: Byte-level vocabularies write bytes without a glyph as the characters from U+0100 on.
BYTE_CHARS = {b: 256 + k for k, b in enumerate([*range(33), *range(127, 161), 173])}
#: Words of one generation whose ids a worker remembers.
REMEMBERED = 150_000
PIECE = [
    ("doc_id", pa.int64()),
    ("start", pa.int64()),
    ("length", pa.int64()),
    ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()),
    ("sequence_id", pa.int64()),
    ("offset", pa.int64()),
    ("tier", pa.int32()),
    ("before", pa.int64()),
    ("ids", pa.binary()),
]
PIECES = pa.schema(PIECE)
DDL = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
    "offset long, tier int, before long, ids binary"
)


class Known(dict):
    """Words with their ids; those it lacks are noted."""

    missed: set[bytes]

    def __missing__(self, word: bytes) -> bytes:
        self.missed.add(word)
        return b""


class WordIds:
    """Word -> its ids as little-endian 32-bit bytes. The tokenizer drops white space,
    never looks across it and lower-cases, so words can be encoded one by one, with A-Z
    in lower case; a text that may spell a special token goes through it whole. Of two
    generations of words, those used lately are kept."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        added = self.model.get_added_tokens_decoder().values()
        self.special = re.compile(b"|".join(re.escape(t.content.encode().lower()) for t in added) or rb"(?!)")
        self.merges = self.model.model
        self.tails: dict[str, bytes] = {}
        self.now, self.old = Known(), Known()

    def _merged(self, word: str) -> bytes:
        return array("I", [t.id for t in self.merges.tokenize(word)]).tobytes()

    def _encode(self, words: list[bytes]) -> None:
        """Words of Latin letters, with or without punctuation after them, go straight
        to the merges, as the tokenizer's rules would have it; others through all of it."""
        other = []
        now = self.now
        for w in words:
            if w.isalpha():
                now[w] = self._merged(w.decode())
                continue
            text = w.decode("utf-8", "replace")
            if not (m := PLAIN.fullmatch(text)):
                other.append((w, text))
                continue
            ids = self._merged(m[1].lower().encode().decode("latin-1").translate(BYTE_CHARS))
            if m[2]:
                if (tail := self.tails.get(m[2])) is None:
                    tail = array("I", self.model.encode(m[2], add_special_tokens=False).ids).tobytes()
                    self.tails[m[2]] = tail
                ids += tail
            now[w] = ids
        encoded = self.model.encode_batch_fast([x for _, x in other], add_special_tokens=False)
        for (w, _), e in zip(other, encoded):
            now[w] = array("I", e.ids).tobytes()

    def learn(self, words: set[bytes]) -> None:
        if len(self.now) > REMEMBERED:
            self.now, self.old = Known(), self.now
        if len(self.tails) > 10_000:
            self.tails.clear()
        new = []
        for w in words:
            if (x := self.old.get(w)) is None:
                new.append(w)
            else:
                self.now[w] = x
        self._encode(new)

    def forget(self) -> None:
        """Leaves nothing behind in a worker that goes on to other tasks."""
        self.tails.clear()
        self.now, self.old = Known(), Known()

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """The ids of whole texts, each with the closing id."""
        end = array("I", [END_ID]).tobytes()
        raw = [(x or "").encode("utf-8", "replace").lower() for x in texts]
        whole = {i for i, x in enumerate(raw) if b"<|" in x and self.special.search(x)}
        split = [[] if i in whole else x.split() for i, x in enumerate(raw)]
        self.now.missed = set()
        look = self.now.__getitem__
        looked = [list(map(look, words)) for words in split]
        self.learn(self.now.missed)
        now, old = self.now, self.old
        out = [
            b"".join([x or now.get(w) or old[w] for w, x in zip(words, found)]) + end
            for words, found in zip(split, looked)
        ]
        for i in whole:
            out[i] = array("I", self.model.encode(texts[i], add_special_tokens=False).ids).tobytes() + end
        return out


@functools.lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


#: A part of a document: doc_id, start, the document's tokens, ids (4 bytes each).
Part = tuple[int | None, int, int, bytes]


class Packer:
    """Parts of documents by length, packed into windows, the longest first."""

    def __init__(self, base: int, tiers: tuple[int, ...]):
        self.base, self.tiers = base, tiers
        self.lengths: list[int] = []
        self.of: dict[int, list[Part]] = {}
        self.held = self.made = self.tokens = 0
        self.rows: list[tuple] = []

    def add(self, part: Part) -> None:
        """Long parts leave as full windows of the longest tier; the rest waits."""
        doc_id, start, total, ids = part
        at, most = 0, 4 * self.tiers[-1]
        while len(ids) - at >= most:
            self._emit([(doc_id, start + at // 4, total, ids[at : at + most])], self.tiers[-1])
            at += most
        if at < len(ids):
            self._put((doc_id, start + at // 4, total, ids[at:]))

    def _put(self, part: Part) -> None:
        n = len(part[3]) // 4
        if n not in self.of:
            self.of[n] = []
            insort(self.lengths, n)
        self.of[n].append(part)
        self.held += n

    def _take(self, n: int) -> Part:
        parts = self.of[n]
        part = parts.pop()
        if not parts:
            del self.of[n]
            self.lengths.pop(bisect_left(self.lengths, n))
        self.held -= n
        return part

    def _pair(self, gap: int) -> tuple[int, int] | None:
        """Two lengths that fill the gap, if there are."""
        lengths, of = self.lengths, self.of
        i, j = 0, bisect_right(lengths, gap) - 1
        while i <= j:
            both = lengths[i] + lengths[j]
            if both == gap and (i < j or len(of[lengths[i]]) > 1):
                return lengths[i], lengths[j]
            if both < gap:
                i += 1
            else:
                j -= 1
        return None

    def _window(self, last: bool) -> bool:
        """Packs one window; what cannot fill one waits, but for the last."""
        first = self._take(self.lengths[-1])
        inside, size = [first], len(first[3]) // 4
        tier = next(t for t in self.tiers if size <= t)
        gap = tier - size
        while gap and self.lengths:
            k = bisect_right(self.lengths, gap) - 1
            if k >= 0 and self.lengths[k] == gap:
                inside.append(self._take(gap))
                gap = 0
            elif k >= 0 and (pair := self._pair(gap)):
                inside += map(self._take, pair)
                gap = 0
            elif k >= 0:
                n = self.lengths[k]
                inside.append(self._take(n))
                gap -= n
            else:  # all that is left is longer: cut the shortest
                doc_id, start, total, ids = self._take(self.lengths[0])
                inside.append((doc_id, start, total, ids[: 4 * gap]))
                self._put((doc_id, start + gap, total, ids[4 * gap :]))
                gap = 0
        if gap and not last:
            for part in inside:
                self._put(part)
            return False
        self._emit(inside, tier)
        return True

    def _emit(self, inside: list[Part], tier: int) -> None:
        offset = 0
        for doc_id, start, total, ids in inside:
            n = len(ids) // 4
            self.rows.append((doc_id, start, n, zlib.crc32(ids), total, self.base + self.made, offset, tier, self.tokens, None))
            offset += n
        self.made += 1
        self.tokens += offset if offset & (offset - 1) == 0 else self.tiers[-1]

    def pack(self, leave: int = 0, last: bool = False) -> None:
        """Packs until at most ``leave`` tokens wait."""
        while self.held > leave and self._window(last):
            pass

    def left(self) -> list[tuple]:
        return [
            (doc_id, start, n, 0, total, self.base >> 32, -1, 0, 0, ids)
            for n in self.lengths
            for doc_id, start, total, ids in self.of[n]
        ]

    def take(self) -> pa.RecordBatch:
        cols = list(zip(*self.rows)) or [()] * len(PIECE)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, PIECE)], schema=PIECES)


def step_groups(pieces: DataFrame, group_tokens: int) -> DataFrame:
    """pieces with ``step_group`` for ``before``: groups of about group_tokens tokens by the
    running total over all tasks' sequences. Only a total a task reaches the driver."""
    task = F.shiftright("sequence_id", 32)
    size = F.sum("length")
    padded = F.when(size.bitwiseAND(size - 1) == 0, size).otherwise(F.lit(TIERS[-1]))
    sequences = pieces.groupBy(task.alias("task"), "sequence_id", "before").agg(padded.alias("n"))
    totals = sequences.groupBy("task").agg(F.max(F.col("before") + F.col("n")).alias("n")).orderBy("task").collect()
    whole = sum(r.n for r in totals)
    each = max(1, math.ceil(whole / max(1, round(whole / group_tokens))))
    firsts, upto = [], 0
    for r in totals:
        firsts.append((r.task, upto))
        upto += r.n
    starts = pieces.sparkSession.createDataFrame(firsts, "task long, first long")
    group = F.floor((F.col("first") + F.col("before")) / each).alias("step_group")
    return pieces.withColumn("task", task).join(F.broadcast(starts), "task").select(*(c for c in pieces.columns if c != "before"), group)


def pack(
    docs: DataFrame,
    tokenizer: str,
    tiers: tuple[int, ...] = TIERS,
    together: int = 64,
    group_tokens: int = 64 * 4096,
    waiting: int = 1 << 19,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group.

    A task packs whenever more than ``waiting`` tokens wait, and leaves half of them."""

    def first(batches):
        from pyspark import TaskContext

        words, packer = word_ids(tokenizer), Packer(TaskContext.get().partitionId() << 32, tiers)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                for doc_id, ids in zip(rows.column(0).to_pylist(), words.ids(rows.column(1).to_pylist())):
                    packer.add((doc_id, 0, len(ids) // 4, ids))
                if packer.held > waiting:
                    packer.pack(waiting // 2)
                if len(packer.rows) > 10_000:
                    yield packer.take()
        words.forget()
        packer.pack()
        packer.rows += packer.left()
        yield packer.take()

    def rest(rows: pd.DataFrame) -> pd.DataFrame:
        packer = Packer((1 << 62) + (int(rows["g"].iloc[0]) << 32), tiers)
        for r in rows.sort_values(["sequence_id", "doc_tokens", "doc_id", "start"]).itertuples():
            packer.add((None if pd.isna(r.doc_id) else int(r.doc_id), int(r.start), int(r.doc_tokens), bytes(r.ids)))
        packer.pack()
        packer.pack(last=True)
        return packer.take().to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)

    pieces = settle(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(first, DDL), "pieces")
    ends = (
        pieces.where(F.col("offset") < 0)
        .withColumn("g", F.floor(F.col("sequence_id") / together))
        .groupBy("g")
        .applyInPandas(rest, DDL)
        .drop("ids")
    )
    whole = pieces.where(F.col("offset") >= 0).drop("ids").unionByName(settle(ends, "ends"))
    return step_groups(whole, group_tokens)
