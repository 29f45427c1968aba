"""Language by cross-parsing: how few phrases of a language's text spell a document.

Per language, ``rows`` passages of ``chars`` characters (fewer where many languages share
``total`` characters) are joined to a reference text, and its suffix automaton tells for any
text the longest match from a position. A passage lies anywhere in its document, at a place
that the document's hash decides, and the passages are those of the documents with the least
hashes, so the whole of all labelled texts is sampled alike; these bounds are on the fitting
alone. A document is cut greedily into such matches; phrases * log2(reference length) /
length is the cross-parsing entropy, and the language with the least wins.

Texts are parsed whole, in lock step: lower-cased, runs of ASCII other than letters
become one space, and the bytes are cut into segments of ``SEGMENT`` bytes (a phrase ends
there), so that the automata of all languages advance over thousands of segments with one
lookup each. The automata's moves are one hash table: memory goes by the references' size.

Defined results: null text, or text without a letter, is ``und`` with score 0; ties
go to the first language in code-point order; with no labelled rows all is ``und``;
rows without lang, doc_id or text teach nothing; rows that repeat a doc_id may each give a
passage; repeated rows get equal answers; further columns are ignored.
"""

from __future__ import annotations

import functools
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import learns_from

SEGMENT = 512
#: Bytes parsed at a time.
CHUNK = 1 << 21
ASCII_LETTER = re.compile(rb"[A-Za-z]")
TO_SPACE = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
BREAK = b"\n"
SPREAD = np.uint64(0x9E3779B97F4A7C15)


def plain(text: str) -> bytes:
    return b" ".join(text.lower().encode("utf-8", "replace").translate(TO_SPACE).split())


def has_letter(text: str, raw: bytes) -> bool:
    return bool(ASCII_LETTER.search(raw)) or any(c.isalpha() for c in text)


def suffix_automaton(data: list[int]) -> list[dict[int, int]]:
    """Per state its moves, symbol -> state; state 1 is the start.

    Symbol 0 stands between samples and is never matched."""
    go: list[dict[int, int]] = [{}, {}]
    link, length = [0, 0], [0, 0]
    last = 1
    for c in data:
        new = len(go)
        go.append({})
        length.append(length[last] + 1)
        link.append(1)
        p = last
        while p and c not in go[p]:
            go[p][c] = new
            p = link[p]
        if p:
            q = go[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(go)
                go.append(dict(go[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p and go[p].get(c) == q:
                    go[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return go


class Moves:
    """state * 256 + symbol -> state, for arrays: a hash table with linear probing."""

    def __init__(self, keys: np.ndarray, to: np.ndarray):
        self.bits = max(4, int(2.5 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.to = np.zeros(1 << self.bits, np.int32)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = np.nonzero(self.keys[at[left]] < 0)[0]
            slots, first = np.unique(at[left[free]], return_index=True)
            chosen = left[free[first]]
            self.keys[slots], self.to[slots] = keys[chosen], to[chosen]
            left = np.setdiff1d(left, chosen, assume_unique=True)
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * SPREAD >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The state each key moves to, or 0."""
        at = self._slot(keys)
        seen = self.keys[at]
        out = np.where(seen == keys, self.to[at], 0)
        open_ = np.nonzero((seen != keys) & (seen >= 0))[0]
        at = at[open_]
        while len(open_):
            at = (at + 1) & ((1 << self.bits) - 1)
            seen, want = self.keys[at], keys[open_]
            out[open_] = np.where(seen == want, self.to[at], 0)
            on = (seen != want) & (seen >= 0)
            open_, at = open_[on], at[on]
        return out


class CrossParser:
    """Cross-parsing entropy of texts under each language's reference text."""

    def __init__(self, references: tuple[tuple[str, bytes], ...]):
        self.langs = [name for name, _ in references]
        self.symbol = np.zeros(256, np.uint8)
        used = sorted(set(b"".join(x for _, x in references)) - set(BREAK))
        self.symbol[used] = np.arange(1, len(used) + 1)
        self.root = np.zeros((len(references), 1), np.int64)
        self.from_root = np.zeros((len(references), 256), np.int32)
        keys, to, start = [], [], 0
        for k, (_, x) in enumerate(references):
            go = suffix_automaton(self.symbol[np.frombuffer(x, np.uint8)].tolist())
            self.root[k] = start + 1
            for c, n in go[1].items():
                self.from_root[k, c] = c and start + n
            moves = [(((start + state) << 8) + c, start + n) for state, m in enumerate(go) for c, n in m.items() if c]
            keys += [np.array([m[0] for m in moves], np.int64)]
            to += [np.array([m[1] for m in moves], np.int32)]
            start += len(go)
        self.moves = Moves(np.concatenate([*keys, np.zeros(0, np.int64)]), np.concatenate([*to, np.zeros(0, np.int32)]))
        self.weight = np.array([math.log2(len(x) + 2) for _, x in references])

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """[text, language] -> number of phrases."""
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        todo: list[tuple[int, bytes]] = []
        size = 0
        for i, x in enumerate(texts):
            for k in range(0, len(x), SEGMENT):
                todo.append((i, x[k : k + SEGMENT]))
            size += len(x)
            while size >= CHUNK and len(todo) * SEGMENT >= CHUNK:
                part, todo = todo[: CHUNK // SEGMENT], todo[CHUNK // SEGMENT :]
                size = sum(len(s) for _, s in todo)
                self._parse(part, out)
        if todo:
            self._parse(todo, out)
        return out

    def _parse(self, segments: list[tuple[int, bytes]], out: np.ndarray) -> None:
        segments.sort(key=lambda s: -len(s[1]))
        lengths = np.array([len(s) for _, s in segments])
        grid = np.zeros((len(segments), lengths[0]), np.uint8)
        flat = self.symbol[np.frombuffer(b"".join(s for _, s in segments), np.uint8)]
        grid[np.arange(lengths[0])[None, :] < lengths[:, None]] = flat
        grid = np.ascontiguousarray(grid.T)
        alive = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right")
        state = np.repeat(self.root, len(segments), 1)
        count = np.zeros(state.shape, np.int32)
        for k in range(lengths[0]):
            n = alive[k]
            c = grid[k, :n].astype(np.int64)
            now = state[:, :n]
            to = self.moves(((now << 8) + c).ravel()).reshape(now.shape)
            miss = to == 0
            count[:, :n] += miss | (now == self.root)
            to = np.where(miss, self.from_root[:, c], to)
            state[:, :n] = np.where(to == 0, self.root, to)
        np.add.at(out, np.array([i for i, _ in segments]), count.T)

    def judge(self, texts: list[str | None]) -> list[tuple[str, float]]:
        raw = [plain(x) if x else b"" for x in texts]
        known = [bool(x) and has_letter(x, r) for x, r in zip(texts, raw)]
        counts = self.phrases([r if k else b"" for r, k in zip(raw, known)])
        cost = counts * self.weight / np.array([max(1, len(r)) for r in raw])[:, None]
        best = cost.argmin(1)
        out = []
        for i, k in enumerate(known):
            if not k:
                out.append(("und", 0.0))
                continue
            low = cost[i, best[i]]
            rest = np.delete(cost[i], best[i])
            score = 1.0 if not len(rest) else float(max(0.0, 1 - low / rest.min())) if rest.min() > 0 else 0.0
            out.append((self.langs[best[i]], score))
        return out


@functools.lru_cache(maxsize=1)
def parser(references: tuple[tuple[str, bytes], ...]) -> CrossParser:
    return CrossParser(references)


def learn(
    docs: DataFrame,
    rows: int = 48,
    chars: int = 512,
    total: int = 2_000_000,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
) -> tuple[tuple[str, bytes], ...]:
    """Reference texts by language, of at most rows * chars characters each."""
    known = docs.where(F.col(lang).isNotNull() & F.col(key).isNotNull() & F.col(text).isNotNull())
    known = known.select(F.col(lang).alias("l"), F.xxhash64(key).alias("o"), F.col(text).alias("t"))
    n_langs = known.select("l").distinct().count()
    each = max(1, min(rows, total // max(1, n_langs * chars)))
    place = F.pmod(F.shiftright("o", 20), F.greatest(F.length("t") - chars + 1, F.lit(1))).cast("int")
    passages = known.select("l", "o", F.substring("t", place + 1, F.lit(chars)).alias("t"))
    # The least hash of each bucket, ``each`` rows a language; then the passages of these alone.
    firsts = known.groupBy("l", F.pmod("o", F.lit(each)).alias("b")).agg(F.min("o").alias("o")).select("l", "o")
    found = passages.join(F.broadcast(firsts), ["l", "o"]).groupBy("l", "o").agg(F.min("t").alias("t")).collect()
    by: dict[str, list[bytes]] = {}
    for r in sorted(found, key=lambda r: (r.l, r.o, r.t)):
        if x := plain(r.t):
            by.setdefault(r.l, []).append(x)
    return tuple((k, BREAK.join(v)) for k, v in sorted(by.items()))


def predictor(references: tuple[tuple[str, bytes], ...]):
    """text -> struct(lang_pred, score)."""

    @F.arrow_udf("lang_pred string, score double")
    def predict(text: pa.Array) -> pa.Array:
        texts = text.to_pylist()
        found = parser(references).judge(texts) if references else [("und", 0.0)] * len(texts)
        return pa.StructArray.from_arrays(
            [pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())],
            names=["lang_pred", "score"],
        )

    return predict


def identify(docs: DataFrame, modulus: int = 3, held_out: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: doc_id, held_out, lang_pred, score."""
    learns = learns_from(F.col(key), modulus, held_out)
    predict = predictor(learn(docs.where(learns), key=key, text=text))
    return docs.select(F.col(key).alias("doc_id"), (~learns).alias("held_out"), predict(F.col(text)).alias("p")).select(
        "doc_id", "held_out", "p.*"
    )
