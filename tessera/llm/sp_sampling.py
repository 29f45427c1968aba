"""Distinct sampled segmentations of a text under a SentencePiece vocabulary.

Every text is a chain of blank-led words and its segmentations are paths through
their lattices of pieces, with the probability that the pieces' weights give (Zipf
weights by merge rank: 1 / (1 + rank), renormalised over all paths). The ``k``
segmentations with the largest Gumbel-perturbed log-probabilities are a sample
without replacement. They are found top-down, as in A* sampling: the root's
perturbed value is one Gumbel; a path drawn edge by edge carries it, and the
alternatives that it leaves at each step get the maximum of their Gumbels, truncated
at their parent's value. The best alternative over all steps so far is the next
sample's branch; what remains best after ``k`` is the threshold kappa of the
inclusion probabilities 1 - exp(-exp(log p - kappa)).

Lattices of a batch's distinct words, their backward sums and all draws are computed
for whole arrays at once. Draws are hashes of (row key, sample, position), so a row's
result does not depend on its neighbours or on retries.

Defined results: U+2581 in a text is a blank, as this vocabulary has it; null and
empty text have one, empty segmentation; a text with fewer
than k segmentations yields them all, with inclusion 1; characters that the
vocabulary lacks become their bytes; a null key seeds like any other; repeated rows
yield equal samples; further columns are ignored.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANK = "▁"
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Words whose lattices a worker keeps.
COMMON = 20_000
SPREAD = np.uint64(0xD6E8FEB86659FD93)
SLOT_BITS = 20
#: Characters of text sampled together.
CHUNK = 1_500_000


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(key: np.ndarray, at: np.ndarray) -> np.ndarray:
    x = mix(key + at.astype(np.uint64) * BASE)
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def stream(key: np.ndarray, number: int) -> np.ndarray:
    return mix(key ^ mix(np.full_like(key, number) * BASE + np.uint64(1)))


def truncated(phi: float, top: float, u: float) -> float:
    """A draw of Gumbel(phi) conditioned to be at most top."""
    if phi == -math.inf:
        return phi
    gap = phi - top
    tail = -math.log(u)
    return phi - (gap + math.log1p(tail * math.exp(-gap)) if gap > 0 else math.log(math.exp(gap) + tail))


def radix(x: np.ndarray) -> np.ndarray:
    """Stable order of non-negative integers, by 16 bits at a time."""
    order = np.argsort((x & 0xFFFF).astype(np.uint16), kind="stable")
    rest = x >> 16
    while len(rest) and rest.max() > 0:
        order = order[np.argsort((rest & 0xFFFF).astype(np.uint16)[order], kind="stable")]
        rest >>= 16
    return order


class Vocabulary:
    def __init__(self, path: str):
        import sentencepiece

        self.common: Common | None = None
        m = sentencepiece.SentencePieceProcessor(model_file=path)
        self.n = m.get_piece_size()
        self.byte_ids = np.zeros(256, np.int64)
        self.bytes_of: list[bytes] = [b""] * self.n
        ids, texts, scores = [], [], []
        for i in range(self.n):
            p = m.id_to_piece(i)
            if m.is_byte(i):
                self.byte_ids[int(p[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(p[3:5], 16)])
            elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
                ids.append(i)
                texts.append(p)
                scores.append(m.get_score(i))
                self.bytes_of[i] = p.replace(BLANK, " ").encode()
        weight = -np.log1p(-np.minimum(np.array(scores), 0))
        self.weight = dict(zip(ids, (weight - np.logaddexp.reduce(weight)).tolist()))
        self.floor = float(-np.log(self.n)) - float(np.logaddexp.reduce(weight))
        known: dict[int, int] = {}
        with np.errstate(over="ignore"):
            for i, p in zip(ids, texts):
                h = np.uint64(0)
                for k, c in enumerate(p):
                    h = h * BASE + np.uint64(ord(c) + 1)
                    known.setdefault(int(h), -1)
                    if k == len(p) - 1:
                        known[int(h)] = i
        self.longest = max(map(len, texts))
        self.n_bytes = np.fromiter(map(len, self.bytes_of), np.int64, self.n)
        self.first_byte = np.cumsum(self.n_bytes) - self.n_bytes
        self.all_bytes = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        # A slot holds one prefix; the few that find their slot taken are looked up by order.
        self.slots = np.full(1 << SLOT_BITS, -1, np.int32)
        self.crowded = np.zeros(1 << SLOT_BITS, bool)
        hashes = np.array(sorted(known), np.uint64)
        for k, at in enumerate((hashes * SPREAD >> np.uint64(64 - SLOT_BITS)).tolist()):
            if self.slots[at] < 0:
                self.slots[at] = k
            else:
                self.crowded[at] = True
        self.hashes = hashes
        self.hash_ids = np.array([known[int(h)] for h in hashes], np.int64)
        self.hash_weight = np.array([self.weight.get(int(i), 0.0) for i in self.hash_ids])

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index of each hash among the pieces' prefixes, or -1."""
        slot = (h * SPREAD >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        at = self.slots[slot]
        at[self.hashes[at] != h] = -1
        again = np.nonzero((at < 0) & self.crowded[slot])[0]
        if len(again):
            k = np.minimum(np.searchsorted(self.hashes, h[again]), len(self.hashes) - 1)
            at[again] = np.where(self.hashes[k] == h[again], k, -1)
        return at

    def spelled(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """Bytes that each of several segmentations spells; ends: where each one's ids begin and end."""
        n = self.n_bytes[ids]
        upto = np.cumsum(n)
        at = np.arange(n.sum()) + np.repeat(self.first_byte[ids] - upto + n, n)
        raw = self.all_bytes[at].tobytes()
        cut = np.concatenate(([0], upto))[ends].tolist()
        return [raw[x + (raw[x : x + 1] == b" " and x < y) : y] for x, y in zip(cut, cut[1:])]

    def decode(self, ids) -> str:
        """Text of a segmentation of a whole text: without the blank put before it."""
        raw = b"".join(map(self.bytes_of.__getitem__, ids))
        return raw[1:].decode("utf-8", "replace") if raw[:1] == b" " else raw.decode("utf-8", "replace")


class Lattice:
    """Lattices of words: edges in order of their start, with conditional log-probabilities."""

    def __init__(self, vocab: Vocabulary, words: list[str]):
        cp = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.uint64)
        lengths = np.array([len(w) for w in words])
        word = np.repeat(np.arange(len(words)), lengths)
        stop = np.repeat(np.cumsum(lengths), lengths)
        active, h = np.arange(len(cp)), np.zeros(len(cp), np.uint64)
        plain = np.ones(len(cp), bool)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for n in range(1, vocab.longest + 1):
            fits = active + n <= stop[active]
            active, h = active[fits], h[fits]
            h = h * BASE + cp[active + (n - 1)] + np.uint64(1)
            at = vocab.find(h)
            hit = at >= 0
            active, h, at = active[hit], h[hit], at[hit]
            if not len(active):
                break
            piece = vocab.hash_ids[at] >= 0
            if n == 1:
                plain[active[piece]] = False
            found.append((active[piece], np.full(piece.sum(), n), vocab.hash_ids[at][piece], vocab.hash_weight[at][piece]))
        raw = np.nonzero(plain)[0]
        width = 1 + (cp[raw] >= 0x80).astype(np.int64) + (cp[raw] >= 0x800) + (cp[raw] >= 0x10000)
        found.append((raw, np.ones(len(raw), np.int64), np.full(len(raw), -1), vocab.floor * width))
        # By start, and the longest first, which mostly are the likeliest.
        start, size, ids, score = (np.concatenate(x) for x in zip(*reversed(found)))
        order = radix(start)
        start, size, ids, score = start[order], size[order], ids[order], score[order]
        first = start + word[start]
        last = first + size
        beta = np.zeros(len(cp) + len(words))
        left = stop[start] - start
        order = radix(left)
        by_left, end, weight, own = left[order], last[order], score[order], first[order]
        groups = np.nonzero(np.r_[True, own[1:] != own[:-1]])[0]
        levels = np.nonzero(np.r_[True, by_left[1:] != by_left[:-1]])[0]
        at = np.searchsorted(groups, np.r_[levels, len(start)])
        for k, e0 in enumerate(levels):
            e1 = levels[k + 1] if k + 1 < len(levels) else len(start)
            heads = groups[at[k] : at[k + 1]]
            beta[own[heads]] = np.logaddexp.reduceat(weight[e0:e1] + beta[end[e0:e1]], heads - e0)
        self.first, self.last, self.size, self.ids = first, last, size, ids
        self.logp = np.minimum(0.0, score + beta[last] - beta[first])
        opens = np.r_[True, self.first[1:] != self.first[:-1]]
        begin = np.nonzero(opens)[0]
        group = np.cumsum(opens) - 1
        self.begin = np.r_[begin, len(self.first)]
        self.group = np.full(len(beta), -1)
        self.group[self.first[begin]] = np.arange(len(begin))
        within = np.exp(self.logp)
        more = begin[np.diff(self.begin) > 1] + 1
        while len(more):
            within[more] += within[more - 1]
            more = more[self.begin[group[more] + 1] > more + 1] + 1
        within /= within[self.begin[1:] - 1][group]
        within[self.begin[1:] - 1] = 1.0
        #: Probability of an edge and the likelier ones of its node.
        self.upto = within
        self.node = np.r_[0, np.cumsum(lengths)[:-1]] + np.arange(len(words))
        # ids of an edge: its piece, or its character's bytes
        counts = np.where(self.ids >= 0, 1, 0)
        bare = np.nonzero(self.ids < 0)[0]
        chars = "".join(words)
        place = self.first[bare] - np.searchsorted(self.node, self.first[bare], side="right") + 1
        spelled = [chars[p].encode("utf-8", "replace") for p in place]
        counts[bare] = [len(x) for x in spelled]
        self.counts, self.offset = counts, np.r_[0, np.cumsum(counts)[:-1]]
        self.flat = np.zeros(counts.sum(), np.int64)
        self.flat[self.offset[self.ids >= 0]] = self.ids[self.ids >= 0]
        for e, x in zip(bare, spelled):
            self.flat[self.offset[e] : self.offset[e] + len(x)] = vocab.byte_ids[list(x)]

    def joined(self, other: Lattice) -> Lattice:
        """This lattice and another one behind it."""
        out = Lattice.__new__(Lattice)
        nodes, edges = len(self.group), len(self.first)
        for name, shift in (("first", nodes), ("last", nodes), ("node", nodes), ("size", 0), ("ids", 0), ("logp", 0)):
            setattr(out, name, np.concatenate((getattr(self, name), getattr(other, name) + shift)))
        out.upto = np.concatenate((self.upto, other.upto))
        out.begin = np.concatenate((self.begin[:-1], other.begin + edges))
        out.group = np.concatenate((self.group, np.where(other.group < 0, -1, other.group + len(self.begin) - 1)))
        out.counts = np.concatenate((self.counts, other.counts))
        out.offset = np.concatenate((self.offset, other.offset + len(self.flat)))
        out.flat = np.concatenate((self.flat, other.flat))
        return out

    def walk(self, node: np.ndarray, key: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Paths drawn from nodes to their words' ends: (item, edge, position) by item."""
        active = np.nonzero(self.group[node] >= 0)[0]
        group, at, key = self.group[node[active]], at[active], key[active]
        items, edges, places = [], [], []
        while len(active):
            e = self.begin[group]
            u = uniform(key, at)
            more = np.nonzero(u >= self.upto[e])[0]
            while len(more):
                e[more] += 1
                more = more[u[more] >= self.upto[e[more]]]
            items.append(active)
            edges.append(e)
            places.append(at)
            group = self.group[self.last[e]]
            go = group >= 0
            at = (at + self.size[e])[go]
            active, group, key = active[go], group[go], key[go]
        if not items:
            return (np.zeros(0, np.int64),) * 3
        item = np.concatenate(items)
        order = radix(item)
        return item[order], np.concatenate(edges)[order], np.concatenate(places)[order]

    def spell(self, edges: np.ndarray) -> np.ndarray:
        n = self.counts[edges]
        if len(n) == n.sum():
            return self.flat[self.offset[edges]]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return self.flat[np.repeat(self.offset[edges], n) + within]


class Path:
    """A sample of one text: all its edges and their positions. Its own steps begin at
    ``own``, below a node of log-probability ``base`` and perturbed value ``value``.

    What it leaves at its steps is a pool of subtrees, step and other edge, whose
    probabilities add up to the node's less the path's. The pool's best perturbed value is
    one truncated Gumbel at the pool's probability, and the subtree that holds it is drawn
    in proportion to probability; taking it out leaves a smaller pool truncated there."""

    __slots__ = ("edges", "places", "own", "base", "upto", "value", "logp", "taken", "mass", "best")

    def __init__(self, edges, places, own, base, logps, value, u):
        self.edges, self.places, self.own, self.base, self.value = edges, places, own, base, value
        self.upto = np.cumsum(logps)
        drop = float(self.upto[-1]) if len(logps) else 0.0
        self.logp = base + drop
        self.taken: set[tuple[int, int]] = set()
        self.mass = base + math.log(-math.expm1(drop)) if drop < 0 else -math.inf
        self.best = truncated(self.mass, value, u)

    def others(self, lattice: Lattice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All subtrees of the pool: step, edge, log-probability."""
        mine = self.edges[self.own :]
        group = lattice.group[lattice.first[mine]]
        n = lattice.begin[group + 1] - lattice.begin[group]
        step = np.repeat(np.arange(len(mine)), n)
        edge = np.repeat(lattice.begin[group] - np.cumsum(n) + n, n) + np.arange(n.sum())
        before = np.concatenate(([0.0], self.upto[:-1])) + self.base
        keep = edge != mine[step]
        for i, e in self.taken:
            keep &= (step != i) | (edge != e)
        return step[keep], edge[keep], before[step[keep]] + lattice.logp[edge[keep]]

    def draw(self, lattice: Lattice, key: np.ndarray) -> tuple[int, int, float] | None:
        """Takes the pool's best subtree out: its step, edge and log-probability."""
        u = uniform(np.repeat(key, 65), np.arange(65))
        found = None
        for k in range(0, 64, 2):
            x = -math.log1p(u[k] * math.expm1(float(self.upto[-1])))
            i = min(int(np.searchsorted(-self.upto, x, side="right")), len(self.upto) - 1)
            own = int(self.edges[self.own + i])
            g = lattice.group[lattice.first[own]]
            lo, hi = int(lattice.begin[g]), int(lattice.begin[g + 1])
            weight = np.exp(lattice.logp[lo:hi])
            weight[own - lo] = 0
            total = weight.sum()
            if total > 0:
                e = lo + min(int(np.searchsorted(np.cumsum(weight), u[k + 1] * total, side="right")), hi - lo - 1)
                if e != own and (i, e) not in self.taken:
                    before = self.base + (float(self.upto[i - 1]) if i else 0.0)
                    found = i, e, before + float(lattice.logp[e])
                    break
        if found is None:
            step, edge, mass = self.others(lattice)
            if not len(mass):
                return None
            upto = np.cumsum(np.exp(mass - mass.max()))
            j = min(int(np.searchsorted(upto, u[0] * upto[-1], side="right")), len(mass) - 1)
            found = int(step[j]), int(edge[j]), float(mass[j])
        top = self.best
        self.taken.add(found[:2])
        share = math.exp(min(0.0, found[2] - self.mass))
        if share < 0.999:
            self.mass += math.log1p(-share)
        else:
            rest = self.others(lattice)[2]
            self.mass = float(np.logaddexp.reduce(rest)) if len(rest) else -math.inf
        self.best = truncated(self.mass, top, float(u[64]))
        return found


class Common:
    """The lattice of words that a worker meets often, made once."""

    def __init__(self, vocab: Vocabulary, split: list[list[str]]):
        seen = Counter(chain.from_iterable(split))
        words = [w for w, c in seen.most_common(COMMON) if c > 1] or list(seen)[:1]
        self.index = dict(zip(words, count()))
        self.lattice = Lattice(vocab, [BLANK + w for w in words])


class Index(dict):
    """Numbers words as they come."""

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number


def sample_texts(vocab: Vocabulary, texts: list[str], keys: np.ndarray, k: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """Per text up to k tuples (ids, log-probability, perturbed value, inclusion)."""
    # A blank leads each word, and the first one too; an empty text has no words.
    split = [x.split(" ") if x else [] for x in texts]
    if vocab.common is None and any(split):
        vocab.common = Common(vocab, split)
    index = Index(vocab.common.index if vocab.common else ())
    known = len(index)
    words = np.fromiter(map(index.__getitem__, chain.from_iterable(split)), np.int64, sum(map(len, split)))
    doc = np.repeat(np.arange(len(texts)), [len(ws) for ws in split])
    starts = np.searchsorted(doc, np.arange(len(texts) + 1))
    root = -np.log(-np.log(uniform(stream(keys, 0), np.zeros(len(keys)))))
    paths: list[list[Path]] = [[] for _ in texts]
    if not len(words):
        return [[(np.zeros(0, np.int64), 0.0, float(g), 1.0)] for g in root]
    lattice = vocab.common.lattice
    if len(index) > known:
        lattice = lattice.joined(Lattice(vocab, [BLANK + w for w in islice(index, known, None)]))
    size = np.fromiter(map(len, index), np.int64, len(index))[words] + 1
    where = np.cumsum(size) - size
    where -= np.repeat(where[np.minimum(starts[:-1], len(where) - 1)], np.diff(starts))

    def grow(nodes: np.ndarray, docs: np.ndarray, at: np.ndarray, number: int, heads: dict) -> None:
        """Draws the rest of one path for each text in heads: text -> (edges, places, log p so far, value)."""
        item, edge, place = lattice.walk(nodes, stream(keys, 2 * number + 1)[docs], at)
        cut = np.searchsorted(docs[item], np.arange(len(texts) + 1)).tolist()
        logp = lattice.logp[edge]
        u = uniform(stream(keys, 2 * number + 2), np.zeros(len(texts))).tolist()
        for d, (edges, places, lp, v) in heads.items():
            s = slice(cut[d], cut[d + 1])
            whole = (np.concatenate((edges, edge[s])), np.concatenate((places, place[s]))) if len(edges) else (edge[s], place[s])
            paths[d].append(Path(*whole, len(edges), lp, logp[s], v, u[d]))

    none = np.zeros(0, np.int64)
    grow(lattice.node[words], doc, where, 0, {d: (none, none, 0.0, float(root[d])) for d in range(len(texts))})
    kappa = np.full(len(texts), -np.inf)
    for number in range(1, k + 1):
        heads, nodes, docs, at = {}, [], [], []
        seeds = stream(keys, 1_000_003 + number)
        for d in range(len(texts)):
            if len(paths[d]) < number:
                continue
            p = max(paths[d], key=lambda p: p.best)
            value = p.best
            if value == -math.inf:
                continue
            if number == k:
                kappa[d] = value
                continue
            if (drawn := p.draw(lattice, seeds[d : d + 1])) is None:
                continue
            i, new, logp = drawn
            place = int(p.places[p.own + i])
            heads[d] = (np.append(p.edges[: p.own + i], new), np.append(p.places[: p.own + i], place), logp, value)
            here = starts[d] + np.searchsorted(where[starts[d] : starts[d + 1]], place, side="right") - 1
            rows = np.arange(here, starts[d + 1])
            node = lattice.node[words[rows]]
            spot = where[rows].copy()
            node[0], spot[0] = lattice.last[new], place + lattice.size[new]
            nodes.append(node)
            docs.append(np.full(len(rows), d))
            at.append(spot)
        if heads:
            grow(np.concatenate(nodes), np.concatenate(docs), np.concatenate(at), number, heads)
    out = []
    for d, own in enumerate(paths):
        with np.errstate(over="ignore"):
            out.append([(lattice.spell(p.edges), p.logp, p.value, float(-np.expm1(-np.exp(p.logp - kappa[d])))) for p in own])
    return out


@functools.lru_cache(maxsize=1)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


DDL = (
    "doc_id long, sample int, ids binary, n_pieces long, ids_crc32 long, decoded_crc32 long, "
    "log_prob double, perturbed double, inclusion double"
)


def sample_segmentations(docs: DataFrame, model: str, k: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs up to k rows: doc_id, sample, ids (little-endian 32-bit ids, one after
    another), n_pieces, ids_crc32 (of ids), decoded_crc32 (UTF-8 of the text they spell),
    log_prob, perturbed, inclusion."""
    types = [pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
    names = [x.split()[0] for x in DDL.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model)

        def emit(rows: list[tuple[int | None, int, str]]) -> pa.RecordBatch:
            keys = np.array([r[1] for r in rows], np.int64).view(np.uint64)
            found = sample_texts(vocab, [r[2] for r in rows], keys, k)
            flat = [(r[0], s, *x) for r, samples in zip(rows, found) for s, x in enumerate(samples)]
            each = [x[2] for x in flat]
            ends = np.cumsum([0, *map(len, each)])
            ids = np.concatenate([*each, np.zeros(0, np.int64)])
            raw = ids.astype("<u4").tobytes()
            at = (4 * ends).tolist()
            own = [raw[x:y] for x, y in zip(at, at[1:])]
            cols = list(zip(*((x[0], x[1], *x[3:]) for x in flat))) or [()] * 5
            texts = list(map(zlib.crc32, vocab.spelled(ids, ends)))
            data = [cols[0], cols[1], own, np.diff(ends), list(map(zlib.crc32, own)), texts, *cols[2:]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(data, types)], names=names)

        held, size = [], 0
        for batch in batches:
            for doc_id, seed, x in zip(*(c.to_pylist() for c in batch.columns)):
                held.append((doc_id, seed, x or ""))
                size += len(held[-1][2])
                if size > CHUNK or len(held) >= 2000:
                    yield emit(held)
                    held, size = [], 0
        if held:
            yield emit(held)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(key).alias("seed"), F.col(text).alias("text")).mapInArrow(run, DDL)
