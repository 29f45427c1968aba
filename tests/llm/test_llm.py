"""Corpus operators against brute force, round trips and held-out accuracy."""

import itertools
import json
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import (
    clumps,
    embed_join,
    html_extract,
    language_id,
    line_dedup,
    lm_scoring,
    near_dedup,
    packing,
    quality_rules,
    queries,
    sharding,
    sp_sampling,
)

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, kept string, row string"
EMPTY = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(x):
    return (x or "").encode().lower().split()


def docs_of(spark, rows):
    return spark.createDataFrame([(i, x, lang, s, len(x or ""), "a", "b", "c") for i, x, lang, s in rows], DOCS)


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(5)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 7))) for _ in range(400)]
    rows = []
    for i in range(80):
        rows.append((i, "\n".join(" ".join(r.choice(vocab) for _ in range(r.randrange(5, 30))) for _ in range(4)), "en", f"s{i % 3}"))
    for i in range(80, 140):
        base = rows[i % 7][1].split(" ")
        for _ in range(r.randrange(0, 5)):
            base[r.randrange(len(base))] = r.choice(vocab)
        rows.append((i, " ".join(base), "en", None))
    rows += [(140, None, None, None), (141, "", "en", "s0"), (142, "  \n ", "en", "s0"), (143, "One two", "en", "s0"), (144, "one two", "en", "s0")]
    rows += [(145, "x y z " * 3000, "de", "s1"), (146, rows[0][1], "en", "s1"), (146, rows[0][1], "en", "s1"), (None, rows[1][1], "en", "s1"), (147, "Ünï 漢字 !! 12", "fr", "s2")]
    return rows


def test_sharding(spark, corpus):
    got = sharding.shard_rows(docs_of(spark, corpus), n_shards=7).collect()
    assert len(got) == len(corpus)
    counts = Counter(r.shard for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    by = {r.doc_id: r for r in got}
    for i, x, *_ in corpus:
        assert by[i].size == len((x or "").encode()) + 16 and by[i].text_crc32 == zlib.crc32((x or "").encode())
    assert sharding.shard_rows(spark.createDataFrame([], EMPTY)).count() == 0


def test_sharding_of_a_key_that_most_rows_have(spark):
    rows = docs_of(spark, [(7 if i % 3 else None if i % 2 else i, f"t{i % 50}", "en", "s") for i in range(6000)])
    got = sharding.shard_rows(rows.repartition(6), n_shards=7).collect()
    assert len(got) == 6000
    for s in range(7):
        mine = sorted(r.slot for r in got if r.shard == s)
        assert mine == list(range(len(mine))) and 857 <= len(mine) <= 858


def test_sharding_places_as_a_walk_round_the_ring_does():
    rng = random.Random(2)
    counts = Counter(int(rng.paretovariate(0.3) * 50) % (1 << 16) for _ in range(3000))
    ring = sharding.virtual_nodes(5, 8)
    room = sharding.bounds(3000, 5, 0.1)
    want, waiting = {}, []
    for cell in sorted(counts):
        own = next((s for c, s in ring if c >= cell), ring[0][1])
        for rank in range(counts[cell]):
            if room[own]:
                room[own] -= 1
                want[cell, rank] = own
            else:
                waiting.append((cell, rank))
    for cell, rank in waiting:
        after = [s for c, s in ring if c >= cell] + [s for c, s in ring if c < cell]
        want[cell, rank] = next(s for s in after if room[s])
        room[want[cell, rank]] -= 1
    got = {}
    for cell, lo, hi, shard, _ in sharding.place(counts, 5, 8, 0.1):
        got.update({(cell, k): shard for k in range(lo, hi)})
    assert got == want


def test_sharding_moves_little():
    rng = random.Random(1)
    counts = Counter(rng.randrange(1 << 16) for _ in range(40_000))
    where = []
    for n in (40, 41):
        at = {}
        for cell, lo, hi, shard, _ in sharding.place(counts, n, 256, 0.05):
            for k in range(lo, hi):
                at[cell, k] = shard
        where.append(at)
        assert max(Counter(at.values()).values()) <= math.ceil(40_000 * 1.05 / n) + 1
    assert sum(where[0][k] != where[1][k] for k in where[0]) < 0.12 * 40_000


def test_line_dedup(spark, corpus):
    key = lambda s: s.strip(" \t\n\x0b\x0c\r").encode().lower().decode()
    seen = {}
    for i, x, *_ in corpus:
        for line in (x or "").split("\n"):
            seen.setdefault(key(line), set()).add(2**63 - 1 if i is None else i)
    got = line_dedup.dedup_lines(docs_of(spark, corpus), carry=("row",)).collect()
    assert len(got) == len(corpus)
    by = {r.doc_id: r for r in got}
    for i, x, *_ in corpus:
        lines = (x or "").split("\n")
        me = 2**63 - 1 if i is None else i
        stay = [s for s in lines if not (len(key(s)) >= 10 and len(seen[key(s)]) > 1 and min(seen[key(s)]) != me)]
        assert by[i].kept_text == "\n".join(stay) and by[i].n_lines == len(lines) and by[i].n_dropped == len(lines) - len(stay)
        assert by[i].row.row == "c"


def test_line_dedup_of_long_documents_and_common_lines(spark):
    long = "\n".join(f"line number {i % 20000}" for i in range(32_000))
    rows = [(0, long, "en", "s"), (1, long, "en", "s"), *((i, f"a line that all have\nown line of {i}", "en", "s") for i in range(2, 300))]
    line_dedup.dedup_lines(docs_of(spark, rows)).count()
    t = time.time()
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs_of(spark, rows), hot=50).collect()}
    assert time.time() - t < 20
    assert got[0].n_dropped == 0 and got[1].n_dropped == 32_000 and got[1].kept_text == ""
    assert got[2].n_dropped == 0 and all(got[i].kept_text == f"own line of {i}" for i in range(3, 300))
    parted = line_dedup.SENT_BYTES, line_dedup.SENT_HASHES
    line_dedup.SENT_BYTES, line_dedup.SENT_HASHES = -1, -1
    try:
        again = line_dedup.dedup_lines(docs_of(spark, rows), hot=50).collect()
    finally:
        line_dedup.SENT_BYTES, line_dedup.SENT_HASHES = parted
    assert {r.doc_id: r for r in again} == got


def test_quality_of_hosts(spark):
    r = random.Random(3)
    rates = {f"h{k}": q for k, q in enumerate((0.05, 0.1, 0.2, 0.1, 0.15, 0.95, 0.6, 1.0, *[0.1] * 20))}
    size = dict.fromkeys(rates, 60) | {"h7": 2}
    facts = [(h, r.random() < q) for h, q in rates.items() for _ in range(size[h])]
    got = {x.host: x for x in quality_rules.host_verdicts(spark.createDataFrame(facts, "host string, base_failed boolean"), 0.5, 1.645).collect()}
    failed, n = Counter(h for h, bad in facts if bad), Counter(h for h, _ in facts)
    each = [failed[h] / n[h] for h in rates]
    m, v = sum(each) / len(each), np.var(each, ddof=1)
    a, b = m * (m * (1 - m) / v - 1), (1 - m) * (m * (1 - m) / v - 1)
    for h in rates:
        mean = (failed[h] + a) / (n[h] + a + b)
        low = mean - 1.645 * math.sqrt(mean * (1 - mean) / (n[h] + a + b + 1))
        assert abs(got[h].host_rate - mean) < 1e-9 and got[h].host_ok == (low <= 0.5)
    assert not got["h5"].host_ok and got["h7"].host_ok and got["h2"].host_ok


def test_quality(spark, corpus):
    def brute(x):
        ws = WORD.findall(x or "")
        wins = list(zip(ws, ws[1:], ws[2:]))
        c, hit = Counter(wins), set()
        for i, w in enumerate(wins):
            if c[w] > 1:
                hit.update((i, i + 1, i + 2))
        seen, dup = set(), 0
        for line in (x or "").split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        return len(ws), sum(map(len, ws)), sum((x or "").count(s) for s in "#*$%&|<>"), dup, len(hit)

    got = {r.doc_id: r for r in quality_rules.judge(docs_of(spark, corpus)).collect()}
    for i, x, *_ in [*corpus]:
        b = brute(x)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == b
        assert r.base_failed == (b[0] < 50 or 100 * b[4] > 50 * b[0]) and not (r.kept and r.base_failed)
    assert quality_rules.text_facts("a|b a|b\na|b a|b\nü ü".encode()) == brute("a|b a|b\na|b a|b\nü ü")
    assert quality_rules.judge(spark.createDataFrame([], EMPTY)).count() == 0
    bad = docs_of(spark, [(i, "short", "en", "bad") for i in range(50)] + [(99, "w%d " * 60 % tuple(range(60)), "en", "bad"), (100, "w%d " * 60 % tuple(range(60)), "en", "good")])
    kept = {r.doc_id: r.kept for r in quality_rules.judge(bad).collect()}
    assert not kept[99] and kept[100]
    assert [r.doc_id for r in quality_rules.keep_good(bad).collect()] == [100]


def test_language(spark):
    def brute(text, ref):
        n, i = 0, 0
        while i < len(text):
            k = 1
            while i + k < len(text) and text[i : i + k + 1] in ref:
                k += 1
            i, n = i + k, n + 1
        return n

    r = random.Random(2)
    refs = tuple((c, language_id.BREAK.join(language_id.plain(" ".join("".join(r.choice(a) for _ in range(4)) for _ in range(60))) for _ in range(3))) for c, a in (("aa", "abcd"), ("bb", "cdef")))
    p = language_id.CrossParser(refs)
    texts = [language_id.plain(" ".join("".join(r.choice("abcdef") for _ in range(3)) for _ in range(30))) for _ in range(5)]
    got = p.phrases(texts)
    for t, row in zip(texts, got):
        assert [brute(t, ref) for _, ref in refs] == row.tolist()
    assert p.judge([None, "", "12 !!", "abab baab"])[:3] == [("und", 0.0)] * 3
    assert p.judge(["dabc baad" * 400])[0][0] == "aa"
    assert language_id.identify(spark.createDataFrame([], EMPTY)).count() == 0


def test_language_end_to_end_as_by_hand(spark):
    r = random.Random(6)
    alphabets = {"aa": "abcd", "bb": "cdef", "cc": "efgä"}
    make = lambda a, n: " ".join("".join(r.choice(a) for _ in range(r.randrange(1, 5))) for _ in range(n))
    rows = [(i, make(a, r.choice((1, 20, 400))), lang, "s") for i, (lang, a) in enumerate(list(alphabets.items()) * 30)]
    rows += [(900, None, "aa", "s"), (901, "12 !", "aa", "s"), (902, "abca", None, "s"), (None, "abca", "aa", "s"), (5, rows[5][1], rows[5][2], "s"), (903, "ÄÖ", "cc", "s")]
    ddl = "doc_id long, text string, lang string, held_out string, score string, p string, l string, o string, t string, b string"
    docs = spark.createDataFrame([(i, x, lang, *"abcdefg") for i, x, lang, _ in rows], ddl)
    refs = language_id.learn(docs.where("doc_id IS NOT NULL AND crc32(string(doc_id)) % 3 <> 1"), rows=10, chars=64)
    assert [k for k, _ in refs] == sorted(alphabets) and all(len(x.split(language_id.BREAK)) <= 10 for _, x in refs)

    def brute(raw, ref):
        n = 0
        for at in range(0, len(raw), language_id.SEGMENT):
            seg, i = raw[at : at + language_id.SEGMENT], 0
            while i < len(seg):
                k = 1
                while i + k < len(seg) and seg[i : i + k + 1] in ref:
                    k += 1
                i, n = i + k, n + 1
        return n

    parser = language_id.CrossParser(refs)
    for _, x, *_ in rows:
        raw = language_id.plain(x or "")
        cost = [brute(raw, ref) * math.log2(len(ref) + 2) / max(1, len(raw)) for _, ref in refs]
        lang, score = parser.judge([x])[0]
        if not any(c.isalpha() for c in x or ""):
            assert (lang, score) == ("und", 0.0)
        else:
            best = min(range(3), key=cost.__getitem__)
            rest = min(c for k, c in enumerate(cost) if k != best)
            assert lang == refs[best][0] and abs(score - (max(0.0, 1 - cost[best] / rest) if rest > 0 else 0.0)) < 1e-9
    got = language_id.identify(docs).collect()
    assert len(got) == len(rows) and all((g.held_out or False) == (g.doc_id is not None and zlib.crc32(str(g.doc_id).encode()) % 3 == 1) for g in got)
    assert len({(g.lang_pred, g.score) for g in got if g.doc_id == 5}) == 1
    unlabelled = language_id.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(g.lang_pred, g.score) for g in unlabelled} == {("und", 0.0)}


def test_language_samples_all_of_a_text_and_any_number_of_languages(spark):
    rows = [(i, "a" * 600 + f" b{i} " * 400, f"l{i % 300:03}", "s") for i in range(900)]
    refs = language_id.learn(docs_of(spark, rows), rows=48, chars=64, total=64 * 300 * 2)
    assert len(refs) == 300 and max(len(x) for _, x in refs) <= 2 * 65
    assert sum(b"b" in x for _, x in refs) > 150  # most places lie beyond the beginning


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in got) > 0.98 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def sets_of(rows, width):
    out = {}
    for i, x, *_ in rows:
        w = words(x)
        out[i] = frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()
    return out


def components(ids, links):
    low = {i: i for i in ids}

    def top(x):
        while low[x] != x:
            x = low[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        low[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def test_near_dedup(spark, corpus):
    rows = [r for r in corpus if r[0] is not None]
    sets = sets_of(rows, 4)
    ids = sorted(sets)
    near = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = components(ids, near)
    got = near_dedup.near_duplicates(docs_of(spark, corpus), width=4).collect()
    assert len(got) == len(corpus)
    for r in got:
        if r.doc_id is None:
            assert r.kept and r.component_id is None
            continue
        assert r.component_id == want[r.doc_id] and r.n_shingles == len(sets[r.doc_id]) and r.kept == (r.component_id == r.doc_id)
    assert near_dedup.near_duplicates(spark.createDataFrame([], EMPTY)).count() == 0


def test_near_dedup_dense_region_with_one_bridge(spark):
    r = random.Random(7)

    def copy(side, noise, k):
        x = [f"{side}{i}" if i < 21 else f"w{i}" for i in range(200)]
        for i in r.sample(range(21, 200), noise):
            x[i] = f"n{k}x{i}"
        return " ".join(x)

    # Two groups of near copies, of which only the two texts without noise link with each other.
    rows = [(k, copy("ab"[k % 2], 0 if k in (300, 301) else 3, k), "en", "s") for k in range(400)]
    sets = sets_of(rows, 1)
    ids = sorted(sets)
    near = [(a, b) for a in ids for b in ids if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert [(a, b) for a, b in near if a % 2 != b % 2] == [(300, 301)]
    got = near_dedup.near_duplicates(docs_of(spark, rows), width=1).collect()
    assert {x.component_id for x in got} == {0}
    small = near_dedup.near_duplicates(docs_of(spark, rows), width=1, block=50).collect()
    assert sorted(small) == sorted(got)


@pytest.mark.parametrize("width", [4, 5])
def test_near_dedup_finds_all_links_of_all_documents(spark, width):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    sets = {i: s for i, s in sets_of(rows, width).items() if s}
    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    both = Counter(p for ids in holders.values() for p in itertools.combinations(ids, 2))
    near = [(a, b) for (a, b), c in both.items() if 100 * c >= 80 * (len(sets[a]) + len(sets[b]) - c)]
    want = components([i for i, _ in rows], near)
    got = near_dedup.near_duplicates(docs, width=width).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(30, 16))
    x = np.concatenate([base, base[:10] + 0.1 * rng.normal(size=(10, 16)), base[:10] + 0.25 * rng.normal(size=(10, 16)), base[:3], 2 * base[:2]])
    rows = [(i, [float(v) for v in np.float32(r)]) for i, r in enumerate(x)]
    odd = [(100, None), (101, [0.0] * 16), (102, [float("nan")] + [1.0] * 15), (103, [None] + [1.0] * 15), (104, [1.0, 2.0]), (105, [])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    v = np.array([r for _, r in rows])
    v /= np.linalg.norm(v, axis=1)[:, None]
    near = v @ v.T >= 0.95
    want = components(range(len(v)), [(a, b) for a in range(len(v)) for b in range(a + 1, len(v)) if near[a, b]])
    for block, pivots in ((2048, 1024), (8, 4), (1, 1)):
        got = {r.vec_id: r for r in embed_join.link_vectors(df, block=block, pivots=pivots).collect()}
        assert len(got) == len(rows) + len(odd)
        for i in range(len(v)):
            assert (got[i].n_links, got[i].component_id, got[i].kept) == (near[i].sum() - 1, want[i], want[i] == i)
        assert all(got[i].n_links == 0 and got[i].kept for i, _ in odd)
    assert embed_join.link_vectors(df.limit(0)).count() == 0


def test_embeddings_in_clusters_with_repeated_and_missing_ids(spark):
    rng = np.random.default_rng(5)
    centres = 5 * rng.normal(size=(12, 8))
    x = np.concatenate([c + 0.8 * rng.normal(size=(60, 8)) for c in centres])
    v = x / np.linalg.norm(x, axis=1)[:, None]
    near = v @ v.T >= 0.95
    r = float(np.sqrt(2 - 2 * 0.95))
    pivots = embed_join.fit_pivots(v, 64)
    assert len(embed_join.suited(v, pivots, 10**7, r)) > 8
    want = components(range(len(v)), [(a, b) for a in range(len(v)) for b in range(a + 1, len(v)) if near[a, b]])
    ddl = "vec_id long, embedding array<double>, v string, rep string, kept string"
    rows = [(i, [float(y) for y in e], "a", "b", "c") for i, e in enumerate(x)]
    for block in (2048, 16):
        got = {r.vec_id: r for r in embed_join.link_vectors(spark.createDataFrame(rows, ddl), block=block).collect()}
        assert all((got[i].n_links, got[i].component_id) == (near[i].sum() - 1, want[i]) for i in range(len(v)))
    a, b, c = [1.0, 0.0], [0.0, 1.0], [1.0, 0.01]
    odd = [(5, a), (5, b), (5, a), (3, b), (7, c), (None, a), (None, None), (9, [-1.0, 0.0])]
    got = embed_join.link_vectors(spark.createDataFrame(odd, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in got) == [
        (0, 0, 0, True), (0, 0, 0, True), (3, 1, 3, True), (5, 1, 3, False), (5, 2, 3, False), (5, 2, 3, False), (7, 2, 3, False), (9, 0, 9, True),
    ]


def spread_vectors(n, dim, seed=7):
    """Evenly spread, with pairs from the threshold on and two groups of near copies; and their links."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    q = n // 10
    z = rng.normal(size=(q, dim))
    z -= (z * x[:q]).sum(1)[:, None] * x[:q]
    z /= np.linalg.norm(z, axis=1)[:, None]
    c = np.concatenate([np.full(q // 2, 0.9500001), rng.uniform(0.9, 1, q - q // 2)])[:, None]
    x[-q:] = c * x[:q] + np.sqrt(1 - c * c) * z
    for g, size in ((2 * q, 90), (2 * q + 90, 40)):
        x[g : g + size] = x[g] + 0.1 / np.sqrt(dim) * rng.normal(size=(size, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    return x, x @ x.T >= 0.95


def test_embeddings_spread_evenly_are_not_all_joined(spark, monkeypatch):
    x, near = spread_vectors(6000, 64)
    n = len(x)
    want = components(range(n), [(a, b) for a, b in zip(*map(np.ndarray.tolist, np.nonzero(near))) if a < b])
    joined = []
    whole = embed_join.metric_links
    monkeypatch.setattr(embed_join, "metric_links", lambda reps, *a: joined.append(reps.count()) or whole(reps, *a))
    rows = [(i, v) for i, v in enumerate(x.tolist())] + [(n + i, v) for i, v in enumerate(x[:5].tolist())]
    rows += [(n + 5, [0.0] * 64), (n + 6, None), (n + 7, [-0.0, 1.0]), (n + 8, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {r.vec_id: r for r in embed_join.link_vectors(df, block=64, direct=2000).collect()}
    assert joined == [91], "the clump of more than a block, and the vector of another length"
    assert len(got) == len(rows)
    copies = 1 + (np.arange(n) < 5)
    for i in range(n):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (near[i] @ copies - 1, want[i], want[i] == i)
    assert all(got[n + i].component_id == want[i] and got[n + i].n_links == near[i] @ copies - 1 for i in range(5))
    assert [got[n + i].n_links for i in range(5, 9)] == [0, 0, 1, 1]


@pytest.mark.parametrize(("n", "dim", "part", "whole"), [(4000, 33, 1 << 18, 2048), (4000, 64, 30, 10), (3000, 300, 1 << 18, 8)])
def test_clumps_hold_all_links(spark, n, dim, part, whole):
    x, near = spread_vectors(n, dim)
    df = spark.createDataFrame(list(enumerate(x.tolist())), "rep long, v array<double>").repartition(2)
    found = clumps.edges(df, dim, n, x[:1000], 0.95, part=part, whole=whole).collect()
    of = components(range(n), [(r.u, r.v) for r in found])
    assert all(of[a] == of[b] for a, b in zip(*map(np.ndarray.tolist, np.nonzero(near))))
    assert len(found) < n, "few others are drawn in"


def test_short_vectors_are_within_their_bound():
    for dim in (1, 7, 64, 300):
        x = np.float32(np.random.default_rng(dim).standard_cauchy(size=(300, dim)))
        x /= np.linalg.norm(x, axis=1)[:, None]
        short = clumps.shorten(x, np.arange(300))
        y, e = clumps.lengthen(short, dim), 1 + short["err"].astype(float)
        z = x @ clumps.rotation(dim, dim, 0)
        assert (np.abs(z @ z.T - y @ y.T) <= np.outer(e, e) - 1 + 1e-5).all()
    links = np.random.default_rng(1).random((40, 60)) < 0.05
    u, v = clumps.thin(links)
    assert links[u, v].all()
    nodes = range(100)
    assert components(nodes, list(zip(u, v + 40))) == components(nodes, [(a, b + 40) for a, b in zip(*np.nonzero(links))])


def brute_class_model(train, model, n_classes):
    """Score of a text's tokens under the class bigrams of model.cls, counted anew."""
    cls = {w: int(model.cls[i]) for w, i in model.symbol.items()}
    of = lambda w: cls[w] if w in cls else n_classes + 1 + lm_scoring.length_class(len(w))
    counts = Counter(w for x in train for w in words(x))
    pairs, firsts = Counter(), Counter()
    for x in train:
        t = [b"", *words(x), b""]
        for u, v in zip(t, t[1:]):
            pairs[of(u), of(v)] += 1
            firsts[of(u)] += 1
    k = n_classes + 1 + lm_scoring.N_LENGTHS
    tail = lambda c: [w for w in counts if w not in cls and of(w) == c]

    def emit(w):
        c = of(w)
        if w in cls:
            mine = [counts[v] for v in cls if v and cls[v] == c]
            return math.log10((counts[w] + 0.1) / (sum(mine) + 0.1 * len(mine)))
        own = tail(c)
        return math.log10((counts[w] + 0.1) / (sum(counts[v] for v in own) + 0.1 * (len(own) + 1)))

    def score(x):
        t = [b"", *words(x), b""]
        return sum(math.log10((pairs[of(u), of(v)] + 0.1) / (firsts[of(u)] + 0.1 * k)) for u, v in zip(t, t[1:])) + sum(map(emit, t[1:-1]))

    return score, emit, cls


def test_lm_scoring(spark, corpus):
    rows = [*corpus, (150, "x" * 5000 + " one " + "x" * 5000, "en", "s")]
    train = [x for i, x, *_ in rows if i is None or zlib.crc32(str(i).encode()) % 10]
    counts = Counter(w for x in train for w in words(x))
    counts[b""] = len(train)
    n, v = sum(counts.values()), len(counts)
    for head in (50_000, 40):
        df = docs_of(spark, rows)
        got = lm_scoring.score_texts(df, head=head, n_classes=4).collect()
        assert len(got) == len(rows)
        learnt = df.where("doc_id IS NULL OR crc32(string(doc_id)) % 10 <> 0").select("text")
        model, _ = lm_scoring.learn(learnt, head, 4, 5)
        assert set(model.cls[: len(model.head)]) <= set(range(4)) and len(model.head) == min(head, sum(0 < len(w) <= 64 for w in counts))
        score, emit, cls = brute_class_model(train, model, 4)
        for c in range(4):
            assert abs(sum(10 ** emit(w) for w in model.head if cls[w] == c) - 1) < 1e-9
        by = {r.doc_id: r for r in got}
        for i, x, *_ in rows:
            toks = [*words(x), b""]
            base = sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in toks)
            r = by[i]
            assert r.n_tokens == len(toks) and r.n_known == sum(counts[t] > 0 for t in toks) and r.train_tokens == n
            assert abs(r.base_score - base) < 1e-6 * abs(base) and abs(r.score - score(x)) < 1e-6 * abs(r.score)
    assert lm_scoring.score_texts(spark.createDataFrame([], EMPTY)).count() == 0
    untrained = docs_of(spark, [(i, "a b", "en", "s") for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0])
    assert all(r.held_out and r.train_tokens == 0 and r.n_known == 0 for r in lm_scoring.score_texts(untrained).collect())


def test_lm_scoring_of_few_long_texts(spark):
    text = "aa " * 50 + "bb " * 40 + "cc " * 30 + "dd"
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 10][:3]
    counts = {"aa": 150, "bb": 120, "cc": 90, "dd": 3, "": 3}
    n, v = sum(counts.values()), len(counts)
    base = sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in [*text.split(), ""])
    got = lm_scoring.score_texts(docs_of(spark, [(i, text, "en", "s") for i in ids]), head=2, n_classes=2).collect()
    assert len(got) == 3
    for r in got:
        assert r.n_known == r.n_tokens == 122 and abs(r.base_score - base) < 1e-6 * abs(base)


def test_lm_tokens_and_bigrams_in_parts(monkeypatch):
    texts = [None, "", " \n", "One two", " one\x0btwo\x0cthree  one ", "a\x1cb\x85c\u2003d \x00 É É", "x " * 50, "lonG" * 9 + " b one"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    got, place, n_words = lm_scoring.tokens(batch.column(0).slice(0))
    assert [got[i].as_py() for i in place.tolist()] == [w for x in texts for w in words(x)]
    assert n_words.tolist() == [len(words(x)) for x in texts]
    counts = Counter(w for x in texts for w in words(x)) + Counter({b"": len(texts)})
    model = lm_scoring.ClassModel({w: counts[w] for w in (b"one", b"x", "É".encode())}, len(texts), 1, 1)
    symbol = lambda w: model.symbol[w] if w in model.symbol else 4 + lm_scoring.length_class(len(w))
    lines = [[symbol(w) for w in (b"", *words(x), b"")] for x in texts]
    pairs = Counter(p for t in lines for p in zip(t, t[1:]))
    for gather, most, portion in ((1 << 21, 4_000_000, 1 << 23), (3, 2, 10)):
        for name, value in (("GATHER", gather), ("PAIRS", most), ("PORTION", portion), ("FLUSH", most), ("BLOCKS", 2)):
            monkeypatch.setattr(lm_scoring, name, value)
        seen, found, total = Counter(), Counter(), Counter()
        for part in lm_scoring.count_words(iter([batch, batch.slice(0, 0)])):
            for w, n in zip(*(c.to_pylist() for c in part.columns)):
                seen[w] += n
        assert seen == counts
        sums, n = lm_scoring.Bigrams(), model.n_symbols

        def take():
            a, b = np.divmod(sums.codes, n)
            for _, block, a, b, c in lm_scoring.unpacked(lm_scoring.packed(0, a % 2, a, b, sums.counts)):
                assert (a % 2 == block).all()
                found.update(dict(zip(zip(a.tolist(), b.tolist()), c.tolist())))
            sums.clear()

        for part in lm_scoring.portions(iter([batch])):
            w, place, n_words = lm_scoring.tokens(part.column(0))
            line = model.line(model.symbols(w)[place], n_words)
            if sums.add(line[:-1] * n + line[1:]):
                take()
        sums.merge()
        take()
        assert found == pairs
        twice = lm_scoring.Bigrams()
        for (a, b), c in [*found.items(), *found.items()]:
            if twice.add(np.array([a * n + b]), np.array([c])):
                total.update(dict(zip(twice.codes.tolist(), twice.counts.tolist())))
                twice.clear()
        twice.merge()
        total.update(dict(zip(twice.codes.tolist(), twice.counts.tolist())))
        assert total == Counter({a * n + b: 2 * c for (a, b), c in pairs.items()})


def test_a_round_of_exchange_is_one_scan_of_exact_counts(spark, corpus, monkeypatch):
    train = docs_of(spark, corpus).select("text")
    seen = []

    def stages(looks):
        def exchange(look, frequency, n_classes, rounds):
            cls = np.arange(len(frequency)) % n_classes
            seen.extend(look(cls) for _ in range(looks))
            return cls

        monkeypatch.setattr(lm_scoring, "exchange", exchange)
        group, tracker = f"looks {looks}", spark.sparkContext.statusTracker()
        spark.sparkContext.setJobGroup(group, group)
        model, _ = lm_scoring.learn(train, 300, 4, 1)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        time.sleep(2)  # the tracker hears of jobs a little later
        return model, sum(len(tracker.getJobInfo(j).stageIds) for j in tracker.getJobIdsForGroup(group))

    (model, once), (_, thrice) = stages(1), stages(3)
    assert thrice - once == 2
    head, k = len(model.head), 4 + 1 + lm_scoring.N_LENGTHS
    symbol = lambda w: model.symbol[w] if w in model.symbol else head + 1 + lm_scoring.length_class(len(w))
    before, after, twice, table = np.zeros((head, k)), np.zeros((head, k)), np.zeros(head), np.zeros((k, k))
    for _, x, *_ in corpus:
        t = [symbol(w) for w in (b"", *words(x), b"")]
        for a, b in zip(t, t[1:]):
            table[model.cls[a], model.cls[b]] += 1
            if a < head:
                after[a, model.cls[b]] += 1
                twice[a] += a == b
            if b < head:
                before[b, model.cls[a]] += 1
    assert head == 300 and len(seen) == 4
    for contexts, classes in seen:
        assert all(np.array_equal(x, y) for x, y in zip((*contexts, classes), (before, after, twice, table)))


def test_exchange_finds_planted_classes():
    rng = np.random.default_rng(1)
    kind = np.arange(40) % 4
    table = rng.poisson(np.where((kind[:, None] + 1) % 4 == kind[None, :], 30, 1) * rng.random((40, 1)) * 3).astype(float)
    frequency = table.sum(1)
    seen = []

    def look(cls):
        one = np.eye(4)[cls]
        classes = one.T @ table @ one
        seen.append(lm_scoring.likelihood(classes))
        return (table.T @ one, table @ one, np.diag(table)), classes

    start = rng.permutation(40)
    table, frequency, kind = table[start][:, start], frequency[start], kind[start]
    cls = lm_scoring.exchange(look, frequency, 4, rounds=20, few=0)
    assert len({(int(k), int(c)) for k, c in zip(kind, cls)}) == 4
    assert max(seen) > seen[0] + 1
    # In batches it gets far as well, and never to less than where it began.
    several = lm_scoring.exchange(look, frequency, 4, rounds=20, few=0, one_by_one=8)
    one = np.eye(4)[several]
    assert lm_scoring.likelihood(one.T @ table @ one) > seen[0] + 0.5 * (max(seen) - seen[0])


def test_sampling(spark, corpus):
    v = sp_sampling.Vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    texts = [x or "" for _, x, *_ in corpus[70:]]
    keys = sp_sampling.mix(np.arange(len(texts), dtype=np.uint64))
    together = sp_sampling.sample_texts(v, texts, keys, 3)
    for t, k, found in zip(texts, keys, together):
        assert all(v.decode(ids.tolist()) == t for ids, *_ in found)
        assert len({tuple(ids) for ids, *_ in found}) == len(found) and (len(found) == 3 or len(t.split()) < 2)
        assert [f[2] for f in found] == sorted((f[2] for f in found), reverse=True)
        alone = sp_sampling.sample_texts(v, [t], np.array([k]), 3)[0]
        assert [tuple(a[0]) for a in alone] == [tuple(a[0]) for a in found]
    n = 4000
    found = sp_sampling.sample_texts(v, ["then an"] * n, sp_sampling.mix(np.arange(n, dtype=np.uint64)), 2)
    first = Counter(tuple(f[0][0]) for f in found)
    prob = {tuple(s[0]): math.exp(s[1]) for f in found for s in f}
    assert all(abs(first[k] / n - p) < 0.03 for k, p in prob.items())
    assert abs(np.mean([sum(math.exp(s[1]) / s[3] for s in f) for f in found]) - 1) < 0.02
    got = sp_sampling.sample_segmentations(docs_of(spark, corpus), public_tokenizers.path("piece_bpe_32k.model"))
    assert got.where("sample = 0").count() == len(corpus)


def test_sampling_of_odd_texts(spark):
    v = sp_sampling.Vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    texts = ["x" * 40_000, "漢" * 3000, " ", "  a  ", "\u2581b", "a\x00b", "\t\n", "q"]
    keys = sp_sampling.mix(np.arange(len(texts), dtype=np.uint64))
    for t, found in zip(texts, sp_sampling.sample_texts(v, texts, keys, 2)):
        assert all(v.decode(ids.tolist()) == t.replace("\u2581", " ") for ids, *_ in found)
    rows = [(None, "one two", "en", "s"), (1, None, "en", "s"), (1, "", "en", "s"), (2, "x" * 40_000, "en", "s"), (2, "x" * 40_000, "en", "s")]
    df = docs_of(spark, rows).withColumn("ids", F.lit("a")).withColumn("sample", F.lit("b"))
    got = sp_sampling.sample_segmentations(df, public_tokenizers.path("piece_bpe_32k.model")).collect()
    assert sum(r.sample == 0 for r in got) == 5 and all(r.ids == b"" and r.inclusion == 1 for r in got if r.doc_id == 1)
    assert len({r.ids for r in got if r.doc_id == 2}) == 2


def test_sampling_query_returns_segmentations(spark):
    d = "/root/testdata/sf0.001"
    v = sp_sampling.Vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = queries.op9_sp_sampling(spark, d).collect()
    assert {r.doc_id for r in got} == set(texts)
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.n_pieces and v.decode(ids) == texts[r.doc_id]
        assert r.ids_crc32 == zlib.crc32(r.ids) and r.decoded_crc32 == zlib.crc32(texts[r.doc_id].replace("▁", " ").encode())


def test_packing(spark, corpus):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    model = Tokenizer.from_file(path)
    special = "a <|endoftext|> b<|startoftext|>c <|ENDOFTEXT|> <|endoftext|"
    extra = [(200, "don't ÀÉ!! it's a1b x² ªº <|endoftext|> ﬁne ΣΑΣ é ­-- " * 50, "en", "s"), (201, special, "en", "s"), (202, "<| x |>", "en", "s")]
    rows = [*corpus, *extra, (203, "w " * 4095, "en", "s"), (204, "w " * 9000, "en", "s")]
    got = packing.pack(docs_of(spark, rows).repartition(3), path).toPandas()
    want = Counter()
    for i, x, *_ in rows:
        want[i, tuple([*model.encode(x or "", add_special_tokens=False).ids, 2])] += 1
    for i in {r[0] for r in rows}:
        mine = got[got.doc_id.isna() if i is None else got.doc_id == i]
        texts = [ids for (j, ids), c in want.items() for _ in range(c) if j == i]
        spans = Counter((r.start, r.length) for r in mine.itertuples())
        assert sum(n * c for (_, n), c in spans.items()) == sum(map(len, texts)) and set(mine.doc_tokens) == set(map(len, texts))
        for r in mine.itertuples():
            assert any(zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for x in texts)
        if len(texts) == 1:
            m = mine.sort_values("start")
            assert m.start.tolist() == [0, *np.cumsum(m.length)[:-1]]
    pad = 0
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]]
        assert g.step_group.nunique() == g.tier.nunique() == 1
        n = int(g.length.sum())
        assert n <= 4096
        pad += 0 if n & (n - 1) == 0 else 4096 - n
    assert pad < 4096
    empty = packing.pack(spark.createDataFrame([], EMPTY), path)
    assert empty.count() == 0


def test_packing_ids_of_all_documents(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    model, words = Tokenizer.from_file(path), packing.WordIds(path)
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    for at in range(0, len(texts), 200):
        want = model.encode_batch(texts[at : at + 200], add_special_tokens=False)
        for mine, e in zip(words.ids(texts[at : at + 200]), want):
            assert np.frombuffer(mine, "<u4").tolist() == [*e.ids, 2]


def test_packing_keeps_documents_whole_and_groups_even(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    r = random.Random(4)
    rows = [(i, "w " * int(r.paretovariate(0.8) * 60 % 6000), "en", "s") for i in range(3000)]
    got = packing.pack(docs_of(spark, rows).repartition(4), path, group_tokens=16 * 4096).toPandas()
    for n, g in got.groupby("doc_id"):
        assert g.length.sum() == len(rows[n][1].split()) + 1
    short = got[got.doc_tokens <= 4096].groupby("doc_id").size()
    assert (short > 1).mean() < 0.1
    groups = got.groupby("step_group").length.sum()
    assert groups.index.tolist() == list(range(len(groups))) and len(groups) > 5
    assert groups.max() - groups.min() <= 3 * 4096
    for tier, g in got.groupby("tier"):
        assert g.groupby("sequence_id").length.sum().max() <= tier


PAGE = (
    '<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li>'
    '<a href="/x">menu {0}</a></li></ul></nav><div class="ad">buy {0}</div><article><h1>Title {0} &amp; more</h1><p><b>Bold {0}'
    "<br><p>Second\n  paragraph &lt;{0}&gt; &#233;</p><div class=comments><p>nice {0}</p></div></article>"
    "<aside>side</aside><form>go</form><footer>&copy; host</footer></body></html>"
)
PLAIN = '<html><body><div class="top">Site</div><div id="content"><p>{0} text that is long enough to be the main part {0}</p></div><p>same on all</p></body></html>'


def test_html(spark):
    rows = [(i, f"http://a.example/{i}", PAGE.format(i)) for i in range(10)]
    rows += [(20 + i, f"http://b.example/{i}", PLAIN.format(i * 7)) for i in range(10)]
    rows += [(50, "http://c.example/", None), (51, None, ""), (52, "x", "<p>lone"), (53, "http://a.example/z", "<article><p>cut <"), (53, "http://a.example/z", "<article><p>cut <")]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r.text for r in got}
    assert by[3] == "Title 3 & more\nBold 3\nSecond paragraph <3> é"
    assert by[22] == "14 text that is long enough to be the main part 14"
    assert by[50] == by[51] == "" and by[52] == "lone" and by[53].startswith("cut")
    assert all(r.n_chars == len(r.text) for r in got)
    salted = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), broadcast_bytes=-1)
    assert {r.page_id: r.text for r in salted.collect()} == by
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def html_texts(spark, rows):
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    return {r.page_id: r.text for r in got}


def test_html_drops_constant_text_in_the_article(spark):
    page = "<html><body><article><h1>Head {0}</h1><p>Body {0}</p><div class=box><p>Written by us</p></div><div class=x><p>twice</p></div><div class=x><p>twice</p></div></article></body></html>"
    texts = html_texts(spark, [(i, f"http://a.example/{i}", page.format(i)) for i in range(10)])
    assert texts == {i: f"Head {i}\nBody {i}" for i in range(10)}
    same = html_texts(spark, [(i, f"http://a.example/{i}", page.format(0)) for i in range(10)])
    assert same[0].startswith("Head 0\nBody 0")


def test_html_keeps_all_of_the_article(spark):
    cards = "<html><body><main><h1>Head {0}</h1><p>Body {0}</p><article><p>Card {0}</p></article></main></body></html>"
    entry = '<html><body><article><div class="entry-header"><h1>Head {0}</h1></div><p>Body {0}</p></article></body></html>'
    parts = "<html><body><div class=top>Site</div><div id=a><p>" + "long {0} " * 20 + "</p></div><div id=b><p>short {0}</p></div></body></html>"
    rows = [(100 * k + i, f"http://h{k}.example/{i}", page.format(i)) for k, page in enumerate((cards, entry, parts)) for i in range(3)]
    texts = html_texts(spark, rows)
    for i in range(3):
        assert texts[i] == f"Head {i}\nBody {i}\nCard {i}"
        assert texts[100 + i] == f"Head {i}\nBody {i}"
        assert texts[200 + i] == (f"long {i} " * 20).strip() + f"\nshort {i}"


def test_html_of_any_length_is_read_in_one_scan():
    t = time.time()
    assert html_extract.main_text("<p>one</p>" + "<a " * 350_000, None).startswith("one")
    assert html_extract.main_text('<p>one</p><a "' + '<a ">" ' * 150_000 + "<p>two", None).startswith("one")
    assert html_extract.main_text("<div>" * 100_000 + "deep" + "</span></div>" * 100_000, None) == "deep"
    assert html_extract.main_text("<p>" + "a < b " * 200_000, None).startswith("a < b a < b")
    assert time.time() - t < 20
    assert html_extract.main_text('<p title="a > b">x</p><!-- <p>no</p> --><p>y &lt;p&gt;</p><p>z <', None) == "x\ny <p>\nz <"


def test_html_templates_as_deduced_one_by_one(spark):
    page = (
        '<html><body><div class="top"><p>Site</p></div><article><h1>Head {0}</h1><p>Body {0}</p>'
        '<section class="q7"><p>Written by the team</p></section>{1}</article></body></html>'
    )
    rows = [(i, f"http://a.example/{i}", page.format(i, "<p>on some pages</p>" if i % 3 == 0 else "")) for i in range(9)]
    with_columns = spark.createDataFrame([(*r, "a", "b") for r in rows], "page_id long, url string, html string, host string, template string")
    texts = {r.page_id: r.text for r in html_extract.extract(with_columns).collect()}
    # Occurrence vectors in full: how often each token stands on each page.
    vectors = {}
    for i, _, html in rows:
        p = html_extract.Page(html)
        for path, (count, _) in p.elements.items():
            vectors.setdefault(("element", path), {})[i] = count
        for path, skip, text in p.blocks:
            if not skip:
                v = vectors.setdefault((path, text), {})
                v[i] = v.get(i, 0) + 1
    classes = {}
    for token, v in vectors.items():
        classes.setdefault(tuple(sorted(v.items())), []).append(token)
    valid = [m for v, m in classes.items() if 2 * len(v) >= len(rows) and any(t[0] == "element" for t in m)]
    constant = {t for m in valid for t in m if t[0] != "element"}
    assert {t[1] for t in constant} == {"Site", "Written by the team"}
    # The template nests elements of valid classes; only slots that vary are extracted.
    elements = {t[1] for m in valid for t in m if t[0] == "element"}
    tree = html_extract.deduce(
        [
            {"path": t[1] if t[0] == "element" else t[0], "block": None if t[0] == "element" else zlib.crc32(t[1].encode()), "vector": n, "pages": len(v), "total": sum(v.values()),
             "mass": sum(len(x) for i in v for p, skip, x in html_extract.Page(rows[i][2]).blocks if not skip and (html_extract.within(p, [t[1]]) if t[0] == "element" else (p, x) == t))}
            for n, (v, m) in enumerate((dict(v), m) for v, m in classes.items() if 2 * len(v) >= len(rows))
            for t in m
        ]
    )
    found = html_extract.Template(json.loads(tree))
    assert found.roots == ("/html/body/article",) and set(found.elements) == {e for e in elements if "/article" in e}
    assert set(found.slots) == {"/html/body/article/h1", "/html/body/article/p"}
    for i, _, html in rows:
        blocks = [(p, x) for p, skip, x in html_extract.Page(html).blocks if not skip and "/article" in p]
        assert texts[i] == "\n".join(x for p, x in blocks if (p, x) not in constant)
        assert html_extract.main_text(html, None) != texts[i] and "on some pages" in html_extract.main_text(html, None) or i % 3


def test_pipeline(spark, corpus, tmp_path):
    import corpus_pipeline

    body = "\n".join(" ".join(f"w{i}x{j}" for j in range(8)) for i in range(20))
    twin = " ".join(f"word{i}" for i in range(80))
    rows = [*corpus, (200, body, "en", "s1"), (201, "\n".join(reversed(body.split("\n"))), "en", "s1"), (202, twin, "en", "s1"), (202, twin, "en", "s1"), (203, twin + " more", "en", "s1"), (None, twin, "en", None)]
    df = docs_of(spark, rows)
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, "")
        assert out.columns == df.columns
        seen[name] = out.collect()
        df = spark.createDataFrame(seen[name], out.schema)
    ids = {k: Counter(r.doc_id for r in v) for k, v in seen.items()}
    assert 0 < len(seen["near_duplicates"]) < len(rows)
    assert ids["quality"][200] == ids["quality"][201] == 1 and ids["quality"][202] == 2 and not ids["quality"][143]
    assert ids["quality"][None] == ids["near_duplicates"][None] == 2 and ids["lines"] == ids["language"]
    empty = {r.doc_id: r.text for r in seen["lines"]}
    assert empty[201] == "" and empty[200] == body and ids["near_duplicates"][201] == 1
    assert ids["near_duplicates"][202] == 1 and ids["near_duplicates"][203] == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, df, "").collect()
    assert {r.doc_id for r in packed} == set(ids["near_duplicates"]) and [r.length for r in packed if r.doc_id == 201] == [1]
    empty = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0


def test_a_broken_import_is_not_hidden(monkeypatch):
    import sys

    import __spark_entry__

    for name in [m for m in sys.modules if m.startswith("tessera.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "xxhash", None)
    with pytest.raises(ImportError):
        __spark_entry__._corpus()
