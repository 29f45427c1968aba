"""Document rules, and verdicts on the hosts whose documents fail them.

One pass over each text gives the counts and the base verdict. Failures are added
up by host (combined before the shuffle); the hosts' rates give a beta prior by the
method of moments, and each host's rate is shrunk towards it. A host takes all its
documents down if its posterior leaves no doubt that most of its documents fail: if
the shrunk rate less ``sure`` standard deviations of the posterior is above ``max_rate``.
So a few failures condemn no small host, and a host that fails somewhat more often than
others keeps its good documents. The host table joins back by an ordinary join of narrow
rows, which Spark turns into a broadcast only if it measured it small.

Defined results: null or empty text has no words and fails; a null host is a host
of its own; repeated rows count each; fewer than two hosts leave the flat prior
(1, 1); an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from .common import settle

SYMBOL = re.compile(rb"[#*$%&|<>]")
WORD_BYTE = re.compile(rb"[^\x20\x09-\x0D]")
FACTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def text_facts(raw: bytes) -> tuple[int, int, int, int, int]:
    words = raw.split()
    n = len(words)
    joined = b"".join(words)
    chars = len(joined.decode("utf-8", "replace"))
    seen: set[bytes] = set()
    dup_lines = 0
    for line in raw.split(b"\n"):
        if line in seen:
            dup_lines += 1
        elif WORD_BYTE.search(line):
            seen.add(line)
    windows = list(zip(words, words[1:], words[2:]))
    repeated = {k for k, c in Counter(windows).items() if c > 1} if len(set(windows)) < len(windows) else ()
    covered = upto = 0
    if repeated:
        for i, w in enumerate(windows):
            if w in repeated:
                covered += i + 3 - max(upto, i)
                upto = i + 3
    return n, chars, len(SYMBOL.findall(raw)), dup_lines, covered


def facts_of(text: Column) -> Column:
    """text -> struct of the counts."""

    def facts(text: pa.Array) -> pa.Array:
        rows = [text_facts((x.as_py() or "").encode("utf-8", "replace")) for x in text]
        cols = list(zip(*rows)) or [()] * 5
        return pa.StructArray.from_arrays(
            [pa.array(c, pa.int64()) for c in cols],
            names=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"],
        )

    return F.arrow_udf(facts, FACTS)(text)


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """(alpha, beta) by moments of the hosts' failure rates; hosts has n and failed."""
    rate = F.col("failed") / F.col("n")
    m, v, k = hosts.agg(F.avg(rate), F.var_samp(rate), F.count("*")).first()
    if not k or k < 2 or not v or m <= 0 or m >= 1:
        return 1.0, 1.0
    strength = max(m * (1 - m) / v - 1, 1e-3)
    return m * strength, (1 - m) * strength


def base_failed(min_words: int, max_repeat: int):
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))


#: Host of rows without one.
NO_HOST = "\x00none"


def host_verdicts(facts: DataFrame, max_rate: float, sure: float) -> DataFrame:
    """host -> host_rate (shrunk), host_ok; facts has host and base_failed."""
    hosts = facts.groupBy("host").agg(F.count("*").alias("n"), F.count_if("base_failed").alias("failed"))
    a, b = beta_prior(hosts)
    rate = (F.col("failed") + a) / (F.col("n") + a + b)
    doubt = sure * F.sqrt(rate * (1 - rate) / (F.col("n") + a + b + 1))
    return hosts.select("host", rate.alias("host_rate"), (rate - doubt <= max_rate).alias("host_ok"))


def judge(
    docs: DataFrame,
    min_words: int = 50,
    max_repeat: int = 50,
    max_rate: float = 0.5,
    sure: float = 1.645,
    key: str = "doc_id",
    text: str = "text",
    host: str = "source",
) -> DataFrame:
    """Per row of docs: doc_id, host, the counts, base_failed, host_rate, kept."""
    facts = settle(
        docs.select(
            F.col(key).alias("doc_id"),
            F.coalesce(F.col(host), F.lit(NO_HOST)).alias("host"),
            facts_of(F.col(text)).alias("f"),
        )
        .select("doc_id", "host", "f.*")
        .withColumn("base_failed", base_failed(min_words, max_repeat)),
        "facts",
    )
    return facts.join(host_verdicts(facts, max_rate, sure), "host").withColumn(
        "kept", ~F.col("base_failed") & F.col("host_ok")
    )


#: Host names up to this number are sent to all tasks; more are joined by a shuffle.
SENT_HOSTS = 500_000


def keep_good(
    docs: DataFrame,
    min_words: int = 50,
    max_repeat: int = 50,
    max_rate: float = 0.5,
    sure: float = 1.645,
    key: str = "doc_id",
    text: str = "text",
    host: str = "source",
) -> DataFrame:
    """The rows of docs that ``judge`` keeps, with their own columns. Texts are read and
    judged once: rows that pass are written beside the verdicts of all. Only the hosts'
    table is joined, so texts are not shuffled."""
    own = F.when(~F.col("base_failed"), F.struct(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns)))
    judged = settle(
        docs.select(
            F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
            F.coalesce(F.col(f"`{host}`"), F.lit(NO_HOST)).alias("host"),
            facts_of(F.col(f"`{text}`")).alias("f"),
        )
        .select("row", "host", "f.*")
        .withColumn("base_failed", base_failed(min_words, max_repeat))
        .select("host", "base_failed", own.alias("row")),
        "judged",
    )
    verdicts = host_verdicts(judged.select("host", "base_failed"), max_rate, sure)
    bad = settle(verdicts.where(~F.col("host_ok")).select("host"), "bad_hosts")
    if bad.count() <= SENT_HOSTS:
        bad = F.broadcast(bad)
    return judged.where(~F.col("base_failed")).join(bad, "host", "left_anti").select("row.*")
