"""Documents to packed training sequences: five stages, each one corpus operator.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; it
is written as Parquet and read again in between. All but the last return the columns
of documents, further ones included.

1. quality: documents that fail the rules, or whose host does, go.
2. language: documents without a recognisable language (``und``) go.
3. lines: lines that several documents share stay in the first of them alone; text
   and n_chars change, no row goes. A document all of whose lines stand in earlier ones
   is empty from here on.
4. near_duplicates: of each group of near duplicates (five-word shingles, similarity
   0.8 or more) the first stays, and of rows that repeat doc_id and text one. Texts are
   compared as the stage before left them; empty ones link with nothing and stay.
5. packing: token sequences of at most 4096, one row per piece; an empty document is its
   closing id.

Rows without doc_id pass through all stages; they are near duplicates of nothing.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import language_id, line_dedup, near_dedup, packing, quality_rules
from tessera.llm.common import small_batches, table
from tessera.plans.lineage import settle


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return quality_rules.keep_good(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    predict = language_id.predictor(language_id.learn(docs))
    known = docs.withColumn("__tessera_lang", predict(F.col("text")))
    return known.where(F.col("__tessera_lang.lang_pred") != "und").drop("__tessera_lang")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    deduped = line_dedup.dedup_lines(docs, carry=tuple(docs.columns))
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return deduped.select(*(new[c].alias(c) if c in new else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return near_dedup.keep_first(docs, width=5, threshold=0.8)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality),
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("packing", pack),
]

#: Language identification is not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
