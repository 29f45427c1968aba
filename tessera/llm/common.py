"""What the corpus operators share: tables in the shared folder, and text scans.

Words everywhere are runs of bytes outside ``[\\x20\\x09-\\x0D]``; ``bytes.split()``
splits at exactly those six bytes, and ``bytes.lower()`` lower-cases A-Z only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from ..plans.lineage import settle

__all__ = ["BLANKS", "learns_from", "settle", "small_batches", "table"]

#: The six bytes that separate words and are stripped from lines (fixed values).
BLANKS = " \t\n\x0b\x0c\r"


#: Rows of an Arrow batch: texts are long, and both ends hold whole batches.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches of texts small; a smaller setting of the session's stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def learns_from(doc_id: Column, modulus: int, held_out: int) -> Column:
    """False for the held-out fold, which crc32 of doc_id as text decides."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus != held_out, F.lit(True))
