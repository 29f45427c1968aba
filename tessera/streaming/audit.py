"""The decision log as a stream: each batch is merged into the knowledge base once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import kb


def decisions(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    return spark.readStream.schema(ddl).json(path)


def windowed_counts(log: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Decisions by window and status; rows later than ``late`` are not counted."""
    return log.withWatermark("ts", late).groupBy(F.window("ts", width), "status").agg(F.count("*").alias("n"))


def maintain(log: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Keeps the table at target current. Each batch writes version batch+1 from version
    batch, so a batch that is run again after a failure writes the same version."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = spark.read.parquet(f"{target}/v={number}")
        kb.upsert(old, batch).write.mode("overwrite").parquet(f"{target}/v={number + 1}")

    return log.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, target: str, versions: int) -> DataFrame:
    return spark.read.parquet(f"{target}/v={versions}")
