"""Row numbers and running totals over a whole table without a task that holds it: rows are
dealt out by ranges of the order, each range is numbered on its own, and the totals of the
ranges before it (one number a range) are added."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .lineage import settle


def running(df: DataFrame, value: Column, *order: Column | str, name: str = "total") -> DataFrame:
    """df with the sum of value over all rows up to this one; order must leave no ties."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = settle(
        df.withColumn("__value", value).repartitionByRange(parts, *order).withColumn("__range", F.spark_partition_id()), "ranges"
    )
    totals = dealt.groupBy("__range").agg(F.sum("__value").alias("n")).orderBy("__range").collect()
    firsts, upto = [], 0
    for r in totals:
        firsts.append((r["__range"], upto))
        upto += r.n or 0
    before = spark.createDataFrame(firsts, "__range int, __before long")
    inside = F.sum("__value").over(W.partitionBy("__range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return dealt.join(F.broadcast(before), "__range").withColumn(name, F.col("__before") + inside).drop("__value", "__range", "__before")


def places(df: DataFrame, *order: Column | str, name: str = "place") -> DataFrame:
    """df with its place in the order, from 1."""
    return running(df, F.lit(1).cast("long"), *order, name=name)
