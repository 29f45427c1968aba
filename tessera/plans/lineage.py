"""Cutting lineage through the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder set in spark.checkpoint.dir. Only where none is set and all runs on this
    machine, one of our own: executors of a cluster would not see each other's files there."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if folder is None and (java := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        folder = java.get()
    if folder is None:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def own_folder(spark: SparkSession) -> str:
    """This application's folder in the shared one; it is deleted when the driver ends."""
    sc = spark.sparkContext
    path = f"{shared_folder(spark)}/tessera-{sc.applicationId}"
    if getattr(sc, "_tessera_folder", None) != path:
        place = sc._jvm.org.apache.hadoop.fs.Path(path)
        files = place.getFileSystem(sc._jsc.hadoopConfiguration())
        files.mkdirs(place)
        files.deleteOnExit(place)
        sc._tessera_folder = path
    return path


def settle(df: DataFrame, what: str = "rows") -> DataFrame:
    """df, written to the shared folder and read back: later steps start from files that
    survive lost executors, read the columns they need, and plans of loops stay short."""
    spark = df.sparkSession
    path = f"{own_folder(spark)}/{uuid.uuid4().hex}/{what}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, what: str = "rows", of: Column | None = None) -> tuple[DataFrame, int]:
    """settle(df), and the number of its rows (for which ``of`` holds), counted as they are
    written: loops need no further job to know whether they end."""
    seen = Observation()
    n = F.count(F.lit(1)) if of is None else F.count_if(of)
    return settle(df.observe(seen, n.alias("n")), what), seen.get["n"]
