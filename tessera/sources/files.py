"""Reading and writing the engine's files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schema

NODE = "struct<" + schema.NODES.replace("address long, ", "").replace(" ", ":").replace(",:", ",") + ">"


def load_graph_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a JSON graph: a map of nodes by decimal address, a list of pairs."""
    raw = spark.read.text(path, wholetext=True)
    nodes = raw.select(F.explode(F.from_json(F.get_json_object("value", "$.nodes"), f"map<string,{NODE}>")).alias("key", "node"))
    edges = raw.select(F.explode(F.from_json(F.get_json_object("value", "$.edges"), "array<array<long>>")).alias("e"))
    return (
        nodes.select(F.col("key").cast("long").alias("address"), "node.*"),
        edges.select(F.col("e")[0].alias("caller"), F.col("e")[1].alias("callee")),
    )


def load_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame], rebuild: bool = False) -> DataFrame:
    """The table at path; built and written where it is absent, unreadable or unwanted."""
    if not rebuild:
        try:
            return spark.read.parquet(path)
        except AnalysisException:
            pass
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def load_log(spark: SparkSession, path: str, ddl: str = schema.RESPONSES) -> DataFrame:
    """Records of a JSON-lines log; absent is empty, and broken lines are left out."""
    try:
        lines = spark.read.text(path)
    except AnalysisException:
        return spark.createDataFrame([], ddl)
    record = F.from_json("value", ddl + ", _broken string", {"columnNameOfCorruptRecord": "_broken"})
    return lines.select(record.alias("r")).where("r IS NOT NULL AND r._broken IS NULL").select("r.*").drop("_broken")


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_text(rows: DataFrame, column: str, path: str) -> None:
    rows.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def rename_cached(nodes: DataFrame, renames: DataFrame) -> DataFrame:
    """nodes with the names of renames (address, new_name) where there is one."""
    joined = nodes.join(renames.select("address", F.col("new_name").alias("__new")), "address", "left")
    return joined.withColumn("name", F.coalesce("__new", "name")).drop("__new").select(*nodes.columns)


def verified(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """Files under path whose SHA-256 is the one expected (name, sha256)."""
    files = spark.read.format("binaryFile").load(path)
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.sha2("content", 256).alias("sha256"))
    return named.join(expected, ["name", "sha256"], "left_semi")


def batch_targets(names: DataFrame, raw: tuple[str, ...] = ("exe", "dll", "sys", "bin", "elf"), database: str = "i64") -> DataFrame:
    """names (name): samples in order, then databases without a sample beside them."""
    parts = names.select("name", F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1)).alias("ext"), F.regexp_replace("name", r"\.[^.]+$", "").alias("stem"))
    samples = parts.where(F.col("ext").isin(*raw))
    beside = samples.select(F.explode(F.array("stem", "name")).alias("stem")).distinct()
    orphans = parts.where(F.col("ext") == database).join(beside, "stem", "left_anti")
    return samples.select(F.lit(0).alias("part"), "name").union(orphans.select(F.lit(1), "name")).orderBy("part", "name")


def list_builds(index: DataFrame, machine: int, branch: str | None = None) -> DataFrame:
    """index (entries: the map of a build index) -> builds by first release, undated last."""
    e = index.select(F.explode("entries").alias("sha256", "b")).where(
        (F.col("b.fileInfo.machineType") == machine) & F.col("b.fileInfo.virtualSize").isNotNull()
    )
    if branch:
        e = e.where(F.col("b.fileInfo.version").contains(f".{branch}."))
    releases = F.flatten(F.transform(F.map_values("b.windowsVersions"), lambda r: F.map_values(r)))
    dates = F.filter(F.transform(releases, lambda k: k["updateInfo"]["releaseDate"]), lambda d: F.coalesce(d, F.lit("")) != "")
    info = F.col("b.fileInfo")
    return e.select(
        "sha256",
        info["version"].alias("version"),
        info["timestamp"].alias("timestamp"),
        info["virtualSize"].alias("virtual_size"),
        info["size"].alias("size"),
        F.array_min(dates).alias("first_seen"),
    ).orderBy(F.asc_nulls_last("first_seen"), "sha256")


def exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def versions(spark: SparkSession, path: str) -> list[int]:
    """The complete versions of a table at path, oldest first."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(place):
        return []
    names = [f.getPath().getName() for f in files.listStatus(place)]
    return sorted(int(n[2:]) for n in names if n.startswith("v=") and exists(spark, f"{path}/{n}/_SUCCESS"))


def write_version(df: DataFrame, path: str) -> int:
    """Writes the next version of a table. Readers see it once it is complete, and a writer
    that dies leaves the versions before it as they were."""
    spark = df.sparkSession
    n = max(versions(spark, path), default=0) + 1
    df.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{path}/v={n}")
    return n


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The newest complete version, or the one asked for; null without any."""
    known = versions(spark, path)
    n = version if version is not None else (known[-1] if known else None)
    return None if n not in known else spark.read.parquet(f"{path}/v={n}")


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Both tables of a graph, the nodes last: a graph is there once its nodes are."""
    write_version(edges, f"{path}/edges")
    write_version(nodes, f"{path}/nodes")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame] | None:
    nodes, edges = read_version(spark, f"{path}/nodes"), read_version(spark, f"{path}/edges")
    return None if nodes is None or edges is None else (nodes, edges)


META = "key string, value string"


def get_meta(meta: DataFrame, key: str, default: str | None = None) -> str | None:
    found = meta.where(F.col("key") == key).select("value").first()
    return default if found is None else found["value"]


def set_meta(meta: DataFrame, changes: DataFrame) -> DataFrame:
    """meta (key, value) after changes (key, value), one a key."""
    return meta.join(changes, "key", "left_anti").select("key", "value").unionByName(changes.select("key", F.col("value").cast("string").alias("value")))


def seconds_per_call(meta: DataFrame) -> float | None:
    """The measured time of a call; null where none was, or where it makes no sense."""
    try:
        v = float(get_meta(meta, "seconds_per_call", ""))
    except ValueError:
        return None
    return v if v > 0 else None


def save_index(vectors: DataFrame, signature: DataFrame, path: str) -> None:
    """A vector index (address, embedding) and the signature (one row) of what it was made
    of, the signature last: an index without one counts as absent."""
    n = write_version(vectors, f"{path}/vectors")
    write_version(signature.select("signature", F.lit(n).alias("vectors")), f"{path}/signature")


def stored_signature(spark: SparkSession, path: str) -> str | None:
    found = read_version(spark, f"{path}/signature")
    return None if found is None else found.first()["signature"]


def load_index(spark: SparkSession, path: str) -> DataFrame | None:
    found = read_version(spark, f"{path}/signature")
    return None if found is None else read_version(spark, f"{path}/vectors", found.first()["vectors"])


def index_size(spark: SparkSession, path: str) -> int:
    found = load_index(spark, path)
    return 0 if found is None else found.count()


def read_build_index(spark: SparkSession, path: str) -> DataFrame:
    """Build indexes, one JSON text a file, compressed or not: (path, entries)."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return raw.select("path", F.from_json("value", schema.BUILD_INDEX).alias("entries"))


def newest_pair(builds: DataFrame, group: str | None = None) -> DataFrame:
    """The two newest dated builds (of each group): columns of builds, and side: new, old."""
    keys = [group] if group else []
    newest = F.row_number().over(W.partitionBy(*keys, F.lit(0)).orderBy(F.desc("first_seen"), F.desc("sha256")))
    two = builds.where("first_seen IS NOT NULL").withColumn("__n", newest).where("__n <= 2")
    return two.withColumn("side", F.when(F.col("__n") == 1, "new").otherwise("old")).drop("__n")


def by_version(builds: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (text: part of a version) -> (text, sha256, matches): the only build whose
    version contains it; null where none or several do. asked is a few typed texts."""
    hits = builds.join(F.broadcast(asked), builds["version"].contains(asked["text"]))
    one = hits.groupBy("text").agg(F.count("*").alias("matches"), F.min("sha256").alias("sha256"))
    full = asked.join(one, "text", "left").withColumn("matches", F.coalesce("matches", F.lit(0)))
    return full.select("text", F.when(F.col("matches") == 1, F.col("sha256")).alias("sha256"), "matches")
