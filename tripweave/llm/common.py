"""Helpers shared by the operators: shared work folders, cut points, and linked components."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORDS = r"[ \t-\r]+"
"""What separates words: blank and the control characters 9 to 13."""


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint folder, removed when the driver's JVM ends.

    The cluster names the shared folder in spark.checkpoint.dir. Only a local session that names
    none gets a temporary one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="llm-")
        spark.sparkContext.setCheckpointDir(base)
    folder = f"{base}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return folder


def write_table(df: DataFrame, name: str) -> str:
    """Path of a new Parquet table with these rows in the shared work folder."""
    folder = f"{work_folder(df.sparkSession, name)}/table"
    df.write.option("compression", "zstd").parquet(folder)
    return folder


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of steps whose result has been written."""
    gc.collect()
    spark._jvm.System.gc()


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows as a written Parquet table: lineage ends there and lost executors reread it."""
    return df.sparkSession.read.schema(df.schema).parquet(write_table(df, name))


def bounded_batches(spark: SparkSession, rows: int = 1000, size: str = "2m") -> None:
    """Arrow batches between Spark and Python stay under a size, whatever the length of texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def lowered(text):
    """A-Z in lower case, everything else as it is."""
    return F.translate(text, UPPER, UPPER.lower())


def components(edges: DataFrame) -> DataFrame:
    """Node and the smallest node reachable from it, for links (a, b) of two different nodes.

    Large-star and small-star rounds until nothing changes. Each round writes its links and the
    smallest neighbours, so both sides of the joins are plain shuffles that adaptive execution can
    split where one node has very many links.
    """
    links = stored(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .where("a <> b")
        .distinct(),
        "links",
    )
    before = None
    while True:
        state = links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before:
            break
        before = state
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")), "least")
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(large.where("a <> b").distinct(), "large")
        least = stored(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").select("a", "b", "m")
        links = stored(
            small.select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e"))
            .select("e.a", F.col("e.m").alias("b"))
            .where("a <> b")
            .distinct(),
            "links",
        )
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
