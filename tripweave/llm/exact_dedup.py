"""Exact deduplication as stateful streaming over keyed, disk-backed state.

Texts are equal when they are identical after lower-casing A-Z only; a null text counts as empty.
Of equal texts the row with the largest identifier stays (rows that repeat it stay together; a null
identifier is smaller than any other). The state of a digest is its number of rows, the largest
identifier and the locator (source file and length) of that row. It lives in RocksDB, is saved in
the shared checkpoint folder and never expires: there is no watermark. A later batch of rows meets
the state that all earlier batches left. Digests met more than once are hits: the full texts of
their rows are compared with the text that stays, and rows with other bytes form groups by text.

An empty table gives an empty result. Other columns of the input are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripweave.llm.common import lowered, stored, work_folder, write_table

STATE = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "8",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",  # no store stays in memory after its batch
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # many small stores
}


def normalised(text_column: str = "text") -> Column:
    return lowered(F.coalesce(F.col(text_column), F.lit("")))


def keyed(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    digest: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Identifier, digest of the normalised text and content locator; for batches or streams."""
    sha = F.sha2(normalised(text_column), 256)
    return docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        sha.alias("text_sha256"),
        (digest(sha) if digest else sha).alias("digest"),
        F.struct(
            F.input_file_name().alias("file"), F.octet_length(text_column).alias("octets")
        ).alias("locator"),
    )


def fold(keys: DataFrame) -> DataFrame:
    """State by digest; combined before the shuffle, so a digest of very many rows is no hot key."""
    return keys.groupBy("digest").agg(
        F.count("*").alias("n"), F.max(F.struct("doc_id", "locator")).alias("last")
    )


def stream_fold(spark, path: str, schema, bytes_per_batch: int) -> DataFrame:
    """Fold a written table of keys as a stream that ends with its last file.

    Each batch writes the digests that it changed to a folder of its own, overwritten when the batch
    is repeated after a failure. The row of a digest with the largest count is its latest state.
    """
    folder = work_folder(spark, "exact-dedup-state")
    before = {name: spark.conf.get(name, None) for name in STATE}
    for name, value in STATE.items():
        spark.conf.set(name, value)
    try:
        keys = spark.readStream.schema(schema).option("maxBytesPerTrigger", bytes_per_batch)
        states = fold(keys.parquet(path))
        states.writeStream.outputMode("update").foreachBatch(
            lambda rows, k: rows.write.mode("overwrite").parquet(f"{folder}/state/batch={k}")
        ).option("checkpointLocation", f"{folder}/progress").trigger(
            availableNow=True
        ).start().awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    empty = spark.createDataFrame([], states.schema)
    try:
        changed = spark.read.schema(states.schema).parquet(f"{folder}/state/*")
    except Exception as error:  # a stream without a file runs no batch
        if "PATH_NOT_FOUND" not in str(error):
            raise
        changed = empty
    latest = changed.groupBy("digest").agg(F.max(F.struct("n", "last")).alias("s"))
    return latest.select("digest", "s.n", F.col("s.last.doc_id").alias("keep_id"), "s.last.locator")


def with_texts(
    docs: DataFrame,
    rows: DataFrame,
    id_column: str,
    text_column: str,
    digest: Callable[[Column], Column] | None,
) -> DataFrame:
    """The rows (doc_id, digest) with the normalised texts of their documents."""
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("t"))
    found = rows.join(texts, rows.doc_id.eqNullSafe(texts.doc_id)).select(
        rows.doc_id, "digest", normalised("t").alias("normal")
    )
    sha = F.sha2("normal", 256)  # an identifier may be repeated with another text
    return found.where(F.col("digest") == (digest(sha) if digest else sha))


def exact_duplicates(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    bytes_per_batch: int = 64 << 30,
    digest: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    digest: shortens the SHA-256 digest, to try how rows with equal digests and other bytes are kept
    apart. Only hits' texts are compared; all other rows pass by identifier and digest.
    """
    spark = docs.sparkSession
    keys = keyed(docs, id_column, text_column, digest)
    path = write_table(keys, "exact-dedup-keys")
    keys = spark.read.schema(keys.schema).parquet(path)
    state = stored(stream_fold(spark, path, keys.schema, bytes_per_batch), "exact-dedup-latest")

    rows = keys.join(state.select("digest", "n", "keep_id"), "digest")
    hits = rows.where("n > 1").select("doc_id", "digest").distinct()
    texts = stored(with_texts(docs, hits, id_column, text_column, digest), "hits")
    stays = state.where("n > 1").select("digest", "keep_id")
    first = texts.join(stays, (texts.digest == stays.digest) & texts.doc_id.eqNullSafe(stays.keep_id))
    first = stored(
        first.groupBy(texts.digest).agg(F.min("normal").alias("keep_normal")), "hits-kept"
    )
    mixed = (
        texts.join(first, "digest").where("normal <> keep_normal").select("digest").distinct()
    )
    mixed = stored(mixed, "hits-mixed")
    out = rows.select(
        "doc_id",
        "keep_id",
        F.col("n").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
        "digest",
    )
    if mixed.isEmpty():
        return out.drop("digest")
    apart = texts.join(mixed, "digest")
    groups = apart.groupBy("digest", "normal").agg(
        F.count("*").alias("group_size"), F.max("doc_id").alias("keep_id")
    )
    apart = apart.join(stored(groups, "hits-apart"), ["digest", "normal"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.sha2("normal", 256).alias("text_sha256"),
    )
    return out.join(mixed, "digest", "left_anti").drop("digest").unionByName(apart)


def dedup_stage(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows that stay, with all their columns; a row is known by its identifier and its text."""
    found = exact_duplicates(docs, id_column, text_column).where("not kept")
    found = found.select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha")).distinct()
    found = stored(found, "exact-dropped")
    same = F.col(id_column).cast("long").eqNullSafe(F.col("__id"))
    found = found.hint("merge")  # it grows with the input, so never a broadcast
    return docs.join(found, same & (F.sha2(normalised(text_column), 256) == F.col("__sha")), "left_anti")
