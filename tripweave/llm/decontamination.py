"""Benchmark decontamination: size-partitioned MinHash containment search with exact verification.

Texts are lower-cased in A-Z and cut at blanks and control characters 9 to 13. A text is the set of
its five-word shingles; one of fewer words is one shingle, its whole sequence; none: no shingles. A
document holds an item if at least `threshold` of the item's shingles are among its own.

Items are put into classes by number of shingles (up to 1, 2, 4, 8, ...). From the upper size of its
class follow the length of an item's signature, its shingles with the smallest keys, and how many of
them a document must hold to be a candidate: an item of a class up to u shingles may lack m of them,
m the most that u may lack, so a signature of m + `spare` shingles meets every document that holds the
item in at least `spare` of them. Items with fewer shingles than that are indexed by all of them. So
the search loses no pair, whatever the item's size; its share of signature shingles met is the MinHash
estimate of the containment. A shingle's key is the number of items that hold it, then its hash: runs
that many items share are put last and do not make all their items candidates of all their documents.

A document's shingles are first looked up in a bit filter of all items' shingles, the only thing
broadcast (at most `most_bits` bits, whatever the number of items; a full filter only lets more
shingles through). What passes is joined with the signatures as text; candidates are then joined with
all shingles of their item and what passed of their document, and counted exactly.

Null and empty texts have no shingles. Rows that repeat an identifier count as one document or item of
all their shingles; null is an identifier of documents too, but each text of an item without
identifier is an item of its own. Very common passages are hot join keys that adaptive execution
splits. Empty tables give an empty result; other columns are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripweave.llm.common import bounded_batches, stored
from tripweave.llm.word_table import WordTable, run_hashes, word_hashes, word_table

SHINGLE = 5


def shingle_places(words: WordTable) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first word, number of words and text number of every shingle, repeats included."""
    h = word_hashes(words)
    counts = np.diff(words.first)
    text = words.texts()
    hashes = run_hashes(h, SHINGLE)
    inside = text[: len(hashes)] == text[SHINGLE - 1 :] if len(hashes) else np.empty(0, bool)
    at = np.flatnonzero(inside)
    parts = [(hashes[at], at, np.full(len(at), SHINGLE), text[at])]
    for size in range(1, SHINGLE):
        short = np.flatnonzero(counts == size)
        begin = words.first[short]
        own = run_hashes(h, size)[begin] if len(short) else np.empty(0, np.uint64)
        parts.append((own + np.uint64(size), begin, np.full(len(short), size), short))
    hashes, at, size, text = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(at, kind="stable")
    return hashes[order], at[order], size[order], text[order]


def item_shingles(items: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """key of the item, item_id, shingle and its hash h, one row for each shingle of an item."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = word_table(batch.column(2), lower=True)
            hashes, at, size, text = shingle_places(words)
            order = np.lexsort((hashes, text))
            new = np.r_[True, np.diff(text[order]) != 0] if len(order) else np.empty(0, bool)
            new[1:] |= hashes[order][1:] != hashes[order][:-1]
            own = order[new]
            owner = pa.array(text[own])
            shingles = [words.joined(at[i], at[i] + size[i]) for i in own]
            columns = [batch.column(0).take(owner), batch.column(1).take(owner), pa.array(shingles, pa.binary())]
            columns.append(pa.array(hashes[own].view(np.int64)))
            names = ["key", "item_id", "shingle", "h"]
            yield pa.RecordBatch.from_arrays(columns, names)

    item, text = F.col(id_column).cast("long"), F.col(text_column).cast("binary")
    key = F.coalesce(item.cast("string"), F.concat(F.lit("text "), F.sha2(text, 256)))
    chosen = items.select(key.alias("key"), item.alias("item_id"), text.alias("text"))
    shingles = chosen.mapInArrow(made, "key string, item_id long, shingle binary, h long")
    return shingles.dropDuplicates(["key", "shingle"])


def bit_filter(hashes: DataFrame, most_bits: int) -> np.ndarray:
    """Bits of two probes of each h, about 64 bits a hash up to a bound, built by grouping words."""
    n = hashes.agg(F.approx_count_distinct("h")).first()[0]
    bits = min(most_bits, 1 << max(16, int(64 * n).bit_length()))
    probes = F.explode(F.array(F.col("h"), F.shiftright("h", 32)))
    words = (
        hashes.select(probes.alias("q"))
        .select(F.col("q").bitwiseAND(F.lit(bits - 1)).alias("p"))
        .select(
            F.shiftright("p", 5).alias("word"),
            F.expr("shiftleft(1L, cast(p & 31 as int))").alias("b"),
        )
        .groupBy("word")
        .agg(F.bit_or("b").alias("b"))
    )
    out = np.zeros(bits >> 5, np.uint32)
    found = words.toPandas()  # at most one row for each 32 of the bits
    out[found["word"].to_numpy()] = found["b"].to_numpy().astype(np.uint32)
    return out


def passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    size = np.uint64((len(bits) << 5) - 1)

    def probe(p: np.ndarray) -> np.ndarray:
        return bits[(p >> np.uint64(5)).astype(np.int64)] >> (p & np.uint64(31)).astype(np.uint32) & 1

    near = np.flatnonzero(probe(hashes & size))
    signed = (hashes[near].view(np.int64) >> 32).view(np.uint64)
    return near[probe(signed & size).astype(bool)]


def document_hits(docs: DataFrame, bits) -> DataFrame:
    """doc_id and shingle, one row for each place of a shingle that passes the filter."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = word_table(batch.column(1), lower=True)
            hashes, at, size, text = shingle_places(words)
            near = passes(bits.value, hashes)
            shingles = [words.joined(at[i], at[i] + size[i]) for i in near]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(text[near])), pa.array(shingles, pa.binary())],
                ["doc_id", "shingle"],
            )

    return docs.mapInArrow(made, "doc_id long, shingle binary")


def signatures(wanted: DataFrame, threshold: float, spare: int) -> DataFrame:
    """key, shingle and needed: the signature of each item, and how much of it makes a candidate."""
    items = wanted.groupBy("shingle").agg(F.count("*").alias("items"))
    sizes = wanted.groupBy("key").agg(F.count("*").alias("n"))
    upper = F.pow(F.lit(2.0), F.ceil(F.log2("n")))  # of the item's class
    lacking = (upper - F.ceil(upper * threshold - 1e-9)).cast("long")
    place = F.row_number().over(Window.partitionBy("key").orderBy("items", "h", "shingle"))
    placed = (
        wanted.join(items, "shingle")
        .join(sizes.withColumn("lacking", lacking), "key")
        .withColumn("place", place)  # one item in one task
        .where(F.col("place") <= F.col("lacking") + spare)
    )
    length = F.least("n", F.col("lacking") + spare)
    needed = F.greatest(F.lit(1), length - F.col("lacking"))
    return placed.select("key", "shingle", needed.alias("needed"))


def candidates(hits: DataFrame, index: DataFrame) -> DataFrame:
    """doc_id and key of the pairs that meet enough of the item's signature."""
    met = hits.join(index, "shingle").groupBy("doc_id", "key")
    return met.agg(F.count("*").alias("met"), F.max("needed").alias("needed")).where("met >= needed")


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    threshold: float = 0.8,
    spare: int = 3,
    most_bits: int = 1 << 26,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_id_column: str = "item_id",
    item_text_column: str = "text",
) -> DataFrame:
    """doc_id, item_id, item_shingles, shared_shingles, containment of every pair of `threshold` or more."""
    spark = docs.sparkSession
    bounded_batches(spark)
    wanted = stored(item_shingles(items, item_id_column, item_text_column), "benchmark-shingles")
    bits = spark.sparkContext.broadcast(bit_filter(wanted.select("h"), most_bits))
    chosen = docs.select(
        F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("binary").alias("text")
    )
    hits = stored(document_hits(chosen, bits).distinct(), "benchmark-hits")
    index = stored(signatures(wanted, threshold, spare), "benchmark-signatures")
    found = candidates(hits, index)
    sizes = wanted.groupBy("key", "item_id").agg(F.count("*").alias("item_shingles"))
    sought = found.select("doc_id", "key").join(wanted.select("key", "shingle"), "key")
    same = sought["doc_id"].eqNullSafe(hits["doc_id"]) & (sought["shingle"] == hits["shingle"])
    shared = (
        sought.join(hits, same, "left_semi")
        .groupBy("doc_id", "key")
        .agg(F.count("*").alias("shared_shingles"))
        .join(sizes, "key")
    )
    return shared.where(F.col("shared_shingles") >= threshold * F.col("item_shingles")).select(
        "doc_id",
        "item_id",
        "item_shingles",
        "shared_shingles",
        (F.col("shared_shingles") / F.col("item_shingles")).alias("containment"),
    )


def decontamination_stage(
    docs: DataFrame, items: DataFrame, threshold: float = 0.8, id_column: str = "doc_id"
) -> DataFrame:
    """The documents that hold no item, with all their columns."""
    found = contained_items(docs, items, threshold, id_column=id_column)
    found = stored(found.select(F.col("doc_id").alias("__held_id")).distinct(), "contaminated")
    return docs.join(found, F.col(id_column).eqNullSafe(F.col("__held_id")), "left_anti")
