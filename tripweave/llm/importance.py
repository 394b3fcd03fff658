"""Importance resampling towards a target distribution of hashed word n-grams, by batch concatenation.

A batch's texts, lower-cased in A-Z, are joined with a separator that no word holds; one pass of a
regular expression finds all words; a word's document is found by searching its place among the
documents' ends. Runs of two and three words count where their first and last word have the same
document, so no run crosses documents. A run's bucket is the CRC-32 of its bytes modulo the number of
buckets; CRC-32 of joined parts is put together from those of the words, since appending n bytes is a
linear map. Buckets are counted with bincount, one histogram a task, and the histograms are summed by
Spark. Gains (one whole number a bucket) are the only thing broadcast; their number is a parameter.

A second pass adds up the gains of each document's features. A number drawn from the document's
identifier gives each score its Gumbel noise, and the highest scores are drawn. Ranks come from a
range partitioning by score and identifier whose parts are numbered on their own and offset by the
sizes of the parts before, so no task holds all scores.

Null and empty texts have no features and weight zero; texts of any length are read whole. Rows that
repeat an identifier are documents of their own with the same noise; a null identifier counts as the
empty string. Ties of score go to the smaller identifier (null last), then to the smaller number of
features and the smaller weight. Empty tables give an empty result; an empty target is a histogram of
zeros. Other columns are neither read nor returned.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripweave.llm.common import bounded_batches, stored

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SEPARATOR = b"\n"
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
BUCKETS = 10_000
ORDER = 3
POLYNOMIAL = 0xEDB88320
"""CRC-32, bit-reversed."""
TABLED = 64
"""Numbers of bytes up to which the linear map of appending them is tabled."""


def times(factor: int, values: np.ndarray) -> np.ndarray:
    """Product of a polynomial and each value, modulo the CRC polynomial (bit-reversed order)."""
    out = np.zeros_like(values)
    power = values.copy()
    for bit in range(31, -1, -1):
        if factor >> bit & 1:
            out ^= power
        power = (power >> np.uint32(1)) ^ np.where(power & np.uint32(1), np.uint32(POLYNOMIAL), np.uint32(0))
    return out


def appending(n_bytes: int) -> int:
    """The polynomial x to the power of the number of bits."""
    out, square, left = np.uint32([1 << 31]), np.uint32([1 << 30]), 8 * n_bytes
    while left:
        if left & 1:
            out = times(int(square[0]), out)
        square = times(int(square[0]), square)
        left >>= 1
    return int(out[0])


@lru_cache(maxsize=1)
def shift_tables() -> np.ndarray:
    """[n, k, b]: what byte b at place k of a CRC becomes when n bytes are appended."""
    byte = np.arange(256, dtype=np.uint32)
    places = np.concatenate([byte << np.uint32(8 * k) for k in range(4)])
    return np.stack([times(appending(n), places).reshape(4, 256) for n in range(TABLED + 1)])


def shifted(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """CRCs after so many zero bytes are appended (without the CRC's own conditioning)."""
    table = shift_tables().reshape(-1)
    row = np.minimum(n_bytes, TABLED) * 1024
    out = table[row + (crc & 255)]
    for k in range(1, 4):
        out ^= table[row + 256 * k + (crc >> np.uint32(8 * k) & 255)]
    long = np.flatnonzero(n_bytes > TABLED)
    for n in np.unique(n_bytes[long]):
        at = long[n_bytes[long] == n]
        out[at] = times(appending(int(n)), crc[at])
    return out


def batch_features(texts: list[bytes | None], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and document of every feature of a batch, and words of each document."""
    sizes = [len(t) if t else 0 for t in texts]
    data = SEPARATOR.join(t or b"" for t in texts).translate(LOWER)
    ends = np.cumsum(np.array(sizes, np.int64) + len(SEPARATOR))
    starts, words = [], []
    for found in WORD.finditer(data):
        starts.append(found.start())
        words.append(found.group())
    n = len(words)
    doc = np.searchsorted(ends, np.array(starts, np.int64), "right")
    length = np.fromiter(map(len, words), np.int64, count=n)
    crc = np.fromiter(map(zlib.crc32, words), np.uint32, count=n)
    spaced = shifted(np.full(n, zlib.crc32(b" "), np.uint32), length) ^ crc
    found, owners, run = [crc], [doc], crc
    for k in range(1, ORDER):
        run = shifted(run[: max(n - k, 0)], length[k:] + 1) ^ spaced[k:]
        inside = doc[: max(n - k, 0)] == doc[k:]
        found.append(run[inside])
        owners.append(doc[k:][inside])
    bucket = (np.concatenate(found) % np.uint32(buckets)).astype(np.int64)
    return bucket, np.concatenate(owners), np.bincount(doc, minlength=len(texts))


def histogram(docs: DataFrame, text_column: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """bucket and n: how often features of all texts fall into each bucket that has some."""
    bounded_batches(docs.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            bucket, _, _ = batch_features(batch.column(0).to_pylist(), buckets)
            total += np.bincount(bucket, minlength=buckets)
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[own])], ["bucket", "n"])

    found = docs.select(F.col(text_column).cast("binary").alias("text")).mapInArrow(counted, "bucket long, n long")
    return found.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Gain of each bucket: thousandths of the logarithm of its smoothed target to source ratio."""

    def dense(counts: DataFrame) -> np.ndarray:
        rows = counts.toPandas()  # at most one row a bucket
        out = np.zeros(buckets)
        out[rows["bucket"].to_numpy(np.int64)] = rows["n"].to_numpy(np.float64)
        return out

    s, t = dense(source), dense(target)
    ratio = ((t + 1) * (s.sum() + buckets)) / ((s + 1) * (t.sum() + buckets))
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def weigh(
    docs: DataFrame, gains: np.ndarray, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """doc_id, n_words, n_features and weight: the sum of the gains of the document's features."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(gains)

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            bucket, doc, n_words = batch_features(batch.column(1).to_pylist(), len(gain))
            n = len(n_words)
            weight = np.bincount(doc, weights=gain[bucket], minlength=n)  # whole numbers: exact
            columns = [n_words, np.bincount(doc, minlength=n), np.rint(weight)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c.astype(np.int64)) for c in columns)],
                ["doc_id", "n_words", "n_features", "weight"],
            )

    chosen = docs.select(
        F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("binary").alias("text")
    )
    return chosen.mapInArrow(weighed, "doc_id long, n_words long, n_features long, weight long")


def with_scores(weighed: DataFrame, seed: int = 42) -> DataFrame:
    """Adds score: the weight and Gumbel noise, fixed by seed and identifier, in thousandths."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    return weighed.withColumn("score", (F.col("weight") + noise).cast("long"))


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """Adds rank, 1, 2, 3, ... by score from the highest, without bringing all rows into one task."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight")]
    parts = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    dealt = rows.repartitionByRange(int(parts), *order)
    placed = stored(dealt.withColumn("part", F.spark_partition_id()), name)  # parts stay as dealt
    sizes = placed.groupBy("part").agg(F.count("*").alias("size"))  # one row a part
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    own = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    numbers = placed.withColumn("own", own).join(F.broadcast(offsets), "part")
    return numbers.withColumn("rank", (F.col("own") + F.col("offset")).cast("long")).drop("part", "own", "offset")


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 5,
    least_words: int = 20,
    buckets: int = BUCKETS,
    seed: int = 42,
    id_column: str = "doc_id",
    text_column: str = "text",
    target_text_column: str = "text",
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every document; undrawn: rank is null.

    Of the documents of at least `least_words` words the given percentage, rounded down, is drawn.
    """
    gains = bucket_gains(
        histogram(docs, text_column, buckets), histogram(target, target_text_column, buckets), buckets
    )
    scored = stored(with_scores(weigh(docs, gains, id_column, text_column), seed), "resample-scores")
    fit = F.col("n_words") >= least_words
    drawn = scored.where(fit).count() * percent // 100
    ranked = numbered(scored.where(fit), "resample-ranked")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.where(~fit).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest)
