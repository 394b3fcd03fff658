"""SimHash near-duplicates with pivot distance tables.

A text is lower-cased in A-Z only and cut at blanks and control characters 9 to 13. Its three-word
shingles, repeats included (fewer words: the whole sequence), vote with their XXH64 (seed 42) on 64
bits; a bit is set if more than half of them set it. No words, null and empty texts included: zero.
Fingerprints link at `bits` or fewer differing bits, and a component is what links reach. Rows with
equal fingerprints, repeated rows too, are one node. A row with a null identifier gets a fingerprint
and its component's smallest identifier (null if no row of it has one). An empty table gives an
empty result; other columns are neither read nor returned.

Links are found among distinct fingerprints. Two of them that differ in 3 bits agree on at least 3
of 6 blocks, so each is dealt to the 20 choices of 3 blocks, and pairs are sought inside a choice's
equal blocks. There a table holds the distances of each fingerprint to many reference fingerprints.
By the triangle inequality a pair whose distances to some reference differ by more than `bits` is
not linked: rows are sorted by the first distance, only the band of near ones is looked at, the
largest difference over all references discards most of it, and the bits of the survivors are
counted. A bucket gives links to the root of each local component, never all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripweave.llm.common import bounded_batches, components, stored

SEED = 42
SHINGLE = 3
PART = 1 << 15
REFERENCES = 16


def fingerprint(text: bytes | None) -> int:
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        words = [b" ".join(words)] + [b""] * (SHINGLE - 1)
        shingles = words[:1]
    else:
        shingles = list(map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)))))
    ones = np.zeros(64, np.int64)
    for start in range(0, len(shingles), PART):
        part = shingles[start : start + PART]
        hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in part), np.uint64, len(part))
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(shingles), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, a hash of the text that tells rows of one identifier apart, and the fingerprint f (signed)."""
    bounded_batches(docs.sparkSession)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(text.as_py()) for text in batch.column(2)]
            signed = np.array(values, np.uint64).view(np.int64)
            columns = [batch.column(0), batch.column(1), pa.array(signed)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "f"])

    chosen = docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        F.xxhash64(text_column).alias("text_hash"),
        F.col(text_column).cast("binary").alias("text"),
    )
    return chosen.mapInArrow(made, "doc_id long, text_hash long, f long")


def references(count: int = REFERENCES) -> np.ndarray:
    """Reference fingerprints, the same everywhere."""
    return np.array(
        [xxhash.xxh64_intdigest(str(i).encode(), SEED) for i in range(count)], np.uint64
    )


def block_masks(bits: int, extra: int = 3) -> list[int]:
    """Masks of all choices of `extra` out of bits + extra nearly equal blocks of the 64 bits."""
    blocks = bits + extra
    edges = [64 * i // blocks for i in range(blocks + 1)]
    ones = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    return [sum(choice) for choice in combinations(ones, extra)]


def bucket_links(f: np.ndarray, bits: int, pivots: np.ndarray) -> np.ndarray:
    """Local root (smallest position) of each fingerprint of a bucket by links inside the bucket."""
    table = np.bitwise_count(f[:, None] ^ pivots[None, :]).astype(np.int8)
    order = np.argsort(table[:, 0], kind="stable")
    f, table = f[order], table[order]
    ends = np.searchsorted(table[:, 0], table[:, 0] + bits, side="right")
    label = np.arange(len(f))
    for i, end in enumerate(ends):
        near = i + 1 + np.flatnonzero(
            (np.abs(table[i + 1 : end] - table[i]) <= bits).all(axis=1)
        )
        near = near[np.bitwise_count(f[near] ^ f[i]) <= bits]
        joined = np.unique(np.append(label[near], label[i]))
        if len(joined) > 1:
            label[np.isin(label, joined[1:])] = joined[0]
    root = np.empty(len(f), np.int64)
    root[order] = order[label]
    return root


def links(nodes: DataFrame, bits: int = 3) -> DataFrame:
    """Links (a, b) that connect what is linked among distinct (f, node)."""
    masks, pivots = block_masks(bits), references()
    bounded_batches(nodes.sparkSession, rows=50_000)

    def joined(f: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        root = bucket_links(f, bits, pivots)
        own = root != np.arange(len(f))
        return node[own], node[root[own]]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 4  # rows of the last, perhaps unfinished, bucket
        for batch in _with_end(batches):
            if batch is not None:
                new = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
                held = [np.concatenate(pair) for pair in zip(held, new)]
            choice, key, f, node = held
            starts = np.flatnonzero(np.r_[True, (choice[1:] != choice[:-1]) | (key[1:] != key[:-1])])
            if len(key) == 0:
                continue
            ends = np.r_[starts[1:], len(key)]
            if batch is not None:
                held = [x[starts[-1] :] for x in held]
                starts, ends = starts[:-1], ends[:-1]
            many = ends - starts > 1
            out = [
                joined(f[a:b].view(np.uint64), node[a:b])
                for a, b in zip(starts[many], ends[many])
            ]
            if out:
                a, b = (np.concatenate(x) for x in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    keys = F.array(
        *[
            F.struct(F.lit(i).alias("choice"), F.col("f").bitwiseAND(F.lit(_signed(m))).alias("key"))
            for i, m in enumerate(masks)
        ]
    )
    dealt = nodes.select("f", "node", F.explode(keys).alias("k")).select(
        F.col("k.choice").cast("long").alias("choice"), F.col("k.key").alias("key"), "f", "node"
    )
    sorted_keys = dealt.repartition("choice", "key").sortWithinPartitions("choice", "key")
    return sorted_keys.mapInArrow(found, "a long, b long")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _with_end(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def marked_components(docs: DataFrame, bits: int, id_column: str, text_column: str) -> DataFrame:
    """doc_id, text_hash, f and component_id of every row."""
    marked = stored(fingerprints(docs, id_column, text_column), "simhash")
    nodes = stored(marked.groupBy("f").agg(F.min("doc_id").alias("node")), "simhash-nodes")
    linked = components(links(nodes.where("node is not null"), bits))
    named = nodes.join(linked, "node", "left").select(
        "f", F.coalesce("root", "node").alias("component_id")
    )
    return marked.join(stored(named, "simhash-components"), "f")


def near_duplicates(
    docs: DataFrame, bits: int = 3, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row."""
    return marked_components(docs, bits, id_column, text_column).select(
        "doc_id",
        F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def dedup_stage(
    docs: DataFrame, bits: int = 3, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """The document with the smallest identifier of each component, with all columns.

    Rows are known by identifier and text, so of rows that repeat an identifier with another text only
    those of the component that it leads stay. Components without any identifier stay whole.
    """
    found = marked_components(docs, bits, id_column, text_column)
    stays = F.col("doc_id").eqNullSafe(F.col("component_id"))
    dropped = found.where(~stays).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))
    dropped = stored(dropped.distinct(), "near-dropped")
    same = F.col(id_column).cast("long").eqNullSafe(F.col("__id"))
    return docs.join(dropped, same & (F.xxhash64(text_column) == F.col("__hash")), "left_anti")
