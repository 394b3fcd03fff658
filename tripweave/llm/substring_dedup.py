"""Removal of repeated passages with sharded Aho-Corasick automata over words.

Words lie between blanks and control characters 9 to 13 and stay as they are. A phrase is the words
of a window of `window` consecutive words of one document. A word goes if it is covered by a window
whose phrase also starts in a document with a smaller identifier; windows are judged on the input.

1. Anchors: of the four-word runs inside a window, the one with the smallest hash. Equal windows
   have equal anchors, so a phrase can recur only if its anchor occurs in two documents. About one
   word in five begins an anchor; they are counted with partial sums.
2. Windows with such anchors leave their document as runs, dealt by anchor: all occurrences of a
   phrase meet. Anchors of very many documents are dealt further by document; their phrases are
   confirmed by grouping equal runs and then their windows first and go to every part.
3. Each part confirms the phrases that occur in two documents, compiles them into automata of a
   bounded number of phrases, and streams its runs through them. A match with a phrase that was
   first in a smaller document covers its words.

Hashes only choose anchors; phrases are compared word by word. Null and empty texts have no words. A
null identifier is neither smaller nor larger than any: its document stays whole. Rows that repeat an
identifier must repeat its text and are treated alike. An empty table gives an empty result; other
columns are neither read nor returned. Texts are read whole, whatever their length.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripweave.llm.common import bounded_batches, free_shuffles, stored
from tripweave.llm.word_table import WordTable, run_hashes, word_hashes, word_table

ANCHOR = 4
PHRASES_PER_AUTOMATON = 20_000
DOCUMENTS_PER_PART = 2_000


def window_anchors(words: WordTable, window: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and anchor hash of every window that lies in one text."""
    runs = run_hashes(word_hashes(words), ANCHOR)
    width = window - ANCHOR + 1
    if len(runs) < width:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    least, have = runs, 1
    while have < width:
        step = min(have, width - have)
        least, have = np.minimum(least[:-step], least[step:]), have + step
    text = words.texts()
    at = np.flatnonzero(text[: len(least)] == text[window - 1 :])
    return at, least[at].view(np.int64)


def changes(*keys: np.ndarray) -> np.ndarray:
    """Positions at which any of the keys differs from the one before."""
    if len(keys[0]) == 0:
        return np.empty(0, np.int64)
    differs = np.zeros(len(keys[0]), bool)
    differs[0] = True
    for key in keys:
        differs[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(differs)


def document_anchors(docs: DataFrame, window: int) -> DataFrame:
    """doc_id and anchor of each stretch of windows that share it."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = word_table(batch.column(1), lower=False)
            at, anchor = window_anchors(words, window)
            text = words.texts()[at]
            first = changes(text, anchor)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(text[first])), pa.array(anchor[first])],
                ["doc_id", "anchor"],
            )

    return docs.mapInArrow(made, "doc_id long, anchor long")


def candidate_runs(docs: DataFrame, window: int) -> DataFrame:
    """Runs of windows with recurring anchors, from (doc_id, text, anchors, counts).

    anchor, documents (that hold it), doc_id, first word, words of the run.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = word_table(batch.column(1), lower=False)
            at, anchor = window_anchors(words, window)
            text = words.texts()[at]
            first = changes(text, anchor)
            last = np.r_[first[1:], len(at)] - 1
            known = [dict(zip(*pair)) for pair in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            found = [known[t].get(a, 0) for t, a in zip(text[first].tolist(), anchor[first].tolist())]
            own = np.flatnonzero(found)
            begin, end = at[first[own]], at[last[own]] + window
            in_text = text[first[own]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(anchor[first[own]]),
                    pa.array(np.array(found, np.int64)[own]),
                    batch.column(0).take(pa.array(in_text)),
                    pa.array(begin - words.first[in_text]),
                    pa.array([words.joined(a, b) for a, b in zip(begin, end)], pa.binary()),
                ],
                ["anchor", "documents", "doc_id", "start", "words"],
            )

    return docs.mapInArrow(made, "anchor long, documents long, doc_id long, start long, words binary")


def run_windows(runs: DataFrame, window: int) -> DataFrame:
    """anchor, documents, smallest and largest doc_id and words of every window of distinct runs."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, out = [], []
            for k, run in enumerate(batch.column(4).to_pylist()):
                words = run.split(b" ")
                for i in range(len(words) - window + 1):
                    row.append(k)
                    out.append(b" ".join(words[i : i + window]))
            taken = [batch.column(k).take(pa.array(row, pa.int64())) for k in range(4)]
            yield pa.RecordBatch.from_arrays(
                [*taken, pa.array(out, pa.binary())], ["anchor", "documents", "lo", "hi", "words"]
            )

    return runs.mapInArrow(made, "anchor long, documents long, lo long, hi long, words binary")


class Shard:
    """Phrases and runs of some anchors: confirmed, compiled and streamed together."""

    def __init__(self, window: int):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.seen: dict[tuple[int, ...], list[int]] = {}
        self.runs: list[tuple[int, int, tuple[int, ...]]] = []

    def add(self, given: bool, counted: bool, doc: int, start: int, words: bytes) -> None:
        ids = tuple([self.ids.setdefault(w, len(self.ids)) for w in words.split(b" ")])
        if given:  # a confirmed phrase with its first document
            self.seen[ids] = [doc, doc + 1]
            return
        self.runs.append((doc, start, ids))
        if not counted:
            return
        for i in range(len(ids) - self.window + 1):
            phrase = ids[i : i + self.window]
            ends = self.seen.get(phrase)
            if ends is None:
                self.seen[phrase] = [doc, doc]
            elif doc < ends[0]:
                ends[0] = doc
            elif doc > ends[1]:
                ends[1] = doc

    def covered(self) -> Iterator[tuple[int, int, int]]:
        """Document, first and last word (exclusive) of what earlier documents also hold."""
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        recurring = 0
        for phrase, (first, last) in self.seen.items():
            if first < last:
                automaton.add_word(phrase, recurring)
                self.seen[phrase] = first
                recurring += 1
        if not recurring:
            return
        firsts = [first for first in self.seen.values() if isinstance(first, int)]
        automaton.make_automaton()
        for doc, start, ids in self.runs:
            begin = end = -1
            for at, phrase in automaton.iter(ids):
                if firsts[phrase] < doc:
                    stop = at + 1
                    if begin >= 0 and stop - self.window <= end:
                        end = stop
                        continue
                    if begin >= 0:
                        yield doc, start + begin, start + end
                    begin, end = stop - self.window, stop
            if begin >= 0:
                yield doc, start + begin, start + end


def covered_spans(dealt: DataFrame, window: int) -> DataFrame:
    """doc_id, begin, end of covered words; rows of one (anchor, part) are consecutive."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, before = Shard(window), None
        for batch in batches:
            out: list[tuple[int, int, int]] = []
            for anchor, part, given, counted, doc, start, words in zip(
                *(column.to_pylist() for column in batch.columns)
            ):
                if (anchor, part) != before and len(shard.seen) > PHRASES_PER_AUTOMATON:
                    out.extend(shard.covered())
                    shard = Shard(window)
                before = anchor, part
                shard.add(given, counted, doc, start, words)
            yield spans(out)
        yield spans(list(shard.covered()))

    def spans(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
        columns = zip(*rows) if rows else ([], [], [])
        return pa.RecordBatch.from_arrays(
            [pa.array(x, pa.int64()) for x in columns], ["doc_id", "begin", "end"]
        )

    return dealt.mapInArrow(found, "doc_id long, begin long, end long")


def without_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text from (doc_id, text, begins, ends)."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, removed, kept = [], [], []
            for text, begins, ends in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                own = (text or b"").split()
                words.append(len(own))
                if begins:
                    edge = np.zeros(len(own) + 1, np.int64)
                    np.add.at(edge, begins, 1)
                    np.add.at(edge, ends, -1)
                    own = [own[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
                removed.append(words[-1] - len(own))
                kept.append(b" ".join(own))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(words), pa.array(removed), pa.array(kept, pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_text"],
            )

    return docs.mapInArrow(made, "doc_id long, n_words long, n_removed long, kept_text string")


def remove_repeated(
    docs: DataFrame, window: int = 13, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text of every document."""
    if window < ANCHOR:
        raise ValueError(f"a window has at least {ANCHOR} words")
    spark = docs.sparkSession
    bounded_batches(spark)
    chosen = docs.select(
        F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("binary").alias("text")
    )
    anchors = document_anchors(chosen.where("doc_id is not null"), window)
    counted = anchors.groupBy("anchor").agg(
        F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("documents")
    )
    recurring = stored(counted.where("lo < hi").select("anchor", "documents"), "repeated-anchors")
    free_shuffles(spark)
    marked = anchors.join(recurring, "anchor").groupBy("doc_id").agg(
        F.collect_set(F.struct("anchor", "documents")).alias("m")
    )
    marked = stored(
        marked.select("doc_id", F.col("m.anchor").alias("anchors"), F.col("m.documents").alias("counts")),
        "repeated-marks",
    )
    free_shuffles(spark)
    runs = stored(candidate_runs(chosen.join(marked, "doc_id"), window), "repeated-runs")
    free_shuffles(spark)

    parts = F.ceil(F.col("documents") / DOCUMENTS_PER_PART).cast("int")
    crowded = F.col("documents") > DOCUMENTS_PER_PART
    distinct = (
        runs.where(crowded)
        .groupBy("anchor", "documents", "words")
        .agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
        .select("anchor", "documents", "lo", "hi", "words")
    )
    phrases = (
        run_windows(distinct, window)
        .groupBy("words")
        .agg(
            F.min("anchor").alias("anchor"),
            F.max("documents").alias("documents"),
            F.min("lo").alias("doc_id"),
            F.max("hi").alias("hi"),
        )
        .where("doc_id < hi")
        .select(
            "anchor",
            F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"),
            F.lit(True).alias("given"),
            F.lit(False).alias("counted"),
            "doc_id",
            F.lit(0).cast("long").alias("start"),
            "words",
        )
    )
    rows = runs.select(
        "anchor",
        F.when(crowded, F.pmod(F.xxhash64("doc_id"), parts).cast("int")).otherwise(0).alias("part"),
        F.lit(False).alias("given"),
        (~crowded).alias("counted"),
        "doc_id",
        "start",
        "words",
    )
    dealt = rows.unionByName(phrases).repartition("anchor", "part")
    spans = covered_spans(dealt.sortWithinPartitions("anchor", "part"), window)
    by_doc = stored(
        spans.groupBy("doc_id").agg(F.collect_list(F.struct("begin", "end")).alias("s")),
        "repeated-spans",
    )
    free_shuffles(spark)
    joined = chosen.join(by_doc, "doc_id", "left").select(
        "doc_id", "text", F.col("s.begin").alias("begins"), F.col("s.end").alias("ends")
    )
    return without_spans(joined)
