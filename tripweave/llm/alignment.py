"""Cross-tokenizer alignment by diagonal run skipping, and counts of linked token pairs.

Tokenizer A (a byte-level BPE file, special tokens read as plain text) encodes a blank and the text, B
(a sentencepiece file, which adds the blank itself) the text. A token's end is a byte offset. Where
both tokenizers have a token that ends, the tokens are cut into groups. While groups are one token to
one, B's position is A's plus a fixed shift: exponential probing compares ever longer slices of the two
end arrays at that shift and jumps over the equal ones. At the first difference the irregular group is
resolved locally, by stepping whichever token ends first, and the shift is updated. Tokens are linked
if their byte ranges overlap: one to one in runs, step by step in irregular groups.

The corpus-wide count of an id pair is the number of documents that link it. A block is a batch of
documents of bounded size; its distinct pairs are counted once in it, summed over blocks, compared
with the highest count of their A id (a window of at most B's vocabulary), and joined back to the
block, so that neither links nor pairs of documents are shuffled. The table of pairs is never
broadcast. A very common pair has one row a block, which is what adaptive execution splits.

Texts that are null, empty, or not given back byte by byte by both tokenizers have no tokens: zeros and
an empty `groups`. Texts of any length are aligned whole. Rows may repeat, also identifiers; each is a
document. Other columns are neither read nor returned. An empty table gives an empty result.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripweave.llm.bpe import CHUNKS, byte_characters
from tripweave.llm.common import bounded_batches, stored
from tripweave.llm.token_counts import BESIDE_BLANK

FIRST_PROBE = 4
"""Tokens of the first slice that is compared at a shift."""
JOINED = 4096
"""Chunks that are encoded as one text."""
SLICE_CHARACTERS = 250_000
"""Characters of texts that are cut into chunks at once, if they are several."""
POOL_CHARACTERS = 4_000_000
"""Characters of chunks whose ids a worker remembers; beyond it, it begins anew."""
SHIFT = 32
"""A pair is A's id in the high and B's id in the low bits of a long."""
ALIGNED = "doc_id long, block string, n_a long, n_b long, n_groups long, n_links long, groups string, "
ALIGNED += "pair_places binary, pair_links binary, block_pairs array<long>, block_docs array<int>"


def align(ends_a: bytes, ends_b: bytes, of_runs: bool = True) -> tuple[list, list[int], list[int]]:
    """Groups and links of two arrays of token ends (int32 as bytes) that end at the same byte.

    Groups are (first A token, first B token, A tokens, B tokens, groups): one entry for a run of
    one-to-one groups, one for each irregular group. Links are two lists of token positions; without
    `of_runs` those of irregular groups only.
    """
    a, b = memoryview(ends_a).cast("i"), memoryview(ends_b).cast("i")
    n, m = len(a), len(b)
    groups, links_a, links_b = [], [], []
    i = shift = 0
    while i < n:
        begin, step, equal, last, moved = i, FIRST_PROBE, True, min(n, m - shift), 4 * shift
        while i < last and equal:
            to = i + step
            if to > last:
                to = last
            at, end = 4 * i, 4 * to
            equal = ends_a[at:end] == ends_b[at + moved : end + moved]
            if equal:
                i, step = to, 2 * step
                continue
            while step > 1:  # the difference is inside: halve down to it
                step //= 2
                half = i + step
                if half > to:
                    half = to
                at, end = 4 * i, 4 * half
                if ends_a[at:end] == ends_b[at + moved : end + moved]:
                    i = half
        j = i + shift
        if i > begin:
            groups.append((begin, begin + shift, i - begin, i - begin, i - begin))
            if of_runs:
                links_a.extend(range(begin, i))
                links_b.extend(range(begin + shift, j))
            if i == n:
                break
        first_a, first_b, x, y = i, j, a[i], b[j]
        while True:  # an irregular group: each step is one overlap
            links_a.append(i)
            links_b.append(j)
            if x < y:
                i += 1
                x = a[i]
            elif y < x:
                j += 1
                y = b[j]
            else:
                i, j = i + 1, j + 1
                break
        groups.append((first_a, first_b, i - first_a, j - first_b, 1))
        shift = j - i
    return groups, links_a, links_b


class Pair:
    """Two tokenizers with the bytes, lengths and decimal names of their tokens."""

    def __init__(self, a_json: str, b_model: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one core a task
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_json)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        byte_of = {c: i for i, c in enumerate(byte_characters())}
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            known = all(c in byte_of for c in token)
            self.bytes_a[i] = bytes(byte_of[c] for c in token) if known else token.encode()
        self.bytes_b = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            whole = bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()
            self.bytes_b.append(whole)
        self.bytes_of = self.bytes_a, self.bytes_b
        self.sizes = [np.array(list(map(len, x)), np.int32) for x in self.bytes_of]
        if any("▁" in self.b.id_to_piece(i).lstrip("▁") for i in range(self.b.get_piece_size())):
            raise ValueError("pieces with a blank behind another character are not supported")
        self.forget()
        self.ids = max(map(len, self.bytes_of))
        if self.ids > 10**7:
            raise ValueError("vocabularies of more than ten million tokens are not supported")
        names = [f"{i}{mark}" for mark in ",|;" for i in range(self.ids)]
        self.names = np.array(names, "S8").view(np.int64)  # ids and the mark behind each, 8 bytes with zeros

    def forget(self) -> None:
        self.row_of: dict[str, int] = {}
        self.pools = [np.zeros(1 << 16, np.int32) for _ in range(2)]
        self.begin, self.size = np.zeros((2, 1024), np.int32), np.zeros((2, 1024), np.int32)
        self.same = np.zeros(1024, bool)
        self.rows, self.used, self.characters = 0, [0, 0], 0

    def _learn(self, chunks: list[str]) -> None:
        """Ids of both tokenizers for a blank and each chunk, and whether both give its bytes back."""
        while self.rows + len(chunks) > len(self.same):
            self.begin, self.size = (np.concatenate([x, x], axis=1) for x in (self.begin, self.size))
            self.same = np.concatenate([self.same, self.same])
        rows = slice(self.rows, self.rows + len(chunks))
        known = [b" " + chunk.encode() for chunk in chunks]
        length = np.fromiter(map(len, known), np.int64, len(known))
        same = np.ones(len(chunks), bool)
        for side, found in enumerate((self._encode_a(chunks), self.b.encode(chunks, num_threads=1))):
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            ids = np.fromiter(chain.from_iterable(found), np.int32, sizes.sum())
            end = self.used[side] + len(ids)
            if end > len(self.pools[side]):
                grown = np.zeros(max(3 * len(self.pools[side]) // 2, end), np.int32)
                grown[: self.used[side]] = self.pools[side][: self.used[side]]
                self.pools[side] = grown
            self.pools[side][self.used[side] : end] = ids
            self.begin[side, rows] = self.used[side] + np.cumsum(sizes) - sizes
            self.size[side, rows] = sizes
            self.used[side] = end
            token = self.bytes_of[side].__getitem__
            reached = np.r_[0, np.cumsum(self.sizes[side][ids])][np.cumsum(sizes)]
            if np.any(reached != np.cumsum(length)) or b"".join(map(token, ids.tolist())) != b"".join(known):
                same &= [b"".join(map(token, x)) == y for x, y in zip(found, known)]
        self.same[rows] = same
        self.row_of.update(zip(chunks, range(rows.start, rows.stop)))
        self.rows = rows.stop
        self.characters += sum(map(len, chunks))

    def _encode_a(self, chunks: list[str]) -> list[list[int]]:
        """A's ids of a blank and each chunk: many chunks are encoded as one text and cut at their ends."""
        plain = [k for k, c in enumerate(chunks) if c and not c[0].isspace() and not c[-1].isspace()]
        out: list[list[int]] = [[]] * len(chunks)
        for start in range(0, len(plain), JOINED):
            own = plain[start : start + JOINED]
            ids = self.a.encode("".join([" " + chunks[k] for k in own]), add_special_tokens=False).ids
            ends = np.cumsum(self.sizes[0][ids])
            cuts = np.searchsorted(ends, np.cumsum([1 + len(chunks[k].encode()) for k in own])) + 1
            begin = 0
            for k, end in zip(own, cuts.tolist()):
                out[k] = ids[begin:end]
                begin = end
        for k in set(range(len(chunks))).difference(plain):
            out[k] = self.a.encode(" " + chunks[k], add_special_tokens=False).ids
        return out

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of both tokenizers of each text; none where one does not give the text back.

        Texts are encoded a slice at a time: their chunks and places take many times a text's size.
        """
        own, characters = [], 0
        for text in texts:
            if own and characters + len(text) > SLICE_CHARACTERS:
                yield from self._encode(own)
                own, characters = [], 0
            own.append(text)
            characters += len(text)
        yield from self._encode(own)

    def _encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of both tokenizers of each text of a slice.

        No token of either reaches over a single blank between two characters that are no white
        space, so texts are cut there and what lies between is encoded when it is met first.
        """
        if self.characters > POOL_CHARACTERS:
            self.forget()
        cut = [CHUNKS.split(t) if BESIDE_BLANK.search(t) else t.split(" ") for t in texts]
        self._learn(list(set(chain.from_iterable(cut)).difference(self.row_of)))
        row = np.fromiter(map(self.row_of.__getitem__, chain.from_iterable(cut)), np.int64)
        first = np.cumsum([0, *map(len, cut)])
        same = np.logical_and.reduceat(self.same[row], first[:-1]) if len(row) else []
        sides = []
        for side in range(2):
            size = self.size[side, row]
            end = np.cumsum(size, dtype=np.int64)
            place = np.arange(end[-1] if len(end) else 0) + np.repeat(self.begin[side, row] - (end - size), size)
            sides.append((self.pools[side][place], np.r_[0, end][first]))
        (ids_a, at_a), (ids_b, at_b) = sides
        for k, good in enumerate(same):
            if good:
                yield ids_a[at_a[k] : at_a[k + 1]], ids_b[at_b[k] : at_b[k + 1]]
            else:
                yield ids_a[:0], ids_b[:0]

    def document(self, a: np.ndarray, b: np.ndarray):
        """Groups as text, number of groups and links as two arrays of ids."""
        ends = [np.cumsum(s[x], dtype=np.int32).tobytes() for s, x in zip(self.sizes, (a, b))]
        groups, links_a, links_b = align(*ends, of_runs=False)
        _, _, n, m, count = np.fromiter(chain.from_iterable(groups), np.int64, 5 * len(groups)).reshape(-1, 5).T
        of_a, of_b = np.repeat(n // count, count), np.repeat(m // count, count)  # tokens of each group
        end_a, end_b = np.cumsum(of_a), np.cumsum(of_b)
        mark_a, mark_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        mark_a[end_a - 1], mark_b[end_b - 1] = self.ids, 2 * self.ids
        names = np.empty(len(a) + len(b), np.int64)
        names[np.arange(len(a)) + np.repeat(end_b - of_b, of_a)] = self.names[a + mark_a]
        names[np.arange(len(b)) + np.repeat(end_a, of_b)] = self.names[b + mark_b]
        letters = names.view(np.uint8)
        told = letters[letters != 0].tobytes()[:-1].decode()
        one = (of_a == 1) & (of_b == 1)  # the groups of runs: an irregular one has three tokens or more
        linked = [np.r_[x[e[one] - 1], x[np.array(at, np.int64)]] for x, e, at in ((a, end_a, links_a), (b, end_b, links_b))]
        return told, len(of_a), *linked


@lru_cache(maxsize=1)
def pair_of_tokenizers(a_json: str, b_model: bytes) -> Pair:
    return Pair(a_json, b_model)


def align_texts(
    docs: DataFrame, a_path: str, b_path: str, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row a document: doc_id, n_a, n_b, n_groups, n_links, groups (`a1,a2|b1;a3|b2,b3`).

    Further columns are for `link_counts`: block; pair_places (places of the document's distinct pairs
    among its block's) and pair_links (how many links each has) as int32 bytes; and on one row a block
    its distinct pairs (block_pairs) with the number of its documents that link them (block_docs).
    Blocks get new names whenever the rows are computed: store the result before reading it twice.
    """
    spark = docs.sparkSession
    bounded_batches(spark, size="2m")
    with open(a_path, encoding="utf-8") as file_a, open(b_path, "rb") as file_b:
        shared = spark.sparkContext.broadcast((file_a.read(), file_b.read()))

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pair_of_tokenizers(*shared.value)
        for batch in batches:
            if batch.num_rows:
                yield block(own, batch)

    def block(own: Pair, batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).to_pylist()
        some = [k for k, t in enumerate(texts) if t]
        numbers = np.zeros((len(texts), 4), np.int64)
        told = [""] * len(texts)
        pairs, links, owners = [], [], []
        for k, (ids_a, ids_b) in zip(some, own.encode([texts[k] for k in some])):
            if len(ids_a) == 0:
                continue
            told[k], n_groups, linked_a, linked_b = own.document(ids_a, ids_b)
            numbers[k] = len(ids_a), len(ids_b), n_groups, len(linked_a)
            linked = linked_a.astype(np.int64) << SHIFT | linked_b
            pair, count = np.unique(linked, return_counts=True)
            pairs.append(pair)
            links.append(count)
            owners.append(k)
        every = np.concatenate(pairs) if pairs else np.zeros(0, np.int64)
        distinct, place, n_docs = np.unique(every, return_inverse=True, return_counts=True)
        places, counts = [b""] * len(texts), [b""] * len(texts)
        at = 0
        for k, count in zip(owners, links):
            places[k] = place[at : at + len(count)].astype(np.int32).tobytes()
            counts[k] = count.astype(np.int32).tobytes()
            at += len(count)
        first = np.r_[0, np.full(len(texts), len(distinct))].astype(np.int32)  # all on the first row
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([uuid.uuid4().hex] * len(texts)),
                *(pa.array(np.ascontiguousarray(numbers[:, c])) for c in range(4)),
                pa.array(told, pa.string()),
                pa.array(places, pa.binary()),
                pa.array(counts, pa.binary()),
                pa.ListArray.from_arrays(pa.array(first), pa.array(distinct)),
                pa.ListArray.from_arrays(pa.array(first), pa.array(n_docs.astype(np.int32))),
            ],
            ["doc_id", "block", "n_a", "n_b", "n_groups", "n_links", "groups"]
            + ["pair_places", "pair_links", "block_pairs", "block_docs"],
        )

    chosen = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return chosen.mapInArrow(aligned, ALIGNED)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, n (documents that link it) and best (whether no pair of the same A id has more)."""
    each = aligned.select(F.explode(F.arrays_zip("block_pairs", "block_docs")).alias("e"))
    counts = each.groupBy(F.col("e.block_pairs").alias("pair")).agg(F.sum("e.block_docs").alias("n"))
    of_a = Window.partitionBy(F.shiftright("pair", SHIFT))  # at most as many rows as B has ids
    return counts.withColumn("best", F.col("n") == F.max("n").over(of_a))


def link_counts(aligned: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, the columns to keep, n_best and count_sum.

    n_best: links whose count is the highest of their A id. count_sum: sum of counts over links.
    """
    kept = ["doc_id", "n_a", "n_b", "n_groups", "n_links", *keep]
    counts = stored(pair_counts(aligned), "pair-counts")
    sought = aligned.where(F.size("block_pairs") > 0).select(
        F.col("block").alias("of_block"), F.posexplode("block_pairs").alias("place", "pair")
    )
    found = sought.join(counts, "pair").select("of_block", "place", "n", "best")
    rows = aligned.select("block", *kept, "pair_places", "pair_links")
    schema = aligned.select(*kept).schema.add("n_best", "long").add("count_sum", "long")

    def judged(rows: pa.Table, found: pa.Table) -> pa.Table:
        count, best = np.zeros((2, found.num_rows), np.int64)
        place = found.column("place").to_numpy()
        count[place] = found.column("n").to_numpy()
        best[place] = found.column("best").to_numpy()
        n_best, total = [], []
        for places, links in zip(rows.column("pair_places"), rows.column("pair_links")):
            at = np.frombuffer(places.as_buffer(), np.int32)
            times = np.frombuffer(links.as_buffer(), np.int32).astype(np.int64)
            n_best.append(int(best[at] @ times))
            total.append(int(count[at] @ times))
        made = [pa.array(n_best, pa.int64()), pa.array(total, pa.int64())]
        return pa.Table.from_arrays([*(rows.column(name) for name in kept), *made], [*kept, "n_best", "count_sum"])

    return rows.groupBy("block").cogroup(found.groupBy("of_block")).applyInArrow(judged, schema)
