"""Exact token counts of every prefix of a text by dynamic programming, for a byte-level BPE tokenizer.

For each word of the tokenizer's pattern, position k keeps the last token of the encoding of the
word's first k bytes: the longest token that ends there and is stable behind the last token at its
own beginning. The count at k is one more than the count at that beginning. A worker remembers the
counts of words and chunks (what lies between single blanks), up to a bound, so a text's counts are
put together from those of its chunks and a running total. The count of a prefix is that of encoding the
prefix alone, also where its words end otherwise than in the whole text: a run of white space is one
word while nothing follows it, a contraction such as 're is two words before its last letter, and an
added token is plain text before its end.

What is stored (`prefix_counts[k - 1]`: tokens of the first k characters) answers without encoding
again: `tokens_of_prefix` for a prefix, `longest_prefix` for a token budget, `cut_chars` in the table.
Counts of prefixes may fall as well as rise (two tokens become one), so the longest prefix within a
budget is looked for among all prefixes.

Null and empty texts have no prefixes and zero tokens. Texts and words of any length are counted
whole. Rows may repeat; each is counted. A null identifier stays null. Other columns are neither read
nor returned. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripweave.llm.bpe import CHUNKS, Encoder
from tripweave.llm.common import bounded_batches

SPACES = regex.compile(r"\p{White_Space}+")
BESIDE_BLANK = re.compile(r"\s |^ | $| \s")
"""A blank that is not between two characters that are no white space."""
CONTRACTIONS = ("'re", "'ve", "'ll")
POOL_CHARACTERS = 16_000_000
"""Characters of words and chunks whose counts a worker remembers; beyond it, it begins anew."""
LONGEST_REMEMBERED = 256


class PrefixCounter:
    """Counts of all prefixes; what it remembers is bounded by characters and dropped by `forget`."""

    def __init__(self, tokenizer: dict):
        self.vocabulary = Encoder(tokenizer)
        names = list(self.vocabulary.added)
        if any(a != b and a.startswith(b) for a in names for b in names):
            raise ValueError("added tokens that begin with another one are not supported")
        self.forget()

    def forget(self) -> None:
        self.heads: dict[str, int] = {}
        self.tails: dict[str, int] = {}
        self.words: dict[str, int] = {}
        self.moves: dict[int, int] = {}
        self.begin, self.size = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.total = np.zeros(1024, np.int64)
        self.pool = np.zeros(1 << 16, np.int32)
        self.rows = self.used = 0
        self.vocabulary.stable.clear()

    def _add(self, table: dict[str, int], names: list[str], sizes: np.ndarray, counts: np.ndarray) -> None:
        """Put pieces with counts that follow each other into the pool, and their rows into a table."""
        first, n = self.rows, len(names)
        while first + n > len(self.begin):
            self.begin, self.size, self.total = (
                np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.size, self.total)
            )
        if self.used + len(counts) > len(self.pool):
            grown = np.zeros(max(3 * len(self.pool) // 2, self.used + len(counts)), np.int32)
            grown[: self.used] = self.pool[: self.used]
            self.pool = grown
        ends = np.cumsum(sizes)
        self.pool[self.used : self.used + len(counts)] = counts
        self.begin[first : first + n] = self.used + ends - sizes
        self.size[first : first + n] = sizes
        some = np.flatnonzero(sizes)
        self.total[first : first + n] = 0
        self.total[first + some] = counts[ends[some] - 1]
        table.update(zip(names, range(first, first + n)))
        self.rows, self.used = first + n, self.used + len(counts)

    def _learn(self, words: set[str]) -> None:
        """Tokens of the first 1, 2, ... characters of words.

        The state at a position depends on the bytes before it only, so in sorted order a word starts
        from the states that it has in common with the word before.
        """
        v = self.vocabulary
        step, ends, stable, moves = v.step, v.ends, v.stable, self.moves
        before, states, last, count = b"", [0], [-1], [0]
        names: list[str] = []
        sizes: list[int] = []
        flat: list[int] = []
        for data in sorted([word.encode() for word in words]):
            depth = 0
            for x, y in zip(before, data):
                if x != y:
                    break
                depth += 1
            before = data
            del states[depth + 1 :], last[depth + 1 :], count[depth + 1 :]
            state = states[depth]
            for at in range(depth + 1, len(data) + 1):
                key = state << 8 | data[at - 1]
                state = step.get(key, -1)
                if state < 0:
                    state = moves.get(key, -1)
                    if state < 0:
                        state = moves[key] = v._further(key)
                for token, length in ends[state]:  # tokens that end here, the longest first
                    begin = at - length
                    if begin == 0:
                        break
                    pair = last[begin] << 20 | token
                    good = stable.get(pair)
                    if good is None:
                        good = stable[pair] = not v._crossed(last[begin], token)
                    if good:
                        break
                else:
                    raise ValueError(f"no token ends {data[:at]!r}")
                states.append(state)
                last.append(token)
                count.append(count[begin] + 1)
            word = data.decode()
            if len(word) == len(data):
                flat += count[1:]
            else:
                flat += [c for c, b in zip(count[1:], data[1:]) if b & 0xC0 != 0x80] + count[-1:]
            names.append(word)
            sizes.append(len(word))
        self._add(self.words, names, np.array(sizes, np.int64), np.array(flat, np.int32))
        for word in words.intersection(CONTRACTIONS):  # its first two characters are two words
            first, second = (self.total[self.words[c]] for c in word[:2])
            begin = self.begin[self.words[word]]
            self.pool[begin : begin + 2] = first, first + second

    def _counts(self, cut: list[list[str]], tables: tuple[dict[str, int], dict[str, int]]):
        """Counts of texts cut into pieces of known counts, one after another, and the texts' ends.

        The first piece of a text is looked up in the first table, the others in the second.
        """
        head, tail = tables
        rows: list[int] = []
        for pieces in cut:
            each = iter(pieces)
            rows.append(head[next(each)])
            rows.extend(map(tail.__getitem__, each))
        row = np.array(rows, np.int64)
        first = np.cumsum([0, *map(len, cut)])
        size, total = self.size[row], self.total[row]
        before = np.cumsum(total) - total
        before -= np.repeat(before[first[:-1]], np.diff(first))
        end = np.cumsum(size)
        place = np.arange(end[-1]) + np.repeat(self.begin[row] - (end - size), size)
        return (self.pool[place] + np.repeat(before, size)).astype(np.int32), end[first[1:] - 1]

    def pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Counts of texts without added tokens, one after another, and the texts' ends, by words."""
        find = self.vocabulary.words.findall
        cut = [[text] if text.isalpha() else find(text) or [""] for text in texts]
        words = set(chain.from_iterable(cut))
        spaced = [k for k, text in enumerate(texts) if " " in text[1:] or not text.isprintable()]
        for k in spaced:
            words.update(SPACES.findall(texts[k]))
        words.update(c for word in CONTRACTIONS if word in words for c in word[:2])
        self._learn(words - self.words.keys())
        counts, ends = self._counts(cut, (self.words, self.words))
        for k in spaced:
            at = ends[k] - len(texts[k])
            for run in SPACES.finditer(texts[k]):
                begin, end = run.span()
                row = self.words[run.group()]
                own = self.pool[self.begin[row] : self.begin[row] + self.size[row]]
                if end - begin > 1 or end == len(texts[k]) or run.group() != " ":
                    counts[at + begin : at + end] = (counts[at + begin - 1] if begin else 0) + own
        return counts, ends

    def text_counts(self, text: str) -> np.ndarray:
        """Counts of a text that holds added tokens: each of them closes what came before it."""
        parts = self.vocabulary.find_added.split(text)
        total, out = 0, []
        for k in range(0, len(parts), 2):
            plain, token = parts[k], "".join(parts[k + 1 : k + 2])
            counts = self.pieces([plain + token])[0]
            if token:
                counts[-1] = (counts[len(plain) - 1] if plain else 0) + 1
            out.append(total + counts)
            total += int(counts[-1]) if len(counts) else 0
        return np.concatenate(out)

    def _remember(self, table: dict[str, int], chunks: set[str], lead: str) -> None:
        names = list(chunks - table.keys())
        if names:
            counts, ends = self.pieces([lead + chunk for chunk in names])
            self._add(table, names, np.diff(ends, prepend=0), counts)

    def _settle(self, cut: list[list[str]]) -> list[np.ndarray]:
        """Counts of texts cut into chunks, put together from the counts of the chunks."""
        self._remember(self.heads, {chunks[0] for chunks in cut}, "")
        self._remember(self.tails, set(chain.from_iterable(chunks[1:] for chunks in cut)), " ")
        counts, ends = self._counts(cut, (self.heads, self.tails))
        return np.split(counts, ends[:-1])

    def count_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """Counts of the prefixes of each text."""
        if self.used > POOL_CHARACTERS:
            self.forget()
        out: list[np.ndarray | None] = [None] * len(texts)
        cut, where = [], []
        added = self.vocabulary.find_added
        for k, text in enumerate(texts):
            if not text:
                out[k] = np.zeros(0, np.int32)
            elif added and added.search(text):
                out[k] = self.text_counts(text)
            else:
                chunks = CHUNKS.split(text) if BESIDE_BLANK.search(text) else text.split(" ")
                if max(map(len, chunks)) > LONGEST_REMEMBERED:
                    out[k] = self._apart(chunks)
                else:
                    cut.append(chunks)
                    where.append(k)
        if cut:
            for k, counts in zip(where, self._settle(cut)):
                out[k] = counts
        return out

    def _apart(self, chunks: list[str]) -> np.ndarray:
        """As _settle for one text with a very long chunk, which is not remembered."""
        out, total, run = [], 0, []

        def close() -> None:
            nonlocal total
            if run:
                counts = self._settle([["", *run]])[0]  # an empty first chunk counts nothing
                out.append(total + counts)
                total = int(out[-1][-1])
                run.clear()

        for k, chunk in enumerate(chunks):
            if k and len(chunk) <= LONGEST_REMEMBERED:
                run.append(chunk)
                continue
            close()
            counts = self.pieces([f" {chunk}" if k else chunk])[0]
            out.append(total + counts)
            total = int(out[-1][-1])
        close()
        return np.concatenate(out)


@lru_cache(maxsize=1)
def counter(tokenizer_json: str) -> PrefixCounter:
    return PrefixCounter(json.loads(tokenizer_json))


def longest_within(counts: np.ndarray, ends: np.ndarray, budget: int) -> np.ndarray:
    """For texts whose counts follow each other, the characters of each one's longest prefix in budget."""
    good = np.flatnonzero(counts <= budget)
    at = np.searchsorted(good, ends, "left") - 1  # the last good place before each end
    begin = np.r_[0, ends[:-1]]
    found = np.where(at >= 0, good[np.maximum(at, 0)] if len(good) else -1, -1)
    return np.where(found >= begin, found - begin + 1, 0)


def count_prefixes(
    docs: DataFrame,
    tokenizer_path: str,
    budgets: tuple[int, ...] = (),
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, prefix_counts and cut_chars.

    prefix_counts: tokens of the first 1, 2, ... characters. cut_chars: for each of `budgets` the
    characters of the longest prefix of at most so many tokens.
    """
    spark = docs.sparkSession
    bounded_batches(spark, rows=1000, size="2m")
    with open(tokenizer_path, encoding="utf-8") as file:
        shared = spark.sparkContext.broadcast(file.read())

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(shared.value)
        for batch in batches:
            if batch.num_rows:
                texts = batch.column(1).to_pylist()
                found = own.count_batch(texts)
                ends = np.cumsum([len(x) for x in found], dtype=np.int64)
                flat = np.concatenate(found) if found else np.zeros(0, np.int32)
                cuts = np.stack([longest_within(flat, ends, b) for b in budgets], 1) if budgets else ()
                lists = pa.array(np.r_[0, ends].astype(np.int32))
                every = pa.array(np.arange(len(found) + 1, dtype=np.int32) * len(budgets))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array([len((t or "").encode()) for t in texts], pa.int64()),
                        pa.array([int(x[-1]) if len(x) else 0 for x in found], pa.int64()),
                        pa.ListArray.from_arrays(lists, pa.array(flat)),
                        pa.ListArray.from_arrays(every, pa.array(np.ravel(cuts), pa.int64())),
                    ],
                    ["doc_id", "n_bytes", "n_tokens", "prefix_counts", "cut_chars"],
                )

    chosen = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return chosen.mapInArrow(
        counted,
        "doc_id long, n_bytes long, n_tokens long, prefix_counts array<int>, cut_chars array<long>",
    )


def tokens_of_prefix(characters: Column | int, counts: str = "prefix_counts") -> Column:
    """Tokens of the first so many characters (none: zero; more than the text has: all)."""
    at = F.least(F.lit(characters) if isinstance(characters, int) else characters, F.size(counts))
    return F.when(at > 0, F.get(counts, at - 1)).otherwise(0).cast("long")


def longest_prefix(budget: Column | int, counts: str = "prefix_counts") -> Column:
    """Characters of the longest prefix of at most so many tokens."""
    most = F.lit(budget) if isinstance(budget, int) else budget
    good = F.transform(counts, lambda c, k: F.when(c <= most, k + 1).otherwise(0))
    return F.coalesce(F.array_max(good), F.lit(0)).cast("long")
