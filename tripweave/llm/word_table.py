"""Words of a whole Arrow batch of texts as numpy arrays: where they are, and 64-bit hashes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LONG = 48
FACTOR = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)


@dataclass
class WordTable:
    """Words of several texts in order; first[i] to first[i + 1] are the words of text i."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()

    def joined(self, begin: int, end: int) -> bytes:
        """Words begin to end - 1, separated by one blank."""
        return b" ".join(self.data[self.starts[begin] : self.ends[end - 1]].tobytes().split())

    def texts(self) -> np.ndarray:
        """Number of the text that each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def word_table(texts: pa.Array, lower: bool) -> WordTable:
    """Words between blanks and control characters 9 to 13 of a binary column; null: no words."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    if len(texts) == 0:
        empty = np.empty(0, np.int64)
        return WordTable(np.empty(0, np.uint8), empty, empty, np.zeros(1, np.int64))
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    if lower:
        data = LOWER[data]
    inside = ~SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before = np.r_[False, inside[:-1]] if len(data) else inside
    after = np.r_[inside[1:], False] if len(data) else inside
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return WordTable(data, starts, ends, np.searchsorted(starts, offsets))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX
    h = (h ^ (h >> np.uint64(29))) * FACTOR
    return h ^ (h >> np.uint64(32))


def word_hashes(words: WordTable) -> np.ndarray:
    """A hash of each word. Equal words have equal hashes; use it to find, not to prove."""
    sizes = words.ends - words.starts
    h = sizes.astype(np.uint64)
    active = np.arange(len(sizes))
    for k in range(LONG):
        active = active[sizes[active] > k]
        if len(active) == 0:
            break
        h[active] = h[active] * FACTOR + words.data[words.starts[active] + k]
    for i in np.flatnonzero(sizes > LONG):
        h[i] = xxhash.xxh64_intdigest(words.word(i))
    return mixed(h)


def run_hashes(h: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of `length` words, by position of its first word."""
    if len(h) < length:
        return np.empty(0, np.uint64)
    n = len(h) - length + 1
    total = np.zeros(n, np.uint64)
    for k in range(length):
        total = total * MIX + h[k : k + n]
    return mixed(total)
