"""Byte-level BPE by prefix-sharing trie traversal, and decoding.

Each batch of texts is cut into words by the tokenizer's pattern; words not met before go into a trie.
A walk carries, for each byte of a path, the last token of the encoding of the prefix that ends
there: the one token that ends the prefix and is stable behind the last token of the shorter prefix.
So what words share at their beginning is encoded once. A word's tokens are read off the path
backwards. The trie is walked level by level, all paths of a depth at once as arrays; words of many
bytes, which would make many levels of few paths, are walked depth first. Only the tokenizer file
(vocabulary and merges) is broadcast.

A null or empty text has no tokens. Texts and words of any length are encoded whole. Special tokens in a text are the tokenizer's
added tokens and are found as the file says. Rows may repeat; each is encoded. Further columns are
neither read nor returned. An empty table gives an empty result.
"""

from __future__ import annotations

import gc
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripweave.llm.common import bounded_batches

PATTERN = r""" ?\p{L}+| ?\p{N}+|'(?:[stmd]|re|ve|ll)| ?[^\p{White_Space}\p{L}\p{N}]+"""
PATTERN += r"""|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""
"""The file's words. No contraction begins like letters or digits do, so these can be tried first."""
CHUNKS = re.compile(r" (?<=\S )(?=\S)")
"""A blank between two characters that are no white space: words begin at it and never cross it."""
REMEMBERED = 300_000
REMEMBERED_CHARACTERS = 8_000_000
LEVELS = 48
"""Words of more bytes are walked depth first."""
PAIRS, RUNS, WORDS = 8192, 1 << 16, 1 << 16
"""What is worked on at once as arrays, whatever the length of a text."""
END = -1
NEVER = 2**31 - 1


def byte_characters() -> list[str]:
    """Character that stands for each byte in the vocabulary: itself where printable, else 256 on."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(spare)) for b in range(256)]


def runs(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places begin, begin + 1, ... of every run, one run after another."""
    end = np.cumsum(size)
    return np.repeat(begin - (end - size), size) + np.arange(end[-1] if len(end) else 0)


def picked(pool: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """What the pool holds at the places of every run."""
    cuts = [slice(at, at + RUNS) for at in range(0, len(size), RUNS)]
    return np.concatenate([pool[:0], *(pool[runs(begin[cut], size[cut])] for cut in cuts)])


class Table:
    """Numbers from 0 under keys from 0, looked up by arrays; it begins anew when its room is used up."""

    def __init__(self, room: int):
        self.room, self.bits = room, (3 * room // 2).bit_length()
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(1 << self.bits, np.int64)  # a key and 1, for 0 is an empty place
        self.values = np.zeros(1 << self.bits, np.int32)
        self.used = 0

    def _place(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Value of each key, -1 where there is none."""
        place, sought = self._place(keys), keys + 1
        there = self.keys[place]
        out = np.where(there == sought, self.values[place], -1)
        rest = np.flatnonzero((there != sought) & (there != 0))
        place, sought = place[rest], sought[rest]
        while len(rest):
            place = (place + 1) & ((1 << self.bits) - 1)
            there = self.keys[place]
            found = there == sought
            out[rest[found]] = self.values[place[found]]
            on = ~found & (there != 0)
            rest, place, sought = rest[on], place[on], sought[on]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Keep distinct keys that are not there yet, as far as there is room."""
        if self.used + len(keys) > self.room:
            self.clear()
            keys, values = keys[: self.room], values[: self.room]
        self.used += len(keys)
        place = self._place(keys)
        while len(keys):
            free = self.keys[place] == 0
            self.keys[place[free]] = keys[free] + 1  # of keys for one place the last one takes it
            taken = self.keys[place] == keys + 1
            self.values[place[taken]] = values[taken]
            keys, values = keys[~taken], values[~taken]
            place = (place[~taken] + 1) & ((1 << self.bits) - 1)


class Encoder:
    """Vocabulary of a byte-level BPE tokenizer file, with the words met so far."""

    def __init__(self, tokenizer: dict):
        model = tokenizer["model"]
        if model["type"] != "BPE" or tokenizer["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError("a byte-level BPE tokenizer is needed")
        if tokenizer["normalizer"] or tokenizer["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("normalizers and prefix spaces are not supported")
        byte_of = {c: b for b, c in enumerate(byte_characters())}
        vocabulary = model["vocab"]
        self.bytes_of = {i: bytes(byte_of[c] for c in token) for token, i in vocabulary.items()}
        self.id_of = {token: i for i, token in self.bytes_of.items()}
        self.rank: dict[int, int] = {}  # of the merge of a pair
        self.parts: dict[int, tuple[int, int, int]] = {}  # rank, left and right part of a token
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            pair = vocabulary[left], vocabulary[right]
            self.rank[pair[0] << 20 | pair[1]] = rank
            self.parts.setdefault(vocabulary[left + right], (rank, *pair))
        self._build_edges()
        made = sorted((rank, i, left, right) for i, (rank, left, right) in self.parts.items())
        ranks, _, lefts, rights = np.array(made, np.int64).reshape(-1, 4).T
        for (_, i, left, right), crossed in zip(made, self._crossed_all(lefts, rights, ranks).tolist()):
            if crossed or not {left, right} <= self.reachable(i):
                del self.id_of[self.bytes_of[i]]  # no text is ever encoded to it
        self._build_suffixes()
        self._build_ends()
        added = {t["content"]: t["id"] for t in tokenizer["added_tokens"]}
        for token in tokenizer["added_tokens"]:
            if token["single_word"] or token["lstrip"] or token["rstrip"]:
                raise ValueError(f"{token['content']}: only plain added tokens are supported")
        self.added = added
        self.bytes_of.update({i: content.encode() for content, i in added.items()})
        self.size_of = np.zeros(max(self.bytes_of) + 1, np.int64)
        for i, token in self.bytes_of.items():
            self.size_of[i] = len(token)
        self.begin_of = np.cumsum(self.size_of) - self.size_of
        self.spelling = np.frombuffer(b"".join(self.bytes_of[i] for i in sorted(self.bytes_of)), np.uint8)
        names = sorted(added, key=len, reverse=True)
        self.find_added = re.compile(f"({'|'.join(map(re.escape, names))})") if names else None
        self.words = regex.compile(PATTERN)
        self.forget()

    def forget(self) -> None:
        """Drop all words met so far."""
        self.stable: dict[int, bool] = {}
        self.moves: dict[int, int] = {}
        self.judged, self.reached = Table(REMEMBERED), Table(REMEMBERED)
        self._forget_words()

    def _forget_words(self) -> None:
        self.known: dict[str, int] = {}  # row of a word
        self.begin, self.size = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.pool = np.zeros(1 << 14, np.int32)
        self.used = self.characters = 0
        ids = np.array([*self.added.values()], np.int32)
        self._remember([*self.added], ids, np.ones_like(ids))

    def _remember(self, words: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        """Put the ids of words, which follow each other, into the pool."""
        first, n = len(self.known), len(words)
        while first + n > len(self.begin):
            self.begin, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.size))
        if self.used + len(ids) > len(self.pool):
            grown = np.zeros(max(3 * len(self.pool) // 2, self.used + len(ids)), np.int32)
            grown[: self.used] = self.pool[: self.used]
            self.pool = grown
        self.pool[self.used : self.used + len(ids)] = ids
        self.begin[first : first + n] = self.used + np.cumsum(counts) - counts
        self.size[first : first + n] = counts
        self.known.update(zip(words, range(first, first + n)))
        self.used += len(ids)

    def reachable(self, i: int) -> set[int]:
        return {x for x in self.parts[i][1:] if self.bytes_of[x] in self.id_of}

    def _build_suffixes(self) -> None:
        """Trie of the vocabulary with, per node, the node of its longest proper suffix."""
        self.step: dict[int, int] = {}
        self.suffix, self.ends = [0], [()]
        level = sorted((token, i) for token, i in self.id_of.items())
        at = [0] * len(level)
        for depth in range(max(map(len, self.id_of))):
            new, parent = {}, {}
            for k, (token, _) in enumerate(level):
                key = at[k] << 8 | token[depth]
                if key not in new:
                    new[key] = len(self.suffix) + len(parent)
                    parent[new[key]] = key
                at[k] = new[key]
            for node, key in parent.items():
                self.suffix.append(self._further(self.suffix[key >> 8] << 8 | key & 255) if depth else 0)
                self.ends.append(())
            self.step.update(new)
            full = {at[k]: i for k, (token, i) in enumerate(level) if len(token) == depth + 1}
            for node in parent:
                own = ((full[node], depth + 1),) if node in full else ()
                self.ends[node] = own + self.ends[self.suffix[node]]
            rest = [k for k, (token, _) in enumerate(level) if len(token) > depth + 1]
            level, at = [level[k] for k in rest], [at[k] for k in rest]

    def _further(self, key: int) -> int:
        """Node of the longest suffix of a node's path and one more byte."""
        node, byte = key >> 8, key & 255
        while node and (node << 8 | byte) not in self.step:
            node = self.suffix[node]
        return self.step.get(node << 8 | byte, 0)

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """Parts at the right (1) or left (0) edge of a token, each with the rank that consumes it."""
        out, consumed = [], float("inf")
        while True:
            out.append((token, consumed))
            if token not in self.parts:
                return out
            consumed, *pair = self.parts[token]
            token = pair[side]

    def _crossed(self, left: int, right: int, before: float = float("inf")) -> bool:
        """Whether a merge over the boundary comes before both tokens are complete.

        Parts at the boundary merge with each other if that merge ranks before the ones that
        consume them; of equal ranks the one further left comes first.
        """
        right_edge = self._edge(right, 0)
        for x, x_end in self._edge(left, 1):
            for y, y_end in right_edge:
                rank = self.rank.get(x << 20 | y)
                if rank is not None and rank < min(x_end, before) and rank <= y_end:
                    return True
        return False

    def _build_edges(self) -> None:
        """Edges of all tokens as arrays, those of a token one after another, and the merges."""
        n = max(self.bytes_of) + 1
        parts = np.full((3, n), -1, np.int64)
        for i, part in self.parts.items():
            parts[:, i] = part
        self.edges = []
        for side in (1, 2):
            owner = token = np.arange(n)
            levels, consumed = [], np.full(n, NEVER)
            while len(token):
                levels.append((owner, token, consumed))
                more = parts[0, token] >= 0
                owner, consumed, token = owner[more], parts[0, token[more]], parts[side, token[more]]
            owner, token, consumed = map(np.concatenate, zip(*levels))
            order, count = np.argsort(owner, kind="stable"), np.bincount(owner, minlength=n)
            edge = token[order].astype(np.int32), consumed[order].astype(np.int32)
            self.edges.append(((np.cumsum(count) - count).astype(np.int32), count.astype(np.int32), *edge))
        self.merges = Table(max(len(self.rank), 1))
        self.merges.put(np.array([*self.rank], np.int64), np.array([*self.rank.values()], np.int32))

    def _build_ends(self) -> None:
        """The longest token that ends at each node, and the longest that ends a token and is shorter."""
        self.nearest = np.array([e[0][0] if e else END for e in self.ends], np.int32)
        self.shorter = np.full(max(self.bytes_of) + 1, END, np.int32)
        for e in self.ends:
            if len(e) > 1:
                self.shorter[e[0][0]] = e[1][0]

    def _crossed_all(self, left: np.ndarray, right: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """_crossed for arrays of tokens."""
        out = np.zeros(len(left), bool)
        (l_at, l_count, l_token, l_end), (r_at, r_count, r_token, r_end) = self.edges[1], self.edges[0]
        for at in range(0, len(left), PAIRS):
            x, y = left[at : at + PAIRS], right[at : at + PAIRS]
            own = np.repeat(np.arange(len(x)), l_count[x])
            i, beside = runs(l_at[x], l_count[x]), y[own]
            j, i = runs(r_at[beside], r_count[beside]), np.repeat(i, r_count[beside])
            own = np.repeat(own, r_count[beside])
            rank = self.merges.get(l_token[i].astype(np.int64) << 20 | r_token[j])
            hit = (rank >= 0) & (rank < l_end[i]) & (rank <= r_end[j])
            if before is not None:
                hit &= rank < before[at : at + PAIRS][own]
            out[at + own[hit]] = True
        return out

    def _next(self, keys: np.ndarray) -> np.ndarray:
        """Node behind each node and byte."""
        out = self.reached.get(keys)
        missing = np.flatnonzero(out < 0)
        if len(missing):
            new, which = np.unique(keys[missing], return_inverse=True)
            step = self.step
            found = np.array([step.get(k) or self._further(k) for k in new.tolist()], np.int32)
            self.reached.put(new, found)
            out[missing] = found[which]
        return out

    def _stable(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether no merge crosses the boundary of two tokens."""
        pairs = left.astype(np.int64) << 20 | right
        out = self.judged.get(pairs)
        missing = np.flatnonzero(out < 0)
        if len(missing):
            new, which = np.unique(pairs[missing], return_inverse=True)
            good = ~self._crossed_all(new >> 20, new & (1 << 20) - 1)
            self.judged.put(new, good)
            out[missing] = good[which]
        return out > 0

    def _by_levels(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of sorted words, one after another, and their numbers, level by level of the trie.

        Words with the same first bytes stand together, so a path of the trie is a run of words; its
        first word stands for it.
        """
        size = np.fromiter(map(len, words), np.int64, len(words))
        begin = np.cumsum(size) - size
        data = np.frombuffer(b"".join(words), np.uint8)
        last = np.zeros(len(data), np.int32)
        path, state, depth = np.zeros(len(words), np.int64), np.zeros(1, np.int64), 0
        there = np.flatnonzero(size)
        path = path[there]
        while len(there):
            place = begin[there] + depth
            key = path << 8 | data[place]
            new = np.r_[True, key[1:] != key[:-1]]
            path, key = np.cumsum(new) - 1, key[new]
            state = self._next(state[key >> 8].astype(np.int64) << 8 | key & 255)
            last[place] = self._last(state, last, place[new], depth + 1)[path]
            depth += 1
            longer = size[there] > depth
            there, path = there[longer], path[longer]
        rounds, count = [], np.zeros(len(words), np.int64)
        there = np.flatnonzero(size)
        place = begin[there] + size[there] - 1
        while len(there):
            token = last[place]
            rounds.append((there, token))
            count[there] += 1
            place = place - self.size_of[token]
            more = place >= begin[there]
            there, place = there[more], place[more]
        end = np.cumsum(count)
        out = np.zeros(end[-1] if len(end) else 0, np.int32)
        for k, (there, token) in enumerate(rounds):
            out[end[there] - 1 - k] = token
        return out, count

    def _last(self, state: np.ndarray, last: np.ndarray, place: np.ndarray, depth: int) -> np.ndarray:
        """Last token of the prefixes of a depth that end at places, the states of which are given."""
        out, rest = np.empty(len(state), np.int32), np.arange(len(state))
        token = self.nearest[state]  # tokens that end here, the longest first
        while len(rest):
            if token.min() < 0:
                raise ValueError(f"no token ends a word's first {depth} bytes")
            size = self.size_of[token]
            good = size == depth
            inner = np.flatnonzero(~good)
            good[inner] = self._stable(last[(place[rest] - size)[inner]], token[inner])
            out[rest[good]] = token[good]
            rest, token = rest[~good], self.shorter[token[~good]]
        return out

    def _tokens(self, last: list[int], depth: int) -> tuple[int, ...]:
        out = []
        while depth:
            out.append(last[depth])
            depth -= len(self.bytes_of[last[depth]])
        return tuple(reversed(out))

    def _depth_first(self, words: Iterable[bytes]) -> Iterator[tuple[int, ...]]:
        """Token ids of sorted words, by one depth-first walk over the trie they form.

        Sorted words are that trie in depth-first order: what a word shares with the one before is
        the part of the path that stays, with its states. The rest is one step down per byte.
        """
        before, states, last = b"", [0], [END]
        step, ends, stable, moves = self.step, self.ends, self.stable, self.moves
        for memory in (stable, moves):  # of fixed size an entry, and dear to find again
            if len(memory) > REMEMBERED:
                memory.clear()
        for word in words:
            depth = 0
            for x, y in zip(before, word):
                if x != y:
                    break
                depth += 1
            before = word
            del states[depth + 1 :], last[depth + 1 :]
            state = states[depth]
            for byte in word[depth:]:
                key = state << 8 | byte
                state = step.get(key)
                if state is None:
                    state = moves.get(key)
                    if state is None:
                        state = moves[key] = self._further(key)
                size = len(last)
                for token, length in ends[state]:  # tokens that end here, the longest first
                    if length == size:
                        break
                    pair = last[size - length] << 20 | token
                    good = stable.get(pair)
                    if good is None:
                        good = stable[pair] = not self._crossed(last[size - length], token)
                    if good:
                        break
                else:
                    raise ValueError(f"no token ends {word[:size]!r}")
                states.append(state)
                last.append(token)
            yield self._tokens(last, len(word))

    def encode_sorted(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of sorted distinct words, one after another, and the number of each word's."""
        ids, count = self._by_levels([w if len(w) <= LEVELS else b"" for w in words])
        long = [k for k, w in enumerate(words) if len(w) > LEVELS]
        if long:
            found = list(self._depth_first(words[k] for k in long))
            at = np.repeat((np.cumsum(count) - count)[long], [len(x) for x in found])
            ids = np.insert(ids, at, np.fromiter(chain.from_iterable(found), np.int32))
            count[long] = [len(x) for x in found]
        return ids, count

    def encode_words(self, words: Iterable[bytes]) -> dict[bytes, tuple[int, ...]]:
        """Token ids of words."""
        distinct = sorted(set(words))
        ids, count = self.encode_sorted(distinct)
        return {w: tuple(x.tolist()) for w, x in zip(distinct, np.split(ids, np.cumsum(count)[:-1]))}

    def encode_texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, one after another, and the places where each begins and the last one ends."""
        find, cut = self.words.findall, []
        for text in texts:
            if text and any(name in text for name in self.added):
                parts = self.find_added.split(text)  # every second one is an added token
                parts = [[x] if k % 2 else find(x) for k, x in enumerate(parts)]
                cut.append(list(chain.from_iterable(parts)))
            else:
                cut.append(find(text) if text else [])
        self._learn(set().union(*cut))
        words = np.cumsum([0, *map(len, cut)])
        row = np.fromiter(map(self.known.__getitem__, chain.from_iterable(cut)), np.int64, words[-1])
        size = self.size[row]
        ids = picked(self.pool, self.begin[row], size)
        return ids, np.r_[0, np.cumsum(size)][words]

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text."""
        ids, places = self.encode_texts(texts)
        return [ids[a:b].tolist() for a, b in zip(places, places[1:])]

    def _learn(self, words: set[str]) -> None:
        """Ids of words not met before; entries and characters remembered stay under fixed numbers."""
        if len(self.known) > REMEMBERED or self.characters > REMEMBERED_CHARACTERS:
            self._forget_words()
        spelled = sorted(word.encode() for word in words - self.known.keys())
        for at in range(0, len(spelled), WORDS):
            own = spelled[at : at + WORDS]
            self._remember([word.decode() for word in own], *self.encode_sorted(own))
            self.characters += sum(map(len, own))

    def decode_texts(self, ids: np.ndarray, places: np.ndarray) -> list[str]:
        """Texts of ids that begin at places."""
        size = self.size_of[ids]
        data = picked(self.spelling, self.begin_of[ids], size).tobytes()
        at = np.r_[0, np.cumsum(size)][places].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(at, at[1:])]

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=1)
def encoder(tokenizer_json: str) -> Encoder:
    return Encoder(json.loads(tokenizer_json))


def encode(
    docs: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """doc_id, token_ids (array of int) and decoded (the text decoded from these ids)."""
    spark = docs.sparkSession
    bounded_batches(spark, size="256k")  # a batch's chunks, ids and decoded texts take many times its size
    with open(tokenizer_path, encoding="utf-8") as file:
        shared = spark.sparkContext.broadcast(file.read())

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # the encoder makes no cycles, and looking for them takes long
        own = encoder(shared.value)
        try:
            yield from map(own_batch(own), batches)
        finally:
            gc.enable()

    def own_batch(own: Encoder):
        def encoded_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, places = own.encode_texts(batch.column(1).to_pylist())
            return pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.ListArray.from_arrays(pa.array(places.astype(np.int32)), pa.array(ids)),
                    pa.array(own.decode_texts(ids, places), pa.string()),
                ],
                ["doc_id", "token_ids", "decoded"],
            )

        return encoded_batch

    chosen = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return chosen.mapInArrow(encoded, "doc_id long, token_ids array<int>, decoded string")
