"""Counts of every prefix against encoding every prefix with the tokenizers library."""

import json

import numpy as np
import public_tokenizers
import pytest
from tests.llm.test_bpe import library, odd_texts  # noqa: F401
from tripweave.llm import token_counts
from tripweave.llm.token_counts import (
    count_prefixes,
    counter,
    longest_prefix,
    longest_within,
    tokens_of_prefix,
)

PATH = public_tokenizers.path("byte_bpe_50k.json")
HARD = [
    "a  b", "a   b\n\n\nc", "x're y've 'll'll' 'r", "''re 's'", " \n x", "x ", "  ", "a \n b\t\tc",
    "foo <|endoftext|>bar<|endoftext|><|endoftext|> <|endoftext", "!!<|endoftext|>!!", "<|endoftext|>",
    "it’s naïve 中文字 😀😀 ß", "don't we'll   x", "q" * 600 + " tail " + "w " * 40 + "z" * 300,
    "lead " + "v" * 300 + "  two", "\x1c \x1cx \x85 y",
]


@pytest.fixture(scope="module")
def own():
    return counter(open(PATH, encoding="utf-8").read())


def brute(library, text):  # noqa: F811
    found = library.encode_batch([text[:k] for k in range(1, len(text) + 1)], add_special_tokens=False)
    return [len(x.ids) for x in found]


def test_every_prefix_of_hard_and_random_texts(own, library):  # noqa: F811
    texts = HARD + [t[:120] for t in odd_texts()] + ["", None]
    got = own.count_batch(texts)
    for text, counts in zip(texts, got):
        assert counts.tolist() == brute(library, text or ""), repr(text)


def test_forgetting_changes_nothing(own, monkeypatch):
    texts = HARD + ["one two three one two", "three two one"]
    want = [x.tolist() for x in own.count_batch(texts)]
    monkeypatch.setattr(token_counts, "POOL_CHARACTERS", 1)
    monkeypatch.setattr(token_counts, "LONGEST_REMEMBERED", 2)
    for _ in range(2):
        assert [x.tolist() for x in own.count_batch(texts)] == want


def test_longest_prefix_counts_may_fall():
    counts = np.array([1, 2, 1, 3, 1, 2, 5, 4])
    ends = np.array([4, 4, 8])
    assert longest_within(counts, ends, 1).tolist() == [3, 0, 1]
    assert longest_within(counts, ends, 0).tolist() == [0, 0, 0]
    assert longest_within(counts, ends, 4).tolist() == [4, 0, 4]


def test_whole_table_and_questions(docs, odd, library):  # noqa: F811
    table = [*odd, (20, "The quick brown fox <|endoftext|> don't  stop"), (20, "again")]
    found = count_prefixes(docs(*table), PATH, budgets=(3, 0))
    asked = found.select("*", longest_prefix(3).alias("own_cut"), tokens_of_prefix(9).alias("nine"))
    got = asked.collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == sorted(
        (str(i), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in table
    )
    for r in got:
        assert r.cut_chars == [r.own_cut, 0]
        assert r.own_cut == max((k + 1 for k, c in enumerate(r.prefix_counts) if c <= 3), default=0)
        text = next(t or "" for i, t in table if i == r.doc_id and len((t or "").encode()) == r.n_bytes)
        assert len(r.prefix_counts) == len(text)
        assert r.nine == len(library.encode(text[:9], add_special_tokens=False).ids)
    assert count_prefixes(docs(), PATH).count() == 0


def test_added_tokens_that_begin_alike_are_refused():
    tokenizer = json.load(open(PATH, encoding="utf-8"))
    tokenizer["added_tokens"].append({**tokenizer["added_tokens"][0], "id": 50257, "content": "<|endoftext|>x"})
    with pytest.raises(ValueError, match="begin with"):
        token_counts.PrefixCounter(tokenizer)
