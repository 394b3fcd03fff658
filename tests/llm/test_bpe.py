"""Token ids and decoded texts against the tokenizers library."""

import json
import random
import sys
import tracemalloc

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer
from tripweave.llm import bpe
from tripweave.llm.bpe import Encoder, Table, encode, encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def odd_texts():
    rng = random.Random(3)
    few = " \n\t\r  aAbB'stré1２½_-<|>\x1c\x85\u200b中文😀́ß"
    out = ["", "   ", "a" * 5000, "\n\n \n a", "<|endoftext|> a<|endoftext|>", "don't  'S we'll"]
    out += ["".join(rng.choice(few) for _ in range(rng.randint(1, 60))) for _ in range(300)]
    return out + ["".join(chr(rng.randint(32, 0xD7FF)) for _ in range(30)) for _ in range(200)]


def test_ids_and_decoding_match(library):
    own = encoder(open(PATH, encoding="utf-8").read())
    texts = odd_texts()
    ids = own.encode_batch(texts)
    assert ids == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    assert [own.decode(x) for x in ids] == [library.decode(x, skip_special_tokens=False) for x in ids]


def test_shared_prefixes_give_the_ids_of_each_word_alone():
    own = encoder(open(PATH, encoding="utf-8").read())
    words = [b" inter", b" international", b" internationally", b" int", b"i", bytes([255, 254, 0])]
    together = own.encode_words(words)
    assert all(together[w] == own.encode_words([w])[w] for w in words)
    assert all(b"".join(own.bytes_of[i] for i in ids) == w for w, ids in together.items())


def test_whole_table(docs, odd, library):
    got = {(r.doc_id, tuple(r.token_ids), r.decoded) for r in encode(docs(*odd), PATH).collect()}
    want = {(i, tuple(library.encode(t or "", add_special_tokens=False).ids), t or "") for i, t in odd}
    assert got == want
    assert encode(docs(), PATH).count() == 0


def test_a_worker_keeps_little_for_the_vocabulary():
    with open(PATH, encoding="utf-8") as file:
        tokenizer = json.load(file)
    tracemalloc.start()
    own = Encoder(tokenizer)
    kept = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert own.encode_words([b" international"]) and kept < 60e6


def test_batches_of_long_texts_are_small(docs, spark):
    text = " ".join(f"word{k}" for k in range(10_000))
    rows = encode(docs(*((k, text) for k in range(20))), PATH).collect()
    assert len(rows) == 20 and {r.decoded for r in rows} == {text}
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "256k"


def made_words(rng, n):
    parts = "tion ment er st th an in re on qu eau oi la le ch sch ung é ß ж 中 7 2026 x".split()
    return ["".join(rng.choices(parts, k=rng.randint(1, 6))) for _ in range(n)]


def test_new_words_take_few_calls_each():
    own = Encoder(json.load(open(PATH, encoding="utf-8")))
    words = sorted(set(made_words(random.Random(1), 40_000)))
    texts = [" ".join(words[k : k + 500]) for k in range(0, len(words), 500)]
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        own.encode_batch(texts)
    finally:
        sys.setprofile(None)
    assert len(words) > 20_000 and calls < 10 * len(words)


def test_levels_and_depth_first_agree(library):
    own = Encoder(json.load(open(PATH, encoding="utf-8")))
    rng = random.Random(2)
    words = {w.encode() for w in made_words(rng, 3000)} | {rng.randbytes(rng.randint(1, 90)) for _ in range(500)}
    words |= {b"a" * k for k in range(1, 120)}
    found = own.encode_words(words)
    assert list(found.values()) == list(own._depth_first(sorted(words)))
    assert min(map(len, words)) < bpe.LEVELS < max(map(len, words))


def test_little_room_gives_the_same_ids(library, monkeypatch):
    for name, value in {"REMEMBERED": 50, "REMEMBERED_CHARACTERS": 400, "RUNS": 7, "WORDS": 9, "PAIRS": 5}.items():
        monkeypatch.setattr(bpe, name, value)
    own = Encoder(json.load(open(PATH, encoding="utf-8")))
    texts = odd_texts()[:80] + [" ".join(made_words(random.Random(k), 40)) for k in range(20)]
    for _ in range(2):
        for k in range(0, len(texts), 9):
            ids, places = own.encode_texts(texts[k : k + 9])
            want = library.encode_batch(texts[k : k + 9], add_special_tokens=False)
            assert np.split(ids, places[1:-1])[-1].tolist() == want[-1].ids
            assert [ids[a:b].tolist() for a, b in zip(places, places[1:])] == [x.ids for x in want]
            assert own.decode_texts(ids, places) == [library.decode(x.ids, skip_special_tokens=False) for x in want]


def test_a_table_finds_what_it_holds_and_nothing_else():
    rng, table = np.random.default_rng(4), Table(1000)
    keys = rng.permutation(1 << 20)[:2500].astype(np.int64)
    table.put(keys[:600], np.arange(600))
    table.put(keys[600:1000], np.arange(600, 1000))
    assert table.get(keys[:1000]).tolist() == list(range(1000)) and (table.get(keys[1000:]) == -1).all()
    table.put(keys[1000:1001], np.array([7]))  # no room: it begins anew
    assert table.get(keys[:1001]).tolist() == [-1] * 1000 + [7]
    table.put(keys, np.arange(2500))  # more than there is room for
    assert table.get(keys).tolist() == [*range(1000), *[-1] * 1500]
