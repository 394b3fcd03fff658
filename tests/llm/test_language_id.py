"""Held-out accuracy, rejection and odd texts."""

import random
import zlib

import numpy as np
from tripweave.llm.language_id import UNKNOWN, gram_buckets, identify, language_stage, learn, pieces, train

SYLLABLES = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ung", "ein", "er"], "cc": ["é", "eau", "oi", "que"]}


def sentence(lang, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(20))


def test_held_out_documents_are_recognised(docs, odd):
    table = [(i, sentence(lang, i), lang) for i, lang in enumerate(random.Random(1).choices(list(SYLLABLES), k=400))]
    strange = [(1000 + k, text, None) for k, (_, text) in enumerate(odd)] + [(2000, "123 !?", "aa")]
    df = docs(*table, *strange)
    model = learn(df, sample=300)
    got = {r.doc_id: r for r in identify(df, model).collect()}
    held = [i for i, _, _ in table if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i].lang_pred == table[i][2] for i in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.lang_pred in {*SYLLABLES, UNKNOWN} for r in got.values())
    for i in (1000, 1001, 1002, 2000):
        assert got[i].lang_pred == UNKNOWN and got[i].score == 0 and got[i].rejected
    own = {r.doc_id: r.rejected for r in identify(df, learn(df)).collect()}  # the stage's own sample
    kept = [r.doc_id for r in language_stage(df).collect()]
    assert sorted(map(str, kept)) == sorted(
        str(r.doc_id) for r in identify(df, learn(df)).collect() if not r.rejected
    )
    assert not {1000, 1001, 1002, 2000} & set(kept) and all(own[i] for i in (1000, 1001, 1002, 2000))
    assert len(kept) >= len(table)


def test_no_labels_and_empty_table(docs):
    df = docs((1, "words", None))
    assert learn(df) is None
    assert [tuple(r)[:3] for r in identify(df, None).collect()] == [(1, UNKNOWN, 0.0)]
    assert identify(docs(), None).count() == 0


def test_long_texts_are_cut_at_blanks_only():
    text = " ".join(sentence("cc", i) for i in range(40)).encode() + b"x" * 300 + b" end"
    parts = list(pieces(text, 100))
    assert b"".join(parts) == text and len(parts) > 20
    whole = np.bincount(gram_buckets(text, 1 << 15), minlength=1 << 15)
    apart = sum(np.bincount(gram_buckets(p, 1 << 15), minlength=1 << 15) for p in parts)
    assert (whole == apart).all()


def test_grams_stay_inside_words():
    assert len(gram_buckets(b"ab", 1 << 15)) == 3 + 2 + 1
    assert len(gram_buckets(b"1 2 3", 1 << 15)) == 0
    model = train([(b"kalo", "aa", False), (b"schung", "bb", False)] * 4)
    assert model.predict(b"kalo")[0] == "aa"
