"""Base scores against plain counting; probabilities of all tokens sum to 1; gain on held-out texts."""

import math
import random
import zlib
from collections import Counter

import numpy as np
from tripweave.llm.language_id import held_out
from pyspark.sql import functions as F
from tripweave.llm.maxent_lm import (
    END,
    Model,
    Settings,
    build_vocabulary,
    class_logits,
    cluster,
    fit_units,
    least_count,
    log_softmax,
    score_corpus,
    token_counts,
)

SMALL = Settings(frequent=40, suffixes=8, lookup=60, classes=4, columns=16, rows=256, rounds=2)


def corpus():
    rng = random.Random(5)
    out = []
    for i in range(300):
        kind = rng.choice("ab")
        out.append((i, " ".join(f"{kind}{min(rng.randrange(120), rng.randrange(120))}" for _ in range(40))))
    return out


def test_base_scores_and_gain(docs, odd):
    table = corpus() + [(1000 + k, text) for k, (_, text) in enumerate(odd)]
    got = {r.doc_id: r for r in score_corpus(docs(*table), held_out(parts=10), SMALL).collect()}
    assert len(got) == len(table)
    tokens = {i: [*(t or "").encode().lower().split(), END] for i, t in table}
    held = {i for i in tokens if zlib.crc32(str(i).encode()) % 10 == 0}
    c = Counter(w for i, ws in tokens.items() if i not in held for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in tokens.items():
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        assert abs(got[i].base_score - base) < 1e-6 * max(1, abs(base))
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(ws), sum(c[w] > 0 for w in ws), n)
    own = [i for i in held if i < 1000]
    assert sum(got[i].score for i in own) > sum(got[i].base_score for i in own)


def test_tokens_of_a_unit_share_its_probability(docs):
    v = build_vocabulary(token_counts(docs(*corpus()).selectExpr("doc_id", "cast(text as binary) text")), SMALL)
    assert abs(v.unit_total.sum() - v.total) < 1e-9
    assert v.unit_distinct[SMALL.frequent :].sum() == v.distinct - SMALL.frequent
    assert np.all(v.unit_total[SMALL.frequent :] >= v.unit_distinct[SMALL.frequent :])


def test_tokens_share_the_probability_of_their_unit(docs):
    table = corpus()
    counts = Counter(w.encode() for _, t in table for w in t.split())
    v = build_vocabulary(token_counts(docs(*table).selectExpr("doc_id", "cast(text as binary) text")), SMALL)
    shares = Counter()
    for token, count in counts.items():
        place = v.tokens.get(token, SMALL.lookup)
        if place >= SMALL.frequent:
            u = v.suffix_unit(token)
            shares[u] += (count + 0.1) / (v.unit_total[u] + 0.1 * (v.unit_distinct[u] + 1))
    left = {u: 0.1 / (v.unit_total[u] + 0.1 * (v.unit_distinct[u] + 1)) for u in shares}
    assert shares and all(abs(shares[u] + left[u] - 1) < 1e-9 for u in shares)  # the rest: unknown tokens


def test_both_softmaxes_are_distributions(docs):
    rng = np.random.default_rng(0)
    v = build_vocabulary(token_counts(docs(*corpus()).selectExpr("doc_id", "cast(text as binary) text")), SMALL)
    pairs = rng.integers(0, 20, (SMALL.columns, v.units)).astype(float)
    classes = cluster(pairs, SMALL.classes)
    units = fit_units(pairs, classes, v)
    for c in np.unique(classes):  # P(unit | class, word before) sums to 1 in every class and column
        assert np.allclose(np.exp(units[:, classes == c]).sum(axis=1), 1, atol=1e-4)
    model = Model(classes, rng.normal(size=SMALL.classes), rng.normal(size=(SMALL.rows, SMALL.classes)), units)
    shares = np.exp(log_softmax(class_logits(model, [rng.integers(0, SMALL.rows, 50) for _ in range(4)])))
    whole = shares[:, classes] * np.exp(units[rng.integers(0, SMALL.columns, 50)])
    assert np.allclose(whole.sum(axis=1), 1, atol=1e-4)  # over all units of all classes


def test_the_most_frequent_tokens_are_found_without_sorting_all(frame):
    rows = [(f"t{k}".encode(), 5000 - k) for k in range(100)] + [(f"r{k}".encode(), 3) for k in range(5000)]
    counts = frame("token binary, count long", *rows)
    assert least_count(counts, 100) <= 4901 and counts.where(F.col("count") >= least_count(counts, 100)).count() >= 100
    assert counts.where(F.col("count") >= least_count(counts, 150)).count() == 100  # of very many ties none
    assert counts.where(F.col("count") >= least_count(counts, 50)).count() < 150


def test_empty_table(docs):
    assert score_corpus(docs(), held_out(parts=10), SMALL).count() == 0
