"""Importance resampling against counting every feature by itself."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from tripweave.llm import importance
from tripweave.llm.importance import batch_features, numbered, resample, shifted

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    runs = [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]
    return len(words), [zlib.crc32(r.encode()) % 10000 for r in runs]


def brute(documents, benchmark, percent=5, least=20):
    s, t = Counter(), Counter()
    for _, text in documents:
        s.update(features(text)[1])
    for text in benchmark:
        t.update(features(text)[1])
    total_s, total_t = sum(s.values()), sum(t.values())

    def gain(b):
        x = (float(t[b]) + 1) * (total_s + 10000) / ((float(s[b]) + 1) * (total_t + 10000))
        return math.floor(1000 * math.log(x))

    out, fit = [], []
    for i, text in documents:
        n_words, own = features(text)
        weight = sum(map(gain, own))
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((i, len(own), weight, score))
        if n_words >= least:
            fit.append((-score, i is None, i or 0, len(own), weight))
    drawn = len(fit) * percent // 100
    rank = {key: k for k, key in reversed(list(enumerate(sorted(fit)[:drawn], 1)))}
    return [(i, n, w, s, rank.get((-s, i is None, i or 0, n, w))) for i, n, w, s in out]


def as_rows(df):
    return sorted(map(str, (tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect())))


def test_whole_table_against_brute_force(docs, spark, odd, prose):
    table = [*odd, *((100 + k, " ".join(prose(5 + k, k)).upper()) for k in range(60))]
    table += [(300, "- , ."), (301, "a\x00b\x7fc É_é 中文 x9"), (302, "y" * 300 + " " + "z" * 90 + " a")]
    items = [(1, " ".join(prose(40, 3))), (2, None), (3, "")]
    target = spark.createDataFrame([(*i, 7) for i in items], "item_id long, text string, weight long")
    got = resample(docs(*table).repartition(3), target, percent=50)
    assert as_rows(got) == sorted(map(str, brute(table, [t for _, t in items], 50)))
    assert sum(r.rank is not None for r in got.collect()) > 10


def test_buckets_of_a_batch_do_not_cross_documents():
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["ab", "É", "q" * 70, "x" * 65, "7"]) for _ in range(rng.randrange(5))) for _ in range(200)]
    bucket, doc, n_words = batch_features([t.encode() for t in texts], 10000)
    for k, text in enumerate(texts):
        want = features(text)
        assert n_words[k] == want[0] and sorted(bucket[doc == k]) == sorted(want[1])
    bucket, doc, n_words = batch_features([], 10000)
    assert len(bucket) == len(doc) == len(n_words) == 0
    assert [len(x) for x in batch_features([None, b""], 10000)] == [0, 0, 2]


def test_crc_of_joined_parts():
    for n in (0, 1, 5, 64, 65, 1000):
        tail = b"z" * n
        got = shifted(np.array([zlib.crc32(b"head")], np.uint32), np.array([n])) ^ np.uint32(zlib.crc32(tail))
        assert int(got[0]) == zlib.crc32(b"head" + tail)


def test_ties_and_hot_scores_are_numbered_over_all_parts(spark):
    rows = [(k, 1, 1, 1, 5) for k in range(300)] + [(k, 1, 1, 1, k) for k in range(10)]
    frame = spark.createDataFrame(rows, "doc_id long, n_words long, n_features long, weight long, score long")
    got = [(r.score, r.doc_id, r.rank) for r in numbered(frame, "ties").collect()]
    want = sorted(((s, i) for i, _, _, _, s in rows), key=lambda x: (-x[0], x[1]))
    assert sorted(got, key=lambda x: x[2]) == [(s, i, k) for k, (s, i) in enumerate(want, 1)]


def test_empty_tables(docs, spark):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert resample(docs(), empty).count() == 0
    got = resample(docs((1, "one two")), empty, least_words=0, percent=100).collect()
    assert [(r.doc_id, r.n_features, r.rank) for r in got] == [(1, 3, 1)]
    assert importance.BUCKETS == 10_000
