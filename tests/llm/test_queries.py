"""Registered queries that SQL cannot express, on the smallest tables, against brute force."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tests.conftest import SMALLEST
from tests.llm.test_sharding import published
from tests.llm.test_simhash import fingerprint, roots
from tests.llm.test_substring_dedup import brute
from tokenizers import Tokenizer
from tripweave.llm import queries


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{SMALLEST}/documents.parquet").select("doc_id", "text", "lang").collect()
    return {r.doc_id: (r.text, r.lang) for r in rows}


def result(spark, name):
    return queries.queries()[name](spark, SMALLEST).collect()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def remainder(i, parts):
    return zlib.crc32(str(i).encode()) % parts


def test_op2(spark, texts):
    got = result(spark, "op2_jump_sharding")
    assert {(r.doc_id, r.size, r.text_crc32, r.law, r.shard, r.grown_shard) for r in got} == {
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "key", published(i, 8), published(i, 9))
        for i, (t, _) in texts.items()
    }


def test_op3(spark, texts):
    got = {tuple(r) for r in result(spark, "op3_substring_dedup")}
    table = [(i, t) for i, (t, _) in texts.items()]
    assert got == {(i, n, removed, sha(kept)) for i, n, removed, kept in brute(table, 13)}


def test_op4(spark, texts):
    prints = {i: fingerprint(t) for i, (t, _) in texts.items()}
    near = [(a, b) for a in prints for b in prints if a < b and bin(prints[a] ^ prints[b]).count("1") <= 3]
    root = roots(near, prints)
    got = {tuple(r) for r in result(spark, "op4_simhash_near_dedup")}
    assert got == {(i, f"{p:016x}", root[i]) for i, p in prints.items()}


def test_op5(spark, texts):
    tokens = {i: [*(t or "").encode().lower().split(), b" "] for i, (t, _) in texts.items()}
    c = Counter(w for i, ws in tokens.items() if remainder(i, 10) for w in ws)
    n, v = sum(c.values()), len(c)
    got = result(spark, "op5_lm_scoring")
    assert len(got) == len(texts)
    for r in got:
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens[r.doc_id])
        assert abs(r.base_score - base) < 1e-6 * abs(base) and r.score < 0
        assert r.held_out == (remainder(r.doc_id, 10) == 0) and r.train_tokens == n
        assert r.n_known == sum(c[w] > 0 for w in tokens[r.doc_id])
    held = [r for r in got if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_op6(spark, texts):
    got = result(spark, "op6_language_id")
    held = [r for r in got if r.held_out]
    assert len(got) == len(texts) and {r.doc_id for r in held} == {i for i in texts if remainder(i, 5) == 0}
    assert sum(r.lang_pred == texts[r.doc_id][1] for r in held) >= 0.9 * len(held)


def test_op8(spark):
    def judged(url):
        url = url or ""
        rest = url.split("://", 1)[1] if "://" in url else ""
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, rest = rest[:cut].lower(), rest[cut:]
        path = rest[: min((rest.find(c) for c in "?#" if c in rest), default=len(rest))]
        fits = [
            (len(h + p), h + p, v)
            for v, h, p in (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
            if ("." + host).endswith("." + h) and path.startswith(p)
        ]
        return host, path, *(max(fits)[1:] if fits else (None, None))

    urls = {r.page_id: r.url for r in spark.read.parquet(f"{SMALLEST}/pages.parquet").collect()}
    got = result(spark, "op8_url_filters")
    assert {r.page_id for r in got} == urls.keys()
    for r in got:
        host, path, rule, verdict = judged(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if r.log_odds > 0 else "allow"))


def test_op10(spark, texts):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.no_truncation()
    library.no_padding()
    want = set()
    for i, (t, _) in texts.items():
        ids = library.encode(t or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.add((i, len(ids), sha(",".join(map(str, ids))), sha(decoded)))
    assert {tuple(r) for r in result(spark, "op10_bpe")} == want


def test_op11(spark, texts):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.no_truncation()
    library.no_padding()
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    got = result(spark, "op11_token_counts")
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        text = texts[r.doc_id][0] or ""
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), count(text), count(text) > 512)
        assert count(text[: r.chars_within_limit]) <= 512
        assert r.chars_within_limit == len(text) or count(text[: r.chars_within_limit + 1]) > 512


def test_op12(spark, texts):
    from tests.llm.test_importance import as_rows
    from tests.llm.test_importance import brute as resampled

    target = [r.text for r in spark.read.parquet(f"{SMALLEST}/benchmark.parquet").collect()]
    got = queries.queries()["op12_importance_resampling"](spark, SMALLEST)
    assert as_rows(got) == sorted(map(str, resampled([(i, t) for i, (t, _) in texts.items()], target)))


def test_op13(spark, texts):
    from tests.llm.test_alignment import PATHS
    from tripweave.llm.alignment import Pair

    pair = Pair(open(PATHS[0], encoding="utf-8").read(), open(PATHS[1], "rb").read())
    made, counts = {}, Counter()
    for i, (text, _) in texts.items():
        ids = (pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)) if text else ([], [])
        ends = [np.cumsum([len(t[k]) for k in x]).astype(int) for t, x in zip((pair.bytes_a, pair.bytes_b), ids)]
        if any(b"".join(t[k] for k in x) != b" " + (text or "").encode() for t, x in zip((pair.bytes_a, pair.bytes_b), ids)):
            ids, ends = ([], []), [np.zeros(0, int)] * 2
        cuts = np.intersect1d(*ends)
        parts = [[",".join(map(str, p)) for p in np.split(x, np.searchsorted(e, cuts[:-1], "right"))] for x, e in zip(ids, ends)]
        told = ";".join(map("|".join, zip(*parts))) if len(cuts) else ""
        every = np.union1d(*ends)  # each piece between two ends lies in one token of A and one of B
        links = Counter(zip(*(np.array(x, int)[np.searchsorted(e, every)].tolist() for x, e in zip(ids, ends))))
        made[i] = (len(ids[0]), len(ids[1]), len(cuts), links, sha(told) if told else "")
        counts.update(links.keys())
    most = Counter()
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    got = result(spark, "op13_cross_tokenizer_alignment")
    assert {r.doc_id for r in got} == made.keys() and len(got) == len(made)
    for r in got:
        n_a, n_b, n_groups, links, digest = made[r.doc_id]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256) == (n_a, n_b, n_groups, links.total(), digest)
        assert r.n_best == sum(n for p, n in links.items() if counts[p] == most[p[0]])
        assert r.count_sum == sum(n * counts[p] for p, n in links.items())
