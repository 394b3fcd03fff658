"""Alignment against all pairs of overlapping byte ranges, and counts of links against plain counting."""

import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tests.llm.test_bpe import odd_texts
from tripweave.llm.alignment import Pair, align, align_texts, link_counts, pair_counts
from tripweave.llm.common import stored

PATHS = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]


@pytest.fixture(scope="module")
def pair():
    return Pair(open(PATHS[0], encoding="utf-8").read(), open(PATHS[1], "rb").read())


def brute(ends_a, ends_b):
    """Groups as lists of token positions, and all pairs with overlapping ranges."""
    cuts = [0, *sorted(set(ends_a) & set(ends_b))]
    groups = [
        ([k for k, e in enumerate(ends_a) if x < e <= y], [k for k, e in enumerate(ends_b) if x < e <= y])
        for x, y in zip(cuts, cuts[1:])
    ]
    starts_a, starts_b = [0, *ends_a[:-1]], [0, *ends_b[:-1]]
    links = {
        (i, j)
        for i in range(len(ends_a))
        for j in range(len(ends_b))
        if max(starts_a[i], starts_b[j]) < min(ends_a[i], ends_b[j])
    }
    return groups, links


def packed(ends):
    return np.array(ends, np.int32).tobytes()


def unfolded(groups):
    out = []
    for i, j, n, m, count in groups:
        assert count == 1 or count == n == m
        if count == 1:
            out.append((list(range(i, i + n)), list(range(j, j + m))))
        else:
            out.extend(([i + k], [j + k]) for k in range(n))
    return out


def test_groups_and_links_of_random_ends():
    rng = random.Random(5)
    for case in range(400):
        size = rng.randrange(1, 120)
        common = rng.random()
        ends_a, ends_b = (
            sorted({size, *(e for e in range(1, size) if rng.random() < share)})
            for share in (rng.random(), rng.random())
        )
        if case % 2:  # long one-to-one runs with a few differences
            ends_b = sorted({size, *(e for e in ends_a if rng.random() < 0.5 + common / 2)})
        groups, links_a, links_b = align(packed(ends_a), packed(ends_b))
        want, pairs = brute(ends_a, ends_b)
        assert unfolded(groups) == want
        assert len(links_a) == len(pairs) and set(zip(links_a, links_b)) == pairs
    assert align(b"", b"") == ([], [], [])


def test_a_long_run_is_one_entry():
    ends = list(range(1, 5001))
    groups, links_a, _ = align(packed(ends), packed(ends[:2500] + ends[2501:]))
    assert groups == [(0, 0, 2500, 2500, 2500), (2500, 2500, 2, 1, 1), (2502, 2501, 2498, 2498, 2498)]
    assert len(links_a) == 5000


def test_links_of_runs_are_not_listed_token_by_token(pair):
    """A document's runs become text and links as whole arrays; the walk lists irregular groups only."""
    ends = list(range(1, 5001))
    groups, links_a, links_b = align(packed(ends), packed(ends[:2500] + ends[2501:]), of_runs=False)
    assert len(groups) == 3 and (links_a, links_b) == ([2500, 2501], [2500, 2500])
    for text in [*filter(None, odd_texts()[::9]), "x", "plain words in a row", "naïve 東京 \t\t 12345  67"]:
        ((a, b),) = pair.encode([text])
        if len(a) == 0:
            continue
        wanted, links = brute(*(np.cumsum(s[x]).tolist() for s, x in zip(pair.sizes, (a, b))))
        told, n_groups, linked_a, linked_b = pair.document(a, b)
        assert told == ";".join("|".join(",".join(str(x[k]) for k in ks) for x, ks in zip((a, b), g)) for g in wanted)
        assert n_groups == len(wanted)
        assert Counter(zip(linked_a.tolist(), linked_b.tolist())) == Counter((int(a[i]), int(b[j])) for i, j in links)


def expected(pair, table):
    """Rows of link_counts, by counting links in Python."""
    made, pairs = [], Counter()
    for i, text in table:
        ids_a = pair.a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = pair.b.encode(text) if text else []
        want = b" " + (text or "").encode()
        if any(b"".join(t[k] for k in ids) != want for t, ids in ((pair.bytes_a, ids_a), (pair.bytes_b, ids_b))):
            ids_a, ids_b = [], []
        ends = [np.cumsum([len(t[k]) for k in ids]).tolist() for t, ids in ((pair.bytes_a, ids_a), (pair.bytes_b, ids_b))]
        groups, links = brute(*ends) if ids_a else ([], set())
        links = Counter((ids_a[x], ids_b[y]) for x, y in links)
        told = ";".join("|".join(",".join(str(ids[k]) for k in ks) for ids, ks in zip((ids_a, ids_b), g)) for g in groups)
        made.append((i, len(ids_a), len(ids_b), len(groups), links, told))
        pairs.update(links.keys())
    most = defaultdict(int)
    for (a, _), n in pairs.items():
        most[a] = max(most[a], n)
    return [
        (i, n_a, n_b, n_groups, links.total(), told,
         sum(n for p, n in links.items() if pairs[p] == most[p[0]]), sum(n * pairs[p] for p, n in links.items()))
        for i, n_a, n_b, n_groups, links, told in made
    ]


def test_chunks_give_the_ids_of_whole_texts(pair, monkeypatch):
    texts = [t for t in odd_texts() if t] + ["a b  c d \n e", " x", "x ", " ", "one two", "\x1c y", "<s> z"] * 2
    for limit in (10**6, 0):
        monkeypatch.setattr("tripweave.llm.alignment.POOL_CHARACTERS", limit)
        monkeypatch.setattr("tripweave.llm.alignment.JOINED", 7)
        for text, (a, b) in zip(texts, pair.encode(texts)):
            whole = pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)
            want = b" " + text.encode()
            if any(b"".join(map(t.__getitem__, x)) != want for t, x in zip(pair.bytes_of, whole)):
                whole = [], []
            assert (a.tolist(), b.tolist()) == tuple(whole), repr(text)


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum")


def test_texts_of_a_batch_are_encoded_in_slices(pair):
    """What is held at once follows a slice, not the batch; ids are those of each text alone."""
    rng = random.Random(9)
    words = [f"w{k}" for k in range(300)]
    texts = [" ".join(rng.choices(words, k=3000)) for _ in range(200)]
    alone = [[x.tolist() for x in next(pair.encode([t]))] for t in texts[::20]]
    tracemalloc.start()
    found = pair.encode(texts)
    some = [[x.tolist() for x in ids] for k, ids in enumerate(found) if k % 20 == 0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert some == alone and peak < 30e6


def test_whole_table_against_brute_force(docs, spark, odd, prose, pair):
    table = [(i, t if t is None else t[:3000]) for i, t in odd]
    table += [(100 + k, t) for k, t in enumerate(odd_texts()[::12])]
    table += [(200, "▁ is not a blank"), (201, "<s> </s> <|endoftext|> <0x41>"), (202, "  two  blanks "), (202, "\x00")]
    table += [(300 + k, " ".join(prose(30, k % 3))) for k in range(12)]
    got = link_counts(stored(align_texts(docs(*table).repartition(3), *PATHS), "aligned"), keep=("groups",))
    assert sorted(map(str, (tuple(r) for r in got.select(*COLUMNS).collect()))) == sorted(map(str, expected(pair, table)))


def test_texts_that_are_not_given_back_have_no_tokens(docs, pair):
    (row,) = align_texts(docs((1, "x▁y")), *PATHS).collect()
    assert (row.n_a, row.n_b, row.n_groups, row.n_links, row.groups) == (0, 0, 0, 0, "")


def test_pairs_are_counted_once_a_document(docs):
    aligned = stored(align_texts(docs((1, "a a a a"), (2, "a"), (3, None)).repartition(2), *PATHS), "aligned")
    assert max(r.n for r in pair_counts(aligned).collect()) == 2


def test_empty_table(docs):
    aligned = stored(align_texts(docs(), *PATHS), "aligned")
    assert link_counts(aligned).count() == 0
