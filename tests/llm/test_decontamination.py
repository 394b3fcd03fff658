"""Size-partitioned MinHash containment against counting all shingles."""

import random

from tests.conftest import rows
from tripweave.llm.common import stored
from tripweave.llm.decontamination import (
    candidates,
    contained_items,
    decontamination_stage,
    item_shingles,
    signatures,
)


def shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {b" ".join(w)} if w else set()


def tables(docs, spark, odd, prose):
    items = [(1, " ".join(prose(30, 1))), (2, " ".join(prose(120, 2))), (3, "two words"), (4, None), (5, ""), (6, " ".join(prose(30, 1)))]
    body = lambda seed, n=3000: " ".join(prose(n, seed, 9000))
    edited = prose(30, 1)
    edited[0] = "other"
    broken = prose(30, 1)
    broken[10] = broken[20] = "other"
    table = [r for r in odd if r[0] is not None] + [
        (20, f"{body(5)} {' '.join(prose(30, 1)).upper()}\n{body(6)}"),
        (21, f"{body(7)} {' '.join(edited)} {body(8)}"),
        (22, f"{body(9)} {' '.join(broken)} {body(10)}"),
        (23, f"{body(11)} {' '.join(prose(120, 2))}"),
        (24, body(12, 20_000)),
        (25, " ".join(prose(25, 1))),
    ]
    return table, items, spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, doc_id long")


def test_pairs_by_exact_containment(docs, spark, odd, prose):
    table, items, frame = tables(docs, spark, odd, prose)
    want = []
    for d, text in dict(table).items():
        for i, item in items:
            a, b = shingles(item), shingles(text)
            if a and len(a & b) >= 0.8 * len(a):
                want.append((d, i, len(a), len(a & b)))
    got = contained_items(docs(*table), frame)
    assert rows(got, "doc_id", "item_id", "item_shingles", "shared_shingles") == sorted(want, key=lambda r: [(False, str(v)) for v in r])
    kept = decontamination_stage(docs(*table), frame)
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in table} - {w[0] for w in want}


def test_a_full_filter_gives_the_same_pairs(docs, spark, odd, prose):
    table, _, frame = tables(docs, spark, odd, prose)
    assert rows(contained_items(docs(*table), frame, most_bits=64)) == rows(contained_items(docs(*table), frame))


def test_empty_tables(docs, spark):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert contained_items(docs((1, "a b c d e f")), empty).count() == 0
    assert contained_items(docs(), empty).count() == 0


def test_items_of_few_words_in_long_documents(docs, spark, prose):
    items = [(n, " ".join(f"item{n}x{k}" for k in range(n))) for n in (5, 6, 7)]
    frame = spark.createDataFrame(items, "item_id long, text string")
    table, want = [], set()
    for k in range(300):
        n, item = items[k % 3]
        body = prose(400, 100 + k, 9000)
        table.append((k, " ".join([*body[:200], item, *body[200:]])))
        want.add((k, n, n - 4, n - 4))
    got = contained_items(docs(*table), frame).select("doc_id", "item_id", "item_shingles", "shared_shingles")
    assert {tuple(r) for r in got.collect()} == want
    assert decontamination_stage(docs(*table, (300, " ".join(prose(400, 1)))), frame).count() == 1


def test_repeated_item_rows_count_once(docs, spark, prose):
    words = prose(30, 1, 9000)
    whole, half = " ".join(words), " ".join(words[:17])
    items = [(1, whole), (1, whole), (2, "a b c d e f"), (2, "f e d c b a"), (None, "g h i j k l"), (None, "l k j i h g"), (None, "l k j i h g")]
    frame = spark.createDataFrame(items, "item_id long, text string").repartition(5)
    table = [(1, half), (2, f"x {whole} y"), (3, "a b c d e f"), (4, "a b c d e f e d c b a"), (5, "g h i j k l"), (6, "l k j i h g x")]
    got = contained_items(docs(*table), frame).select("doc_id", "item_id", "item_shingles", "shared_shingles")
    assert sorted(map(tuple, got.collect())) == [(2, 1, 26, 26), (4, 2, 4, 4), (5, None, 2, 2), (6, None, 2, 2)]
    assert {r.doc_id for r in decontamination_stage(docs(*table), frame).collect()} == {1, 3}


def test_no_pair_at_the_threshold_is_missed_at_any_size(docs, spark, prose):
    """Documents that lack as many shingles as allowed, or one more, chosen at random, by item size."""
    rng = random.Random(3)
    items, table, want = [], [], set()
    for n in (*range(1, 20), 31, 32, 33, 47, 64, 65, 100):
        words = [f"i{n}x{k}" for k in range(n + 4)]
        items.append((n, " ".join(words)))
        runs = [" ".join(words[k : k + 5]) for k in range(n)]
        least = next(s for s in range(n + 1) if s >= 0.8 * n)
        for extra, times in ((0, 4), (-1, 2)):
            for _ in range(times if least + extra > 0 else 0):
                kept = rng.sample(runs, least + extra)  # apart, so that no other shingle arises
                i = len(table)
                table.append((i, " . ".join([*kept, " ".join(prose(60, i, 9000))])))
                if extra == 0:
                    want.add((i, n, n, least))
    frame = spark.createDataFrame(items, "item_id long, text string")
    for spare in (1, 3, 1000):
        got = contained_items(docs(*table), frame, spare=spare)
        assert {tuple(r)[:4] for r in got.collect()} == want


def test_runs_that_items_share_do_not_make_candidates(docs, spark):
    common = "which of the following is true"
    items = [(i, f"{common} " + " ".join(f"own{i}w{k}" for k in range(12))) for i in range(30)]
    frame = spark.createDataFrame(items, "item_id long, text string")
    table = [(k, f"text {k} {common} indeed") for k in range(40)] + [(99, items[7][1])]
    wanted = stored(item_shingles(frame, "item_id", "text"), "wanted")
    index = signatures(wanted, 0.8, 3)
    assert index.groupBy("key").count().agg({"count": "max"}).first()[0] < 13
    shared = [" ".join(common.split()[k : k + 5]) for k in range(2)]
    hits = spark.createDataFrame([(k, s.encode()) for k, _ in table[:40] for s in shared], "doc_id long, shingle binary")
    assert candidates(hits, index).count() == 0
    assert [tuple(r)[:4] for r in contained_items(docs(*table), frame).collect()] == [(99, 7, 14, 14)]
