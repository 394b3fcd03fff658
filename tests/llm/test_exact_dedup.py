"""Streaming exact dedup against a dictionary of texts."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from tests.conftest import rows
from tripweave.llm.exact_dedup import dedup_stage, exact_duplicates


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def expected(table):
    groups = defaultdict(list)
    for i, text in table:
        groups[lower(text)].append(i)
    out = []
    for i, text in table:
        same = groups[lower(text)]
        keep = max((x for x in same if x is not None), default=None)
        out.append((i, keep, len(same), i == keep, hashlib.sha256(lower(text).encode()).hexdigest()))
    return sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("digest", [None, lambda sha: F.substring(sha, 1, 1)])
def test_groups_by_whole_text_even_where_digests_collide(docs, odd, digest):
    table = odd + [(i, f"text {i % 7}") for i in range(20, 60)]
    found = exact_duplicates(docs(*table), digest=digest)
    assert rows(found, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == expected(table)


def test_later_batches_meet_the_state_of_earlier_ones(docs):
    table = [(i, f"text {i % 3}") for i in range(30)]
    found = exact_duplicates(docs(*table).repartition(6), bytes_per_batch=1)
    assert rows(found) == expected(table)


def test_empty_table_and_stage(docs, odd):
    assert exact_duplicates(docs()).count() == 0
    given = docs(*odd)
    kept = dedup_stage(given)
    assert kept.columns == given.columns
    assert {r[0] for r in kept.select("doc_id").collect()} == {2, 3, 5, 6, 7, 8, 9, None}
