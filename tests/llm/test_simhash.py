"""Fingerprints and components against all pairs on small tables."""

import re

import numpy as np
import xxhash
from tests.conftest import rows
from tripweave.llm.common import components
from tripweave.llm.simhash import bucket_links, block_masks, dedup_stage, near_duplicates, references


def fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def roots(links, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_by_all_pairs(docs, odd, prose):
    table = [r for r in odd if r[0] is not None]
    for i in range(40):
        words = prose(60, i // 4)
        for k in range(i % 4):
            words[(7 * k + i) % 60] = f"changed{i}"
        table.append((100 + i, " ".join(words)))
    prints = {i: fingerprint(t) for i, t in table}
    near = [(a, b) for a in prints for b in prints if a < b and bin(prints[a] ^ prints[b]).count("1") <= 3]
    root = roots(near, prints)
    got = near_duplicates(docs(*table, (None, "null id")))
    assert got.count() == len(table) + 1
    got = {tuple(r) for r in got.where("doc_id is not null").collect()}
    assert got == {(i, f"{prints[i]:016x}", root[i]) for i in prints}
    kept = dedup_stage(docs(*table))
    assert {r.doc_id for r in kept.collect()} == set(root.values())
    assert near_duplicates(docs()).count() == 0


def test_blocks_meet_and_buckets_link_exactly():
    rng = np.random.default_rng(1)
    masks = block_masks(3)
    for _ in range(200):
        x = int(rng.integers(0, 2**63))
        y = x
        for b in rng.choice(64, 3, replace=False):
            y ^= 1 << int(b)
        assert any(x & m == y & m for m in masks)
    f = np.array([int(rng.integers(0, 16)) << 3 for _ in range(60)], np.uint64)
    f[:30] ^= np.uint64(0xFFFF << 40)
    near = [(a, b) for a in range(60) for b in range(a) if bin(int(f[a]) ^ int(f[b])).count("1") <= 3]
    want, got = roots(near, range(60)), bucket_links(f, 3, references())
    assert all((want[a] == want[b]) == (got[a] == got[b]) for a in range(60) for b in range(60))


def test_components_of_chains_stars_and_cycles(frame):
    links = [(i, i + 1) for i in range(1, 30)] + [(100, i) for i in range(101, 120)] + [(7, 7), (200, 201), (201, 202), (202, 200), (1, 2)]
    got = dict(rows(components(frame("a long, b long", *links))))
    want = {n: r for n, r in roots(links, {x for p in links for x in p}).items() if n != r}
    assert got == want
