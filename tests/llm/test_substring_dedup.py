"""Repeated passages against a dictionary of all windows."""

import pytest
from tests.conftest import rows
from tripweave.llm import substring_dedup
from tripweave.llm.substring_dedup import remove_repeated


def brute(table, window):
    first, out = {}, []
    for i, text in sorted(r for r in table if r[0] is not None):
        w = (text or "").encode().split()
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), i)
    for i, text in table:
        w = (text or "").encode().split()
        covered = [False] * len(w)
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                covered[k : k + window] = [True] * window
        kept = b" ".join(x for x, c in zip(w, covered) if not c).decode()
        out.append((i, len(w), sum(covered), kept))
    return sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("crowded", [2_000, 2])
@pytest.mark.parametrize("phrases", [20_000, 1])
def test_removed_words(docs, odd, prose, monkeypatch, crowded, phrases):
    monkeypatch.setattr(substring_dedup, "DOCUMENTS_PER_PART", crowded)
    monkeypatch.setattr(substring_dedup, "PHRASES_PER_AUTOMATON", phrases)
    shared, own = prose(40, 1), lambda i: prose(30, 50 + i, 5000)
    table = list(odd)
    table += [(100 + i, " ".join(own(i) + shared[i % 9 : 25 + i % 15] + own(i + 500))) for i in range(40)]
    table += [(200, " ".join(["same"] * 60)), (201, " ".join(["same"] * 20)), (199, " ".join(["same"] * 12))]
    table += [(300, " ".join(shared) + "\n" + " ".join(shared)), (300, " ".join(shared) + "\n" + " ".join(shared))]
    got = remove_repeated(docs(*table))
    assert rows(got, "doc_id", "n_words", "n_removed", "kept_text") == brute(table, 13)


def test_empty_table(docs):
    assert remove_repeated(docs()).count() == 0
