"""Hosts, rules, segmentation and naive Bayes."""

import math

from tests.conftest import rows
from tripweave.llm.url_filter import judge_urls, viterbi

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def pages(spark, *urls):
    return spark.createDataFrame(
        [(i, u, "<title>Free Spam farm words blog</title>", "h") for i, u in enumerate(urls)],
        "page_id long, url string, html string, host string",
    )


def test_rules_hosts_and_paths(spark):
    df = pages(
        spark, None, "no scheme", "http://A.Example.NET/en/x?q#f", "https://example.net", "http://notexample.com/de/1",
        "http://example.com/de/1", "http://x.example.com/DE/", "http://x.org/fr/?a=b", "http://y.net/a#b", "x://net/y://z",
    )
    got = {r.page_id: (r.host, r.path, r.rule) for r in judge_urls(df, RULES).collect()}
    assert got == {
        0: ("", "", None), 1: ("", "", None), 2: ("a.example.net", "/en/x", "example.net/en/"),
        3: ("example.net", "", None), 4: ("notexample.com", "/de/1", None), 5: ("example.com", "/de/1", "example.com/de/"),
        6: ("x.example.com", "/DE/", None), 7: ("x.org", "/fr/", "org/fr/"), 8: ("y.net", "/a", "net/"), 9: ("net", "/y://z", "net/"),
    }


def test_verdicts_follow_words_inside_names(spark):
    urls = [f"http://spam-farm{i}.example.com/a" for i in range(20)] + [f"http://blog{i}.example.org/fr/a" for i in range(20)]
    urls += ["http://farmspam.example.com/a", "http://blogwords.example.org/a"]
    got = judge_urls(pages(spark, *urls), RULES).collect()
    verdict = {r.host: (r.verdict, r.host_words) for r in got}
    assert verdict["farmspam.example.com"][0] == "block" and "spam" in verdict["farmspam.example.com"][1]
    assert verdict["blogwords.example.org"][0] == "allow"


def test_viterbi_is_the_best_of_all_splits():
    counts = {"the": 50, "rapist": 5, "therapist": 30, "he": 20, "t": 2, "ra": 1}

    def p(word):
        return math.log(counts[word] / 200) if word in counts else -math.log(200) - len(word) * math.log(10)

    def splits(text):
        if not text:
            return [[]]
        return [[text[:k], *rest] for k in range(1, len(text) + 1) for rest in splits(text[k:])]

    for text in ("therapist", "thera", "xthe", "t", ""):
        best = max(sum(map(p, s)) for s in splits(text))
        assert abs(sum(map(p, viterbi(text, counts, 200))) - best) < 1e-9


def test_same_with_other_partitions_and_empty(spark):
    df = pages(spark, *[f"http://w{i % 5}.example.com/{i}" for i in range(50)])
    assert rows(judge_urls(df, RULES), "page_id", "verdict") == rows(judge_urls(df.repartition(7), RULES), "page_id", "verdict")
    assert judge_urls(pages(spark), RULES).count() == 0


def test_clean_hosts_on_a_ruled_domain_stay_allowed(spark):
    names = [f"garden{k}" for k in "abcdefgh"]
    ruled = [f"http://{n}.example.com/de/{k}" for n in names for k in range(5)] + [f"http://{n}.example.org/fr/{k}" for n in names for k in range(5)]
    ruled += [f"http://{n}.other.net/x/{k}" for n in names for k in range(9)]
    clean = [f"http://{n}.example.com/{p}/{k}" for n in names for p in ("en", "es") for k in range(2)] + ["http://example.com", "http://rare-unseen.example.com/once"]
    bad = [f"http://casino-{n}.example.{d}/en/1" for n in names for d in ("com", "org")]
    got = {r.host + r.path: r.verdict for r in judge_urls(pages(spark, *ruled, *clean, *bad), RULES).collect() if r.rule is None}
    assert {u: got[u[7:]] for u in clean} == dict.fromkeys(clean, "allow")
    assert {u: got[u[7:]] for u in bad} == dict.fromkeys(bad, "block")
