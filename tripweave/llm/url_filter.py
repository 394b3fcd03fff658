"""URL filters: rules first, then naive Bayes over host words found by Viterbi segmentation.

The host is what follows the first `://` up to `/`, `?`, `#` or the end, with A-Z lower-cased; the
path goes on up to `?`, `#` or the end. A null url, or one without `://`, has an empty host and path.
A rule (verdict, host, path) fits its host and all subdomains if the path starts with the rule's; the
longest rule wins, of equal ones the one given first.

Words: a unigram model counts the words of all pages' titles and the parts of hosts between hyphens.
Each distinct label of a host meets the counts of its own substrings in a join, and Viterbi takes the
most likely split; an unknown string of n characters has the probability 1 / (N * 10^n).

Scores: multinomial naive Bayes over the words of host and path (numbers count as one word), hashed to
`buckets`, learned from all pages: those that a rule decides as it says, of the others those whose
host holds a word of `blocked_words` as blocked and all the rest as allowed. What the rules test is no
feature: the last labels of a host as long as they are labels of rules' hosts, and the first parts of a
path, as many as a rule for that host tests. Otherwise the scores would repeat the domain. The prior is
that of the pages without a rule, as only they are judged. Each bucket has one count more, dealt to
blocked and allowed as all words are, so that words never seen speak for neither. The table of log
odds (buckets numbers) and the total count of words are the only things that reach the driver. A page
is blocked if its odds are above 0.

Without any page to learn from, nothing is blocked. Rows may repeat and are judged alike. An empty
table gives an empty result; other columns are neither read nor returned.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripweave.llm.common import bounded_batches, stored

Rule = tuple[str, str, str]
BLOCKED_WORDS = ("ads", "adult", "casino", "malware", "phishing", "porn", "spam", "warez", "xxx")
LONGEST_WORD = 20
NUMBER = "#"


def host_and_path(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host, path = (F.coalesce(F.regexp_extract(url, pattern, k), F.lit("")) for k in (1, 2))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def matched_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """(verdict, rule) of the longest rule that fits, else nulls."""
    out = F.struct(F.lit(None).cast("string").alias("verdict"), F.lit(None).cast("string").alias("rule"))
    for verdict, name, start in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        out = F.when(
            fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(name + start).alias("rule"))
        ).otherwise(out)
    return out


def word_counts(pages: DataFrame, hosts: DataFrame, html_column: str) -> DataFrame:
    """word, count over all titles and over the parts of distinct hosts that hyphens separate."""
    title = F.regexp_extract(F.coalesce(F.col(html_column), F.lit("")), r"(?is)<title>(.*?)</title>", 1)
    titles = pages.select(F.explode(F.split(F.lower(title), "[^a-z]+")).alias("word"))
    labels = hosts.select(F.explode(F.split("host", r"\.")).alias("label")).where(
        F.col("label").contains("-")
    )
    parts = labels.select(F.explode(F.split("label", "-")).alias("word"))
    words = titles.unionByName(parts).where((F.col("word") != ""))
    return words.groupBy("word").agg(F.count("*").alias("count"))


def viterbi(text: str, counts: dict[str, int], total: int) -> list[str]:
    """The most likely words that make up the text; of equal splits the one with longer last words."""
    best, cut = [0.0], [0]
    for end in range(1, len(text) + 1):
        choices = []
        for start in range(max(0, end - LONGEST_WORD), end):
            word = text[start:end]
            count = counts.get(word)
            p = math.log(count / total) if count else -math.log(max(total, 1)) - len(word) * math.log(10)
            choices.append((best[start] + p, -start, start))
        value, _, start = max(choices)
        best.append(value)
        cut.append(start)
    words, end = [], len(text)
    while end:
        words.append(text[cut[end] : end])
        end = cut[end]
    return words[::-1]


def untested_host(host: Column, rules: Sequence[Rule], kept: Sequence[str]) -> Column:
    """The host without its last labels that are labels of rules' hosts, except the words kept."""
    names = sorted({label for _, name, _ in rules for label in name.split(".") if label} - set(kept))
    if not names:
        return host
    return F.regexp_replace(host, rf"(?:(?:^|\.)(?:{'|'.join(map(re.escape, names))}))+\.?$", "")


def untested_path(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The path without its first parts, as many as the rules for this host test."""
    tested = F.lit(0)
    for _, name, start in rules:
        fits = (host == name) | host.endswith(f".{name}")
        tested = F.greatest(tested, F.when(fits, len([x for x in start.split("/") if x])).otherwise(0))
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.array_join(F.slice(parts, tested + 1, F.greatest(F.size(parts), F.lit(1))), "/")


def segmented_hosts(hosts: DataFrame, counts: DataFrame, untested: Column) -> DataFrame:
    """host, its words, and those of its untested beginning.

    Labels meet only the counts of their own substrings.
    """
    labels = hosts.select("host", F.posexplode(F.split("host", r"[.\-_]+")).alias("place", "label"))
    distinct = labels.select("label").where("label <> ''").distinct()
    begins = distinct.select(
        "label", F.explode(F.sequence(F.lit(1), F.length("label"))).alias("begin")
    )
    spans = begins.select(
        "label",
        "begin",
        F.explode(
            F.sequence(
                F.lit(1),
                F.least(F.lit(LONGEST_WORD), F.length("label") - F.col("begin") + 1),
            )
        ).alias("size"),
    )
    words = spans.select("label", F.expr("substring(label, begin, size)").alias("word")).distinct()
    total = counts.agg(F.sum("count")).first()[0] or 1
    known = words.join(counts, "word").groupBy("label").agg(
        F.collect_list("word").alias("known"), F.collect_list("count").alias("counts")
    )

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                viterbi(label, dict(zip(words or (), counts or ())), total)
                for label, words, counts in zip(*(c.to_pylist() for c in batch.columns))
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(rows, pa.list_(pa.string()))], ["label", "words"]
            )

    cut = distinct.join(known, "label", "left").mapInArrow(split, "label string, words array<string>")
    gathered = labels.join(stored(cut, "url-labels"), "label").groupBy("host").agg(
        F.sort_array(F.collect_list(F.struct("place", "words"))).alias("places")
    )
    size = F.when(untested == "", 0).otherwise(F.size(F.split(untested, r"[.\-_]+")))
    begin = F.filter("places", lambda x: x["place"] < size)
    return gathered.select(
        "host",
        *[
            F.flatten(F.transform(places, lambda x: x["words"])).alias(name)
            for places, name in ((F.col("places"), "host_words"), (begin, "untested_words"))
        ],
    )


def path_words(path: Column) -> Column:
    words = F.filter(F.split(F.lower(path), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.when(w.rlike(r"^\p{N}+$"), NUMBER).otherwise(w))


def log_odds(tokens: DataFrame, buckets: int) -> np.ndarray:
    """Log odds of blocking by bucket, the prior last, from rows (bucket, blocked, ruled)."""
    counts = tokens.where("bucket >= 0").groupBy("bucket").agg(
        F.count_if("blocked").alias("yes"), F.count_if(~F.col("blocked")).alias("no")
    )
    yes, no = np.zeros(buckets), np.zeros(buckets)
    for bucket, y, n in counts.collect():  # at most `buckets` rows
        yes[bucket], no[bucket] = y, n
    prior = tokens.where("bucket < 0 and not ruled").agg(
        F.count_if("blocked"), F.count_if(~F.col("blocked"))
    ).first()
    if not sum(prior):
        return np.zeros(buckets + 1)
    odds, (y, n) = np.zeros(buckets), (yes.sum(), no.sum())
    if y and n:
        odds = np.log((yes + y / (y + n)) / y) - np.log((no + n / (y + n)) / n)
    return np.append(odds, math.log((prior[0] + 1) / (prior[1] + 1)))


def judge_urls(
    pages: DataFrame,
    rules: Sequence[Rule],
    blocked_words: Sequence[str] = BLOCKED_WORDS,
    buckets: int = 1 << 16,
    id_column: str = "page_id",
    url_column: str = "url",
    html_column: str = "html",
) -> DataFrame:
    """page_id, host, path, rule, verdict, host_words, log_odds of every page."""
    spark = pages.sparkSession
    bounded_batches(spark)
    host, path = host_and_path(F.col(url_column))
    parsed = pages.select(
        F.col(id_column).cast("long").alias("page_id"), host.alias("host"), path.alias("path")
    )
    hosts = stored(parsed.select("host").distinct(), "url-hosts")
    counts = stored(word_counts(pages, hosts, html_column), "url-words")
    words = stored(
        segmented_hosts(hosts, counts, untested_host(F.col("host"), rules, blocked_words)),
        "url-host-words",
    )
    rule = matched_rule(F.col("host"), F.col("path"), rules)
    none = F.array().cast("array<string>")  # hosts without a word
    words = words.withColumnRenamed("host_words", "found")
    joined = parsed.join(words, "host", "left").withColumn(
        "host_words", F.coalesce("found", none)
    ).select(
        "page_id",
        "host",
        "path",
        rule.alias("r"),
        "host_words",
        F.transform(
            F.concat(
                F.coalesce("untested_words", none),
                path_words(untested_path(F.col("host"), F.col("path"), rules)),
            ),
            lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"),
        ).alias("buckets"),
    )
    bad = F.arrays_overlap("host_words", F.array(*[F.lit(w) for w in blocked_words] or [F.lit("")]))
    taught = joined.select(
        F.coalesce(F.col("r.verdict") == "block", bad).alias("blocked"),
        F.col("r.verdict").isNotNull().alias("ruled"),
        F.explode(F.concat(F.col("buckets"), F.array(F.lit(-1)))).alias("bucket"),
    )
    shared = spark.sparkContext.broadcast(log_odds(taught, buckets))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odds = shared.value
        for batch in batches:
            lists = batch.column(6)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            sums = np.append(0.0, np.cumsum(odds[flat]))
            ends = np.cumsum(np.append(0, lists.value_lengths().to_numpy(zero_copy_only=False)))
            score = sums[ends[1:]] - sums[ends[:-1]] + odds[-1]
            given = batch.column(4).to_pylist()
            verdict = [g or ("block" if s > 0 else "allow") for g, s in zip(given, score)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(verdict, pa.string()), batch.column(5), pa.array(score)],
                ["page_id", "host", "path", "rule", "verdict", "host_words", "log_odds"],
            )

    return joined.select(
        "page_id", "host", "path", "r.rule", "r.verdict", "host_words", "buckets"
    ).mapInArrow(
        scored,
        "page_id long, host string, path string, rule string, verdict string, "
        "host_words array<string>, log_odds double",
    )
