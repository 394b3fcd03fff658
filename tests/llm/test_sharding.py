"""Jump hashing against the published loop, and the law of growing shards."""

import zlib

from pyspark.sql import functions as F
from tripweave.llm.sharding import assign_shards, jump_shard


def published(key, shards):
    b, j, key = -1, 0, key % 2**64
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_same_shards_as_the_published_algorithm(spark):
    keys = [0, 1, 2, -1, 2**63 - 1, -(2**63), 10**12, *range(100, 160)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for shards in (1, 2, 8, 33):
        got = df.select("k", jump_shard(F.col("k"), shards).alias("s")).collect()
        assert all(s == published(k, shards) for k, s in got)


def test_shards_slots_and_growth(docs, odd):
    table = odd + [(i, f"text {i}") for i in range(100, 600)]
    got = assign_shards(docs(*table), 8, buckets=16).collect()
    assert len(got) == len(table)
    by_shard = {}
    for r in got:
        key = r.doc_id or 0
        assert r.shard == published(key, 8) and r.law == "key"
        assert r.grown_shard == published(key, 9) and r.grown_shard in (r.shard, 8)
        by_shard.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(slots) == list(range(len(slots))) for slots in by_shard.values())
    crc = {(i, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for i, t in table}
    assert {(r.doc_id, r.text_crc32, r.size) for r in got} == crc


def test_empty_table(docs):
    assert assign_shards(docs(), 8).count() == 0


def test_a_hot_key_is_spread_over_tasks(docs, spark):
    table = [(None, f"text {i}") for i in range(4000)] + [(None, None)] * 20_000
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    try:
        got = assign_shards(docs(*table), 8).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset(name)
    assert sorted(r.slot for r in got) == list(range(len(table)))
    for own in ([r.task for r in got if r.size > 1], [r.task for r in got if r.size == 1]):
        assert max(own.count(t) for t in set(own)) < 0.9 * len(own)
