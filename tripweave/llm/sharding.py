"""Shards by jump consistent hashing: key and number of shards decide, without a ring table.

Adding a shard moves rows only into the new one, about one row of n + 1. The 64-bit generator of
the published algorithm is kept: key = key * 2862933555777941757 + 1 (mod 2^64), jump =
floor((b + 1) * 2^31 / ((key >> 33) + 1)). Spark's arithmetic raises on overflow, so the generator
works on two 32-bit halves.

A null key belongs to the shard of key 0. A null text has no bytes. Rows that repeat a key share its
shard. Slots number the rows of a shard from 0 without gaps: rows are dealt to buckets by key, size
and crc together, numbered inside a bucket, and start at the bucket's offset, so no task sorts a whole
shard or all rows of a hot key. Rows equal in all three are counted before they are dealt, numbered as
one and written out again in runs of RUN slots that are dealt anew, so they meet in no task either. An
empty table gives an empty result; other columns are neither read nor returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripweave.llm.common import stored

FACTOR = 2862933555777941757
HALF = 0xFFFFFFFF
RUN = 4096


def _step(high: Column, low: Column) -> tuple[Column, Column]:
    """Halves of key * FACTOR + 1 (mod 2^64) from the halves of key; no product passes 2^63."""
    factor_high, factor_low = FACTOR >> 32, FACTOR & HALF
    upper, lower = factor_low >> 16, factor_low & 0xFFFF

    def halves(x: Column) -> tuple[Column, Column]:
        """Upper and lower 32 bits of x * factor_low."""
        left, right = x * F.lit(upper), x * F.lit(lower)
        total = right + F.shiftleft(left.bitwiseAND(F.lit(0xFFFF)), 16)
        return F.shiftright(total, 32) + F.shiftright(left, 16), total.bitwiseAND(F.lit(HALF))

    carried, new_low = halves(low)
    new_low = new_low + F.lit(1)
    carried = carried + F.shiftright(new_low, 32)
    new_high = carried + halves(high)[1] + (low * F.lit(factor_high)).bitwiseAND(F.lit(HALF))
    return new_high.bitwiseAND(F.lit(HALF)), new_low.bitwiseAND(F.lit(HALF))


def jump_shard(key: Column, shards: int) -> Column:
    """Shard 0 to shards - 1 of a 64-bit key; at most `shards` jumps, as each goes further."""
    if shards < 1:
        raise ValueError("at least one shard")
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    start = F.struct(
        F.shiftright(key, 32).bitwiseAND(F.lit(HALF)).alias("high"),
        key.bitwiseAND(F.lit(HALF)).alias("low"),
        F.lit(-1).cast("long").alias("b"),
        F.lit(0).cast("long").alias("j"),
    )

    def jump(state: Column, _: Column) -> Column:
        high, low = _step(state["high"], state["low"])
        further = F.floor(
            (state["j"] + 1) * (F.lit(float(1 << 31)) / (F.shiftright(high, 1) + 1).cast("double"))
        )
        moved = F.struct(
            high.alias("high"), low.alias("low"), state["j"].alias("b"), further.alias("j")
        )
        return F.when(state["j"] < shards, moved).otherwise(state)

    steps = F.array(*[F.lit(i) for i in range(shards)])
    return F.aggregate(steps, start, jump, lambda state: state["b"].cast("int"))


def assign_shards(
    rows: DataFrame,
    shards: int,
    key_column: str = "doc_id",
    text_column: str = "text",
    buckets: int = 1024,
) -> DataFrame:
    """key, size, text_crc32, law, shard, slot, grown_shard for every row.

    buckets: how many parts a shard is numbered in. Their offsets (shards * buckets rows at most)
    are the only thing broadcast.
    """
    key, text = F.col(key_column).cast("long"), F.coalesce(F.col(text_column), F.lit(""))
    equal = rows.select(
        key.alias("key"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    equal = equal.groupBy("key", "size", "text_crc32").agg(F.count("*").alias("times"))
    bucket = F.pmod(F.xxhash64("key", "size", "text_crc32"), F.lit(buckets))
    placed = equal.withColumns(
        {
            "shard": jump_shard(F.col("key"), shards),
            "bucket": bucket,
            "grown_shard": jump_shard(F.col("key"), shards + 1),
        }
    )
    placed = stored(placed, "shard-rows")
    counts = placed.groupBy("shard", "bucket").agg(F.sum("times").alias("count"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.col("shard").alias("s"),
        F.col("bucket").alias("k"),
        F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"),
    )
    inside = (
        Window.partitionBy("shard", "bucket")
        .orderBy("key", "size", "text_crc32")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    numbered = placed.withColumn("n", F.coalesce(F.sum("times").over(inside), F.lit(0)))
    slotted = numbered.join(
        F.broadcast(offsets), (F.col("shard") == F.col("s")) & (F.col("bucket") == F.col("k"))
    )
    first = F.col("n") + F.col("offset")
    end = first + F.col("times")
    runs = slotted.select(
        "key", "size", "text_crc32", "shard", "grown_shard", end.alias("end"),
        F.explode(F.sequence(first, end - 1, F.lit(RUN).cast("long"))).alias("start"),
    ).repartition("shard", "start")
    last = F.least(F.col("start") + RUN, F.col("end")) - 1
    return runs.select(
        F.col("key").alias(key_column),
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        F.explode(F.sequence("start", last)).alias("slot"),
        "grown_shard",
    )
