"""Weighted statistics, quantiles and distributions from value frequencies.

Input is one row per (keys..., value) with the summed weight ``w`` and row count ``n``; a null
value holds the missing records. The running total is ordered by distinct values. To keep one
key with very many distinct values off a single task, it is computed in two levels: weight per
value range, then within each range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripweave.functions.expressions import zero
from tripweave.sources.lineage import cut_lineage

RANGES = 256
PERCENTILES = 100
ROUNDING = 1e-9


def running_weight(
    frequencies: DataFrame, keys: Sequence[str], ranges: int = RANGES
) -> DataFrame:
    """Valid values with the cumulative weight ``cum`` in value order and the total ``total``.

    Values are cut into ranges of about equally many distinct values per key; ``_base`` is the
    weight of earlier ranges, so the ordered window runs inside one range only. The cut points
    are approximate, which moves work between tasks but never changes a result; more ranges split
    a key over more tasks.
    """
    keys = list(keys)
    valid = frequencies.filter(F.col("value").isNotNull())
    cuts = F.lit([i / ranges for i in range(1, ranges)])
    spans = valid.groupBy(*keys).agg(
        F.max("value").alias("_hi"),
        F.sum("w").alias("total"),
        F.percentile_approx("value", cuts, F.lit(1000)).alias("_cuts"),
    )
    place = F.size(F.filter("_cuts", lambda cut: cut < F.col("value")))
    # Read twice below: the ranges' totals (at most `ranges` rows a key) and the values themselves.
    ranged = cut_lineage(valid.join(spans, keys).withColumn("_range", place).drop("_cuts"))
    per_range = ranged.groupBy(*keys, "_range").agg(F.sum("w").alias("_rw"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(
        Window.unboundedPreceding, -1
    )
    bases = per_range.select(*keys, "_range", zero(F.sum("_rw").over(before)).alias("_base"))
    within = (
        Window.partitionBy(*keys, "_range")
        .orderBy("value")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    running = F.col("_base") + F.sum("w").over(within)
    return ranged.join(bases, [*keys, "_range"]).select(
        *keys,
        "value",
        "w",
        "total",
        F.when(F.col("value") == F.col("_hi"), F.greatest(running, "total"))
        .otherwise(running)
        .alias("cum"),
    )


def weighted_quantile(frequencies: DataFrame, keys: Sequence[str], p: float) -> DataFrame:
    """Smallest value whose cumulative weight reaches ``p`` of the total, per key."""
    reached = running_weight(frequencies, keys).filter(
        (F.col("cum") >= F.col("total") * p) & (F.col("total") > 0)
    )
    return reached.groupBy(*keys).agg(F.min("value").alias("quantile"))


def weighted_statistics(frequencies: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Totals, mean, spread, range, median, mode, and zero and missing shares per key."""
    keys = list(keys)
    valid = F.col("value").isNotNull()
    value, w = F.col("value"), F.col("w")
    nonzero = valid & (value != 0)
    sums = frequencies.groupBy(*keys).agg(
        zero(F.sum("w")).alias("n_total"),
        zero(F.sum(F.when(valid, w))).alias("n_valid"),
        F.sum(F.when(valid, value * w)).alias("_vw"),
        F.sum(F.when(nonzero, value * w)).alias("_vw_nz"),
        zero(F.sum(F.when(nonzero, w))).alias("_w_nz"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.max(
            F.when(valid, F.struct(w.alias("w"), (-value).alias("neg")))
        ).alias("_heaviest"),
    )
    usable = F.col("n_valid") > 0
    means = sums.withColumn("mean", F.when(usable, F.col("_vw") / F.col("n_valid")))
    # Spread about the mean in a second pass over distinct values: no cancellation.
    deviation = F.when(valid, w * F.pow(value - F.col("mean"), F.lit(2.0)))
    spread = (
        frequencies.join(means.select(*keys, "mean"), keys)
        .groupBy(*keys)
        .agg(F.sum(deviation).alias("_ss"))
    )
    medians = weighted_quantile(frequencies, keys, 0.5).withColumnRenamed("quantile", "_median")
    joined = means.join(spread, keys, "left").join(medians, keys, "left")

    def when_valid(expr: Column) -> Column:
        return F.when(usable, expr)

    n_total, n_valid = F.col("n_total"), F.col("n_valid")
    return joined.select(
        *keys,
        "n_total",
        F.when(usable, n_valid).otherwise(0.0).alias("n_valid"),
        "mean",
        F.when(usable & (F.col("_w_nz") > 0), F.col("_vw_nz") / F.col("_w_nz")).alias(
            "mean_nonzero"
        ),
        when_valid(F.sqrt(F.col("_ss") / n_valid)).alias("std"),
        when_valid(F.col("min")).alias("min"),
        when_valid(F.col("max")).alias("max"),
        when_valid(F.col("_median")).alias("median"),
        when_valid(-F.col("_heaviest.neg")).alias("mode_value"),
        when_valid((n_valid - F.col("_w_nz")) / n_valid).alias("zero_share"),
        F.when(n_total != 0, (n_total - F.when(usable, n_valid).otherwise(0.0)) / n_total).alias(
            "missing_share"
        ),
    )


def weighted_ecdf(frequencies: DataFrame, keys: Sequence[str]) -> DataFrame:
    """101-point weighted distribution: for each percentile the smallest value reaching it.

    Each distinct value answers the percentiles its weight step covers, so no pairing of
    values with percentiles is needed.
    """
    keys = list(keys)
    running = running_weight(frequencies, keys).filter(F.col("total") > 0)
    grid = F.sequence(F.lit(0), F.lit(PERCENTILES))
    total, cum = F.col("total"), F.col("cum")
    # Slightly early, so rounding leaves no gap; the smallest candidate value wins below.
    start = cum - F.col("w") - total * ROUNDING

    def covered(index: Column) -> Column:
        threshold = total * (index / F.lit(float(PERCENTILES)))
        return (cum >= threshold) & (start < threshold)

    return running.select(
        *keys, "value", total.alias("n_valid"), F.explode(F.filter(grid, covered)).alias("_i")
    ).groupBy(*keys, "_i", "n_valid").agg(F.min("value").alias("value")).select(
        *keys,
        (F.col("_i") / F.lit(float(PERCENTILES))).alias("percentile"),
        "value",
        "n_valid",
    )
