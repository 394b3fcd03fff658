"""Aggregation building blocks.

The detail table is aggregated once; totals, geography levels and zero rows are then derived
from that small result, so large tables are shuffled once and after partial aggregation.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripweave.functions.expressions import total, zero
from tripweave.model import ALL_GEOGRAPHIES, Config, first_column
from tripweave.operators.weighted_stats import running_weight
from tripweave.sources.lineage import cut_lineage

MAX_HISTOGRAM_BINS = 200
RANKING_BUCKETS = 1024
RELATIVE_TOLERANCE = 1e-9

# Home geographies that may come with the data.
NATIVE_HOME_GEOGRAPHIES = ("home_taz", "home_county", "home_mpo")


def weighted_sum(df: DataFrame, keys: Sequence[str], weight: str, output: str) -> DataFrame:
    """Sum of one weight column per key."""
    return df.groupBy(*keys).agg(total(weight).alias(output))


def add_totals(
    grouped: DataFrame, totals: dict[str, str], keys: Sequence[str], measures: Sequence[str]
) -> DataFrame:
    """Add total rows to an aggregated table, one label per totalled key (all combinations)."""
    expanded = grouped
    for column, label in totals.items():
        both = F.array(F.col(column).cast("string"), F.lit(label))
        expanded = expanded.withColumn(column, F.explode(both))
    return expanded.groupBy(*keys).agg(*[total(name).alias(name) for name in measures])


def weighted_sum_with_totals(
    df: DataFrame, keys: Sequence[str], weight: str, output: str, totals: dict[str, str]
) -> DataFrame:
    return add_totals(weighted_sum(df, keys, weight, output), totals, keys, [output])


def densify(
    counts: DataFrame,
    groups: Sequence[str],
    bin_column: str,
    bins: Sequence,
    measures: Sequence[str],
) -> DataFrame:
    """One row per group and listed bin, 0 where the group has no count.

    ``counts`` holds at most one row per group and bin, so the collected map is bounded by
    the number of bins.
    """
    bin_type = counts.schema[bin_column].dataType.simpleString()
    entry = F.struct(bin_column, F.struct(*measures).alias("m"))
    packed = counts.groupBy(*groups).agg(
        F.map_from_entries(
            F.collect_list(F.when(F.col(bin_column).isNotNull(), entry))
        ).alias("_by_bin")
    )
    labels = F.array(*[F.lit(value).cast(bin_type) for value in bins])
    return packed.select(
        *groups, F.explode(labels).alias(bin_column), "_by_bin"
    ).select(
        *groups,
        bin_column,
        *[
            zero(F.try_element_at("_by_bin", F.col(bin_column))[name]).alias(name)
            for name in measures
        ],
    )


def ensure_zero_bin(
    counts: DataFrame, groups: Sequence[str], measure: str, bin_column: str = "distance_bin"
) -> DataFrame:
    """Guarantee an exact-zero bin in every represented group of an aggregated table."""
    own = F.struct(F.col(bin_column).alias("b"), F.col(measure).alias("v"))
    empty = F.struct(F.lit("0").alias("b"), F.lit(0.0).alias("v"))
    return (
        counts.select(*groups, F.explode(F.array(own, empty)).alias("_p"))
        .groupBy(F.col("_p.b").alias(bin_column), *groups)
        .agg(total("_p.v").alias(measure))
    )


def smallest_values(
    values: DataFrame, group: str, column: str, n: int, buckets: int = RANKING_BUCKETS
) -> DataFrame:
    """The ``n`` smallest texts per group as a sorted array, from distinct (group, value) rows.

    Ranked per hash bucket first, so no task orders all values of a group. More buckets split a
    group over more tasks and never change the result.
    """
    bucket = F.pmod(F.hash(column), F.lit(buckets))
    present = values.filter(F.col(column).isNotNull()).withColumn("_b", bucket)
    inside = Window.partitionBy(group, "_b").orderBy(column)
    overall = Window.partitionBy(group).orderBy(column)
    near = present.withColumn("_r", F.row_number().over(inside)).filter(F.col("_r") <= n)
    best = near.withColumn("_r", F.row_number().over(overall)).filter(F.col("_r") <= n)
    return best.groupBy(group).agg(F.sort_array(F.collect_list(column)).alias("smallest"))


# --- geographies -----------------------------------------------------------------------


def geography_dimensions(
    columns: Iterable[str], config: Config, role: str, base: tuple[str, str] | None = None
) -> list[tuple[str, str]]:
    """(type, column) pairs available for one role: base zone, native home, configured."""
    columns = set(columns)
    wanted = [base] if base else []
    if role == "home":
        wanted += [(name, name) for name in NATIVE_HOME_GEOGRAPHIES]
    wanted += [(g.name, f"{role}_geo__{g.name}") for g in config.geographies]
    seen: dict[str, str] = {}
    for kind, column in wanted:
        if column in columns and column not in seen:
            seen[column] = kind
    return [(kind, column) for column, kind in seen.items()]


def land_use_dimensions(columns: Iterable[str], config: Config) -> list[tuple[str, str]]:
    columns = set(columns)
    base = ("maz", "MAZ") if config.use_maz else ("taz", "TAZ")
    wanted = [base] + [(g.name, f"land_use_geo__{g.name}") for g in config.geographies]
    return [(kind, column) for kind, column in wanted if column in columns]


def across_geographies(
    df: DataFrame,
    dimensions: Sequence[tuple[str, str]],
    measures: dict[str, Column],
    keys: Sequence[str] = (),
    keep_null_ids: bool = False,
    with_all: bool = True,
) -> DataFrame:
    """Sums for every geography level in long form (geography_type, geography_id, keys...).

    One pass: rows are first summed by the combination of zone columns (bounded by the zone
    system), and only that result is spread over the levels.
    """
    names = list(measures)
    zone_columns = [column for _, column in dimensions]
    by_zone = df.groupBy(*keys, *zone_columns).agg(
        *[total(expr).alias(name) for name, expr in measures.items()]
    )
    levels = [
        F.struct(
            F.lit(kind).alias("geography_type"),
            F.col(column).cast("string").alias("geography_id"),
        )
        for kind, column in dimensions
    ]
    if with_all:
        levels.append(
            F.struct(
                F.lit(ALL_GEOGRAPHIES).alias("geography_type"),
                F.lit(ALL_GEOGRAPHIES).alias("geography_id"),
            )
        )
    long = by_zone.select(*keys, *names, F.explode(F.array(*levels)).alias("_g")).select(
        "_g.geography_type", "_g.geography_id", *keys, *names
    )
    if not keep_null_ids:
        long = long.filter(F.col("geography_id").isNotNull())
    return long.groupBy("geography_type", "geography_id", *keys).agg(
        *[total(name).alias(name) for name in names]
    )


def weighted_average_across_geographies(
    df: DataFrame,
    dimensions: Sequence[tuple[str, str]],
    value: str,
    output: str,
    weight: str = "finalweight",
    keys: Sequence[str] = (),
    count: str | None = None,
    with_all: bool = True,
) -> DataFrame:
    """Weighted mean (and total weight) for every geography level."""
    sums = across_geographies(
        df,
        dimensions,
        {"_vw": F.col(value) * F.col(weight), "_w": F.col(weight)},
        keys,
        with_all=with_all,
    )
    columns = ["geography_type", "geography_id", *keys]
    mean = F.when(F.col("_w") != 0, F.col("_vw") / F.col("_w")).alias(output)
    extra = [F.col("_w").alias(count)] if count else []
    return sums.select(*columns, mean, *extra)


# --- histograms ------------------------------------------------------------------------


def residual_histogram(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Histogram of residuals per group with data-dependent edges.

    Values within 1e-8 of zero form one 0..0 bin. The others use the Freedman-Diaconis rule
    (width 2 * IQR / n^(1/3)) with at most 200 bins; a single distinct value gets one bin
    around it. Two passes: statistics per group, then arithmetic binning.
    """
    v = F.col(value).cast("double")
    values = df.select(*groups, v.alias("_v")).filter(F.col("_v").isNotNull())
    is_zero = F.abs(F.col("_v")) <= 1e-8

    zero_rows = (
        values.filter(is_zero)
        .groupBy(*groups)
        .agg(F.count(F.lit(1)).cast("double").alias("geography_count"))
        .select(
            *groups,
            F.lit(0.0).alias("bin_start"),
            F.lit(0.0).alias("bin_end"),
            "geography_count",
        )
    )

    # Value frequencies first: every later step reads these distinct values.
    nonzero = cut_lineage(
        values.filter(~is_zero & ~F.isnan("_v"))
        .groupBy(*groups, "_v")
        .agg(F.count(F.lit(1)).cast("double").alias("_n"))
    )
    # Quartiles from running counts in value ranges, so no task holds all values of a group.
    running = running_weight(
        nonzero.select(*groups, F.col("_v").alias("value"), F.col("_n").alias("w")), groups
    )

    def quartile(share: float) -> Column:
        place = (F.col("total") - 1) * share
        below, above = (
            F.min(F.when(F.col("cum") > at, F.col("value"))) for at in (F.floor(place), F.ceil(place))
        )
        rest = F.max(place - F.floor(place))
        return F.when(rest == 0, below).otherwise((1 - rest) * below + rest * above)

    stats = running.groupBy(*groups).agg(
        F.min("value").alias("_lo"),
        F.max("value").alias("_hi"),
        F.max("total").alias("_total"),
        quartile(0.25).alias("_q1"),
        quartile(0.75).alias("_q3"),
    )
    lo, hi = F.col("_lo"), F.col("_hi")
    single = (F.abs(hi - lo) <= RELATIVE_TOLERANCE * F.greatest(F.abs(lo), F.abs(hi))) | (
        F.col("_total") == 1
    )
    half = F.greatest(F.lit(1.0), F.abs(lo) * 0.25)
    width = 2.0 * (F.col("_q3") - F.col("_q1")) / F.pow("_total", F.lit(1.0 / 3.0))
    nearly_equal = F.abs(hi - lo) <= 1e-8 + 1e-5 * F.abs(hi)
    wanted = (
        F.when(nearly_equal, 6.0)
        .when(width > 0, F.ceil((hi - lo) / width).cast("double"))
        .otherwise(1.0)
    )
    edges = stats.select(
        *groups,
        F.when(single, lo - half).otherwise(lo).alias("_start"),
        F.when(single, lo + half).otherwise(hi).alias("_stop"),
        F.when(single, 1.0)
        .otherwise(F.least(F.greatest(wanted, F.lit(1.0)), F.lit(float(MAX_HISTOGRAM_BINS))))
        .cast("int")
        .alias("_bins"),
    )

    def edge(index: Column) -> Column:
        step = (F.col("_stop") - F.col("_start")) / F.col("_bins")
        return F.when(index == F.col("_bins"), F.col("_stop")).otherwise(
            F.col("_start") + index * step
        )

    joined = nonzero.join(edges, on=list(groups), how="inner")
    guess = F.least(
        F.floor(
            (F.col("_v") - F.col("_start"))
            / (F.col("_stop") - F.col("_start"))
            * F.col("_bins")
        ).cast("int"),
        F.col("_bins") - 1,
    )
    binned = joined.withColumn("_guess", guess).withColumn(
        "_bin",
        F.when(F.col("_v") < edge(F.col("_guess")), F.col("_guess") - 1)
        .when(
            (F.col("_v") >= edge(F.col("_guess") + 1))
            & (F.col("_guess") < F.col("_bins") - 1),
            F.col("_guess") + 1,
        )
        .otherwise(F.col("_guess")),
    )
    geometry = ["_start", "_stop", "_bins"]
    bin_counts = binned.groupBy(*groups, *geometry, "_bin").agg(F.sum("_n").alias("_n"))
    nonzero_rows = (
        bin_counts.groupBy(*groups, *geometry)
        .agg(F.map_from_entries(F.collect_list(F.struct("_bin", "_n"))).alias("_by_bin"))
        .withColumn("_bin", F.explode(F.sequence(F.lit(0), F.col("_bins") - 1)))
        .select(
            *groups,
            edge(F.col("_bin")).alias("bin_start"),
            edge(F.col("_bin") + 1).alias("bin_end"),
            zero(F.try_element_at("_by_bin", F.col("_bin"))).alias("geography_count"),
        )
    )
    return zero_rows.unionByName(nonzero_rows)


# --- period totals ---------------------------------------------------------------------

DAILY = "Daily"


def with_daily_rows(
    df: DataFrame, keys: Sequence[str], measures: Sequence[str], first: Sequence[str] = ()
) -> DataFrame:
    """Add Daily rows summed from period rows; keep a given Daily row only where a group has
    no period rows. ``first`` columns are carried on period rows and grouped for Daily ones.
    """
    groups = [*keys, *first]
    is_period = F.col("time_period") != DAILY
    own, daily = F.col("time_period"), F.lit(DAILY)
    spread = df.select(
        *groups,
        *measures,
        is_period.alias("_from_period"),
        F.explode(F.when(is_period, F.array(own, daily)).otherwise(F.array(own))).alias(
            "time_period"
        ),
    )
    from_period = F.col("_from_period")
    sums = spread.groupBy(*groups, "time_period").agg(
        F.max(from_period).alias("_any_period"),
        *[total(F.when(from_period, F.col(m))).alias(f"_p_{m}") for m in measures],
        *[total(F.when(~from_period, F.col(m))).alias(f"_d_{m}") for m in measures],
    )
    return sums.select(
        *groups,
        "time_period",
        *[
            F.when(F.col("_any_period"), F.col(f"_p_{m}")).otherwise(F.col(f"_d_{m}")).alias(m)
            for m in measures
        ],
    )


# --- least squares ---------------------------------------------------------------------


def least_squares(
    points: DataFrame, groups: Sequence[str], x: str = "observed_volume", y: str = "modeled_volume"
) -> DataFrame:
    """Slope, intercept and clamped R2 per group, with n and the range of x.

    Needs at least two points and some spread in x; constant y is fitted exactly (R2 = 1).
    """
    usable = points.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    xd, yd = F.col(x).cast("double"), F.col(y).cast("double")
    sums = usable.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n_locations"),
        F.min(xd).alias("observed_min"),
        F.max(xd).alias("observed_max"),
        F.avg(xd).alias("_mx"),
        F.avg(yd).alias("_my"),
        F.regr_sxx(yd, xd).alias("_sxx"),
        F.regr_sxy(yd, xd).alias("_sxy"),
        F.regr_syy(yd, xd).alias("_syy"),
        (F.min(yd) == F.max(yd)).alias("_flat"),
    )
    defined = (F.col("n_locations") >= 2) & (F.col("observed_max") > F.col("observed_min"))
    slope = F.when(defined, F.col("_sxy") / F.col("_sxx"))
    fitted = sums.withColumn("slope", slope)
    sse = F.col("_syy") - F.col("slope") * F.col("_sxy")
    r2 = F.when(F.col("_flat"), 1.0).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - sse / F.col("_syy")))
    )
    return fitted.select(
        *groups,
        "slope",
        (F.col("_my") - F.col("slope") * F.col("_mx")).alias("intercept"),
        F.when(F.col("slope").isNotNull(), r2).alias("r_squared"),
        "n_locations",
        "observed_min",
        "observed_max",
    )


def resolve(columns: Iterable[str], *candidate_lists: Sequence[str]) -> list[str | None]:
    """First present name of each candidate list."""
    columns = list(columns)
    return [first_column(columns, candidates) for candidates in candidate_lists]
