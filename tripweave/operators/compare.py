"""Comparison of several runs, on stored summaries with a ``run`` column.

Each function takes and returns DataFrames keyed by ``run``; shares and joins stay within a run.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripweave.functions.expressions import (
    SUBMILE_BIN,
    distance_bin_labels,
    distance_bin_order,
    is_true,
    lowered,
    total,
    zero,
)
from tripweave.model import (
    ALL_GEOGRAPHIES,
    ALL_PERSON_TYPES,
    ALL_TOUR_PURPOSES,
    Config,
    first_column,
)
from tripweave.operators.aggregate import densify, least_squares

RUN = "run"
TOTAL_LABELS = ("Total", "All")

# Names under which the all-geographies level may be stored.
AGGREGATE_GEOGRAPHIES = (ALL_GEOGRAPHIES, "All Geographies")


def stack_runs(runs: dict[str, DataFrame]) -> DataFrame:
    """One table over several runs, in long form."""
    parts = [df.withColumn(RUN, F.lit(label)) for label, df in runs.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def per_run(*columns: str) -> Window:
    return Window.partitionBy(RUN, *columns)


def share(value: Column, denominator: Column) -> Column:
    """Percent of a positive denominator, else 0."""
    return F.when(denominator > 0, value / denominator * 100.0).otherwise(0.0)


def add_percent_of_total(df: DataFrame, value: str, output: str) -> DataFrame:
    return df.withColumn(output, share(F.col(value), F.sum(value).over(per_run())))


# --- categories ----------------------------------------------------------------------------


def numeric_order(column: str) -> Column:
    """Sort key of number-like labels (``40+`` after 39, text last)."""
    return distance_bin_order(column)


def capped_category(column: str, cap: int) -> Column:
    """Number-like label with everything from ``cap`` on in one open class."""
    text = F.col(column).cast("string")
    number = F.regexp_replace(text, r"\+$", "").try_cast("double")
    return (
        F.when(text == SUBMILE_BIN, text)
        .when(number >= cap, f"{cap}+")
        .otherwise(number.try_cast("bigint").cast("string"))
    )


def cap_categories(
    df: DataFrame, category: str, cap: int, measures: Sequence[str], keys: Sequence[str] = ()
) -> DataFrame:
    """Cap a category and sum the measures again, per run and other keys."""
    return (
        df.withColumn(category, capped_category(category, cap))
        .groupBy(RUN, *keys, category)
        .agg(*[total(m).alias(m) for m in measures])
    )


def complete_categories(
    df: DataFrame, category: str, values: Sequence[str], measures: Sequence[str]
) -> DataFrame:
    """Every listed category in every run, 0 where it is absent."""
    counts = df.groupBy(RUN, F.col(category).cast("string").alias(category)).agg(
        *[total(m).alias(m) for m in measures]
    )
    return densify(counts, [RUN], category, list(values), list(measures))


def align_keys(df: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Every key found in any run is present in every run, 0 where it is absent.

    ``runs`` is the short list of run labels, packed once; keys are never paired with keys.
    """
    by_run = df.groupBy(*keys).agg(
        F.map_from_entries(
            F.collect_list(F.struct(F.col(RUN), F.struct(*measures).alias("m")))
        ).alias("_m")
    )
    runs = df.agg(F.sort_array(F.collect_set(RUN)))
    return (
        by_run.withColumn("_runs", runs.scalar())
        .withColumn(RUN, F.explode("_runs"))
        .select(
            RUN,
            *keys,
            *[zero(F.try_element_at("_m", F.col(RUN))[m]).alias(m) for m in measures],
        )
    )


def value_presence(df: DataFrame, column: str) -> DataFrame:
    """Values of a column with the number of runs that have them, and whether all do."""
    runs = df.agg(F.count_distinct(RUN)).scalar()
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(F.col(column).cast("string").alias("value"))
        .agg(F.count_distinct(RUN).alias("runs"))
        .withColumn("in_all_runs", F.col("runs") == runs)
    )


def label_categories(
    df: DataFrame, source: str, category: str, config: Config, target: str
) -> DataFrame:
    """Display label and position of each value, from the configured label and order tables."""
    text = F.col(source).cast("string")
    labels = config.labels.get(category, {})
    defaults = {
        ALL_PERSON_TYPES: "All Person Types",
        ALL_TOUR_PURPOSES: "All Tour Purposes",
        ALL_GEOGRAPHIES: "All Geographies",
    }
    table = {**defaults, **labels}
    mapped = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    order = config.orders.get(category, tuple(labels))
    positions = {v: i for i, v in enumerate(order)}
    position = F.lit(len(positions))
    if positions:
        ranks = F.create_map(*[F.lit(x) for pair in positions.items() for x in pair])
        position = F.coalesce(F.try_element_at(ranks, text), position)
    return df.withColumn(target, F.coalesce(F.try_element_at(mapped, text), text)).withColumn(
        f"{target}_order", position
    )


# --- comparison with a base run -------------------------------------------------------------


def percent_text(value: Column, digits: int = 2) -> Column:
    """``12.34%``, or blank when undefined."""
    return F.coalesce(F.format_string(f"%.{digits}f%%", value), F.lit(""))


def _base_values(df: DataFrame, base: str, keys: Sequence[str], value: str) -> DataFrame:
    return df.filter(F.col(RUN) == base).select(*keys, F.col(value).alias("base_value"))


def compare_to_base(df: DataFrame, base: str, keys: Sequence[str], value: str) -> DataFrame:
    """Value, base-run value, absolute difference and percent difference of every run."""
    joined = df.join(_base_values(df, base, keys, value), list(keys), "left")
    own, other = F.col(value).cast("double"), F.col("base_value").cast("double")
    percent = F.when(other != 0, (own - other) / other * 100.0)
    return joined.select(
        RUN,
        *keys,
        own.alias(value),
        "base_value",
        F.abs(own - other).alias("difference"),
        F.when(percent.isNotNull(), percent_text(percent)).otherwise("").alias(
            "percent_difference"
        ),
    )


def percent_difference_wide(
    df: DataFrame, base: str, runs: Sequence[str], keys: Sequence[str], value: str
) -> DataFrame:
    """Percent difference of every run against the base run, one column per run."""
    joined = df.join(_base_values(df, base, keys, value), list(keys), "left")
    other = F.col("base_value")
    percent = F.when(other != 0, (F.col(value) - other) / other * 100.0)
    text = F.when(F.col(RUN) == base, "0.00%").otherwise(
        F.when(percent.isNotNull(), percent_text(percent)).otherwise("")
    )
    return (
        joined.withColumn("_text", text).groupBy(*keys).pivot(RUN, list(runs)).agg(F.first("_text"))
    )


def weighted_average(
    df: DataFrame, category: str, average: str, weight: str | None, keys: Sequence[str] = ()
) -> DataFrame:
    """Average by category: weighted when there is a weight column, else simple."""
    groups = [RUN, *keys, category]
    if weight is None or weight not in df.columns:
        return df.groupBy(*groups).agg(F.avg(average).alias(average))
    sums = df.groupBy(*groups).agg(
        total(weight).alias(weight), total(F.col(average) * F.col(weight)).alias("_vw")
    )
    return sums.select(
        *groups,
        F.when(F.col(weight) > 0, F.col("_vw") / F.col(weight)).alias(average),
    ).filter(F.col(average).isNotNull() & F.col(category).isNotNull())


def distance_comparison(
    df: DataFrame, purpose: str, weight: str, base: str, level: str, geography: str
) -> DataFrame:
    """Average distance by purpose at one geography, against the base run."""
    rows = filter_geography(filter_geography_level(df, level), geography)
    averages = weighted_average(rows, purpose, "average_tour_distance", weight)
    return compare_to_base(averages, base, [purpose], "average_tour_distance")


# --- filters ------------------------------------------------------------------------------------


def is_aggregate(value: str) -> bool:
    return value in AGGREGATE_GEOGRAPHIES


def _geography_matches(column: str, wanted: str) -> Column:
    text = F.col(column).cast("string")
    return text.isin(*AGGREGATE_GEOGRAPHIES) if is_aggregate(wanted) else text == wanted


def filter_geography_level(df: DataFrame, level: str) -> DataFrame:
    """Rows of one geography level; flow tables need both ends at that level."""
    if level in TOTAL_LABELS:
        return df
    single = first_column(df.columns, ("geography_level", "geography_type"))
    if single:
        return df.filter(_geography_matches(single, level))
    for kind in ("geography_level", "geography_type"):
        ends = [f"origin_{kind}", f"destination_{kind}"]
        if set(ends) <= set(df.columns):
            return df.filter(
                _geography_matches(ends[0], level) & _geography_matches(ends[1], level)
            )
    return df


def filter_geography(df: DataFrame, geography: str | None) -> DataFrame:
    """Rows of one geography id; ``None`` keeps all ids of the level."""
    column = first_column(df.columns, ("geography", "geography_id"))
    if geography is None or column is None:
        return df
    return df.filter(_geography_matches(column, geography))


def filter_person_type(df: DataFrame, person_type: str | None) -> DataFrame:
    """One person type, or all detail types without the total rows."""
    text = F.col("person_type").cast("string")
    if person_type is None:
        return df.filter(~text.isin(ALL_PERSON_TYPES, "Total"))
    return df.filter(text == person_type)


def total_rates(
    rates: DataFrame, purpose: str, rate: str, person_counts: DataFrame
) -> DataFrame:
    """All-persons rate by purpose from detail rates and person counts, per run."""
    weights = (
        filter_person_type(person_counts, None)
        .groupBy(RUN, F.col("person_type").cast("string").alias("person_type"))
        .agg(total("person_count").alias("_w"))
    )
    everyone = weights.groupBy(RUN).agg(total("_w").alias("_all"))
    return (
        filter_person_type(rates, None)
        .join(weights, [RUN, "person_type"], "left")
        .groupBy(RUN, purpose)
        .agg(total(F.col(rate) * zero(F.col("_w"))).alias("_sum"))
        .join(everyone, RUN)
        .select(RUN, purpose, F.when(F.col("_all") > 0, F.col("_sum") / F.col("_all")).alias(rate))
    )


def student_type_rollup(residuals: DataFrame) -> DataFrame:
    """Residual tables over all student types, with the percent worked out again."""
    keys = [RUN, "geography_type", "geography_id"]
    measures = ["target_count", "modeled_count", "residual_count", "absolute_residual_count"]
    sums = residuals.groupBy(*keys).agg(*[total(m).alias(m) for m in measures])
    percent = F.when(
        F.col("target_count") != 0, F.col("residual_count") / F.col("target_count") * 100.0
    )
    return sums.withColumn("student_type", F.lit("All")).withColumn("percent_error", percent)


# --- long-term choices ---------------------------------------------------------------------------


def external_worker_share(df: DataFrame) -> DataFrame:
    """External workers as percent of all workers, at the all-geographies level."""
    rows = filter_geography_level(df, ALL_GEOGRAPHIES)
    value = share(F.col("external_worker_count"), F.col("all_worker_count"))
    return rows.withColumn("external_worker_percent", value)


def work_from_home_share(df: DataFrame, level: str, geography: str | None = None) -> DataFrame:
    rows = filter_geography(filter_geography_level(df, level), geography)
    value = share(F.col("work_from_home_worker_count"), F.col("worker_count"))
    label = F.when(F.col("geography_id") == ALL_GEOGRAPHIES, "All Geographies").otherwise(
        F.col("geography_id")
    )
    return rows.withColumn("work_from_home_percent", value).withColumn("geography_label", label)


def telecommute_distribution(
    df: DataFrame,
    values: Sequence[str],
    config: Config,
    level: str = ALL_GEOGRAPHIES,
    geography: str | None = None,
) -> DataFrame:
    """Persons by telecommute frequency at one level, over the same listed values in every run.

    Adds the configured label and position of each value; a value that is absent counts 0.
    """
    rows = filter_geography(filter_geography_level(df, level), geography)
    complete = complete_categories(rows, "telecommute_frequency", values, ["person_count"])
    category = "telecommute_frequency"
    return label_categories(complete, category, category, config, f"{category}_label")


def distance_distribution(df: DataFrame, cap: int = 40) -> DataFrame:
    return cap_categories(df, "distance_bin", cap, ["person_count"])


def vehicle_ownership(df: DataFrame, household_size: str | None = None) -> DataFrame:
    rows = df if household_size is None else df.filter(F.col("household_size") == household_size)
    return cap_categories(rows, "household_vehicle_count", 4, ["household_count"])


# --- joint travel --------------------------------------------------------------------------------


def joint_party_sizes(df: DataFrame) -> DataFrame:
    return cap_categories(df, "party_size", 5, ["joint_tour_count"])


COMPOSITION_ORDER = {"adults": 0, "mixed": 1, "children": 2}


def joint_composition(df: DataFrame, party_size: str | None = None) -> DataFrame:
    rows = df.withColumn("party_size", capped_category("party_size", 5))
    if party_size is not None:
        rows = rows.filter(F.col("party_size") == party_size)
    name = F.lower(F.col("tour_composition"))
    order = F.create_map(*[F.lit(x) for p in COMPOSITION_ORDER.items() for x in p])
    return (
        rows.groupBy(RUN, name.alias("tour_composition"))
        .agg(total("joint_tour_count").alias("joint_tour_count"))
        .withColumn("position", F.coalesce(F.try_element_at(order, name), F.lit(99)))
    )


def household_participation(df: DataFrame, household_size: str | None = None) -> DataFrame:
    """Mean household percent by joint-tour class over the (capped) household sizes."""
    rows = df.withColumn("household_size", capped_category("household_size", 5))
    if household_size is not None:
        rows = rows.filter(F.col("household_size") == household_size)
    return rows.groupBy(RUN, "jtf").agg(F.avg("household_percent").alias("household_percent"))


def person_participation(df: DataFrame) -> DataFrame:
    capped = cap_categories(
        df, "household_size", 5, ["joint_tour_person_count", "total_person_count"]
    )
    value = share(F.col("joint_tour_person_count"), F.col("total_person_count"))
    return capped.withColumn("person_percent", value)


def joint_frequency_share(df: DataFrame, hide_none: bool = False) -> DataFrame:
    """Share of every alternative; hiding the no-tour class keeps the full denominator."""
    shares = add_percent_of_total(df, "household_count", "household_count_percent")
    if not hide_none:
        return shares
    return shares.filter(F.lower(F.trim("jtf_label")) != "no joint tours")


# --- escorting -----------------------------------------------------------------------------------


def escort_event_stops(df: DataFrame, segment: str) -> DataFrame:
    return cap_categories(df.filter(F.col("segment") == segment), "stop_count", 3, ["tour_count"])


def in_direction(df: DataFrame, direction: str) -> DataFrame:
    return df.filter(F.col("direction") == direction)


def escort_person_types(df: DataFrame, direction: str) -> DataFrame:
    """Escorted tours of one direction by the adult's person type."""
    kind = F.col("person_type").cast("string").alias("person_type")
    return in_direction(df, direction).select(RUN, kind, "tour_count")


def student_escort_status(df: DataFrame, direction: str) -> DataFrame:
    """Students' school tours of one direction by escort type."""
    return in_direction(df, direction).select(RUN, "escort_type", "tour_count")


def escort_distances(df: DataFrame, direction: str, measure: str) -> DataFrame:
    """All distance bins of one direction, 0 where empty."""
    return complete_categories(
        in_direction(df, direction), "distance_bin", distance_bin_labels(), [measure]
    )


def escort_household_share(escorting: DataFrame, households: DataFrame, direction: str) -> DataFrame:
    """Escorting households as percent of households by (capped) student count."""
    totals = cap_categories(
        households.withColumnRenamed("household_count", "total_household_count"),
        "student_count",
        6,
        ["total_household_count"],
    )
    counted = cap_categories(
        in_direction(escorting, direction), "student_count", 6, ["household_count"]
    )
    joined = totals.join(counted, [RUN, "student_count"], "left").withColumn(
        "household_count", zero(F.col("household_count"))
    )
    return joined.withColumn(
        "percent", share(F.col("household_count"), F.col("total_household_count"))
    )


def children_per_tour(df: DataFrame, direction: str) -> DataFrame:
    rows = in_direction(df, direction).withColumn(
        "_kids", F.col("avg_schoolkids_per_tour") * F.col("tour_count")
    )
    sums = cap_categories(rows, "student_count", 6, ["_kids", "tour_count"])
    mean = F.when(F.col("tour_count") > 0, F.col("_kids") / F.col("tour_count")).otherwise(0.0)
    return sums.select(RUN, "student_count", mean.alias("avg_schoolkids_per_tour"), "tour_count")


# --- tours and trips -----------------------------------------------------------------------------

SUFFICIENCY_COLUMNS = {
    "All": "tour_count_all_households",
    "Zero Auto": "tour_count_zero_auto",
    "Auto Deficient": "tour_count_auto_deficient",
    "Auto Sufficient": "tour_count_auto_sufficient",
}


def tour_mode_share(
    df: DataFrame, purpose: str, sufficiency: str = "All", hidden: Sequence[str] = ()
) -> DataFrame:
    """Mode shares of one purpose; hidden modes stay in the denominator."""
    rows = df.filter(F.col("tour_purpose") == purpose).select(
        RUN, "tour_mode", F.col(SUFFICIENCY_COLUMNS[sufficiency]).alias("tour_count")
    )
    shares = add_percent_of_total(rows, "tour_count", "tour_count_percent")
    return shares.filter(~F.col("tour_mode").isin(*hidden)) if hidden else shares


def vehicle_attributes(df: DataFrame, category: str, occupancy: str | None = None) -> DataFrame:
    """Vehicles by an attribute for one occupancy, or over all of them."""
    rows = df if occupancy is None else df.filter(F.col("occupancy") == occupancy)
    return rows.groupBy(RUN, category).agg(total("vehicle_count").alias("vehicle_count"))


STOP_COLUMNS = {
    "Both": ("total_stop_count", 6),
    "Outbound": ("outbound_stop_count", 3),
    "Inbound": ("inbound_stop_count", 3),
}


def stop_frequency(df: DataFrame, direction: str, purpose: str | None = None) -> DataFrame:
    column, cap = STOP_COLUMNS[direction]
    rows = df if purpose is None else df.filter(F.col("tour_purpose") == purpose)
    return cap_categories(rows, column, cap, ["tour_count"]).withColumnRenamed(
        column, "stop_frequency"
    )


def clock_label(time_bin: Column, bins: Column) -> Column:
    """Start time of a period counted from 03:00, in half hours (48 bins) or hours (24)."""
    step = F.when(bins == 48, 30).otherwise(60)
    minutes = F.pmod((time_bin - 1) * step + 180, F.lit(1440))
    hours = F.floor(minutes / 60).cast("int")
    return F.format_string("%02d:%02d", hours, F.pmod(minutes, F.lit(60)).cast("int"))


def time_profile(df: DataFrame, purpose: str) -> DataFrame:
    """Counts of one purpose with clock labels and durations in hours."""
    bins = df.agg(F.max("time_bin")).scalar()
    rows = df.filter(F.col("tour_purpose") == purpose)
    hours = F.round(F.col("time_bin") * F.when(bins == 48, 0.5).otherwise(1.0), 2)
    return rows.withColumn("clock_time", clock_label(F.col("time_bin"), bins)).withColumn(
        "duration_hours", hours
    )


def trip_mode_share(
    df: DataFrame, modes: Sequence[str], hidden: Sequence[str] = ()
) -> DataFrame:
    """Share of every listed trip mode, zero-filled; hidden modes stay in the denominator."""
    completed = complete_categories(df, "trip_mode", modes, ["trip_count"])
    shares = add_percent_of_total(completed, "trip_count", "trip_count_percent")
    return shares.filter(~F.col("trip_mode").isin(*hidden)) if hidden else shares


def distances_of_purpose(
    df: DataFrame, purpose: str, measure: str, cap: int | None = None
) -> DataFrame:
    rows = df.filter(F.col("tour_purpose") == purpose).select(RUN, "distance_bin", measure)
    if cap is not None:
        rows = cap_categories(rows, "distance_bin", cap, [measure])
    return rows.withColumn("position", numeric_order("distance_bin"))


def purposes_of(df: DataFrame, category: str, measure: str, purpose: str | None) -> DataFrame:
    """Counts by a purpose column for one tour purpose, or over all detail purposes."""
    if purpose is not None:
        return df.filter(F.col("tour_purpose") == purpose).select(RUN, category, measure)
    detail = df.filter(F.col("tour_purpose") != ALL_TOUR_PURPOSES)
    return detail.groupBy(RUN, category).agg(total(measure).alias(measure))


def parking_demand(parking: DataFrame, land_use: DataFrame, capacity: str) -> DataFrame:
    """Parked trips against capacity per zone; zones with either one are kept."""
    supply = land_use.groupBy(RUN, F.col("MAZ").cast("string").alias("geography_id")).agg(
        total(capacity).alias("parking_capacity")
    )
    demand = parking.filter(F.col("geography_type").isin("maz", "taz")).select(
        RUN, "geography_id", "trip_count"
    )
    return supply.join(demand, [RUN, "geography_id"], "full").select(
        RUN,
        "geography_id",
        zero(F.col("parking_capacity")).alias("parking_capacity"),
        zero(F.col("trip_count")).alias("trip_count"),
    )


def mode_distribution(trips: DataFrame) -> DataFrame:
    """Weighted trips by mode straight from trip records."""
    weight = F.col("finalweight") if "finalweight" in trips.columns else F.lit(1.0)
    return (
        trips.filter(F.col("trip_mode").isNotNull())
        .groupBy(RUN, F.col("trip_mode").cast("string").alias("trip_mode"))
        .agg(total(weight).alias("freq"))
    )


# --- lookup components ---------------------------------------------------------------------------


def family_statistics(
    stats: DataFrame,
    mode: str,
    family: dict[str, Sequence[str]],
    direction: str | None = None,
    scenario: str = "chosen_mode",
) -> DataFrame:
    """Component statistics of a mode family, given as the components of each mode."""
    wanted = F.lit(False)
    for name, components in family.items():
        wanted = wanted | ((F.col(mode) == name) & F.col("component").isin(*components))
    rows = stats.filter((F.col("skim_scenario") == scenario) & wanted)
    if direction is None:
        return rows.withColumn("skim_name", F.col("component"))
    suffix = f"_{direction.lower()}"
    return rows.filter(F.col("component").endswith(suffix)).withColumn(
        "skim_name", F.regexp_replace("component", f"{suffix}$", "")
    )


def component_histogram(
    records: DataFrame, value: str, weight: str = "finalweight", bins: int = 500
) -> DataFrame:
    """Weighted histogram per run with edges common to all runs; the last bin is closed."""
    usable = records.filter(F.col(value).isNotNull()).select(
        RUN, F.col(value).cast("double").alias("_v"), F.col(weight).cast("double").alias("_w")
    )
    frequencies = usable.groupBy(RUN, "_v").agg(F.sum("_w").alias("_w"))
    edges = frequencies.agg(
        F.struct(F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    ).scalar()
    ranged = frequencies.withColumn("_e", edges)
    lo, hi = F.col("_e.lo"), F.col("_e.hi")
    step = (hi - lo) / bins
    edge = lambda i: F.when(i == bins, hi).otherwise(lo + i * step)
    guess = F.least(F.floor((F.col("_v") - lo) / step).cast("int"), F.lit(bins - 1))
    placed = ranged.withColumn("_g", F.when(hi > lo, guess).otherwise(0)).withColumn(
        "_bin",
        F.when(hi <= lo, 0)
        .when(F.col("_v") < edge(F.col("_g")), F.col("_g") - 1)
        .when((F.col("_v") >= edge(F.col("_g") + 1)) & (F.col("_g") < bins - 1), F.col("_g") + 1)
        .otherwise(F.col("_g")),
    )
    counts = placed.groupBy(RUN, "_e", "_bin").agg(total("_w").alias("freq"))
    dense = densify(counts, [RUN, "_e"], "_bin", list(range(bins)), ["freq"])
    middle = F.when(hi > lo, (edge(F.col("_bin")) + edge(F.col("_bin") + 1)) / 2.0).otherwise(lo)
    return dense.filter((hi > lo) | (F.col("_bin") == 0)).select(
        RUN, middle.alias("bin_mid"), "freq"
    )


# --- traffic -------------------------------------------------------------------------------------

FIT_POINTS = 100


def scatter_of(df: DataFrame, period_column: str, period: str, facility: str = "All") -> DataFrame:
    rows = df.filter(F.col(period_column) == period)
    return rows if facility == "All" else rows.filter(F.col("facility_type") == facility)


def fit_lines(scatter: DataFrame, keys: Sequence[str] = (RUN,)) -> DataFrame:
    """101 evenly spaced points of the least-squares line of each group, with its label."""
    fit = least_squares(scatter, list(keys)).filter(F.col("slope").isNotNull())
    sign = F.when(F.col("intercept") >= 0, "+").otherwise("-")
    label = F.format_string(
        "y = %.2fx %s %.2f, R² = %.2f, n = %d",
        F.col("slope"),
        sign,
        F.abs(F.col("intercept")),
        F.col("r_squared"),
        F.col("n_locations"),
    )
    step = (F.col("observed_max") - F.col("observed_min")) / FIT_POINTS
    points = fit.withColumn("annotation", label).withColumn(
        "_i", F.explode(F.sequence(F.lit(0), F.lit(FIT_POINTS)))
    )
    x = F.col("observed_min") + step * F.col("_i")
    return points.select(
        *keys,
        F.col("_i").alias("point"),
        x.alias("observed_volume"),
        (F.col("slope") * x + F.col("intercept")).alias("modeled_volume"),
        "annotation",
    )


def facility_comparison(scatter: DataFrame) -> DataFrame:
    """Count fit by facility type: totals, RMSE, percent RMSE (blank with a zero count), R2."""
    points = scatter.filter(F.col("facility_type") != "All")
    observed, modeled = F.col("observed_volume"), F.col("modeled_volume")
    error = modeled - observed
    keys = [RUN, "facility_type"]
    sums = points.groupBy(*keys).agg(
        F.count_distinct("id").alias("n"),
        total(observed).alias("total_observed"),
        total(modeled).alias("total_modeled"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.count_if(observed == 0).alias("_zeros"),
        F.sqrt(F.avg(F.when(observed != 0, F.pow(error / observed, F.lit(2.0))))).alias("_rmspe"),
    )
    fits = least_squares(points, keys).select(*keys, "r_squared")
    percent = (F.col("total_modeled") - F.col("total_observed")) / F.col("total_observed") * 100.0
    return sums.join(fits, keys, "left").select(
        *keys,
        "n",
        "total_observed",
        "total_modeled",
        F.when(F.col("total_observed") != 0, percent_text(percent))
        .otherwise("")
        .alias("percent_difference"),
        "rmse",
        F.when(F.col("_zeros") == 0, percent_text(F.col("_rmspe") * 100.0))
        .otherwise("")
        .alias("rmspe"),
        "r_squared",
    )


def link_volumes(links: DataFrame, volume: str) -> DataFrame:
    return links.groupBy(RUN, F.col("FACTYPE").cast("string").alias("FACTYPE")).agg(
        total(volume).alias("volume")
    )


def top_links(
    counts: DataFrame, volumes: DataFrame, volume: str, n: int, links: DataFrame | None = None
) -> DataFrame:
    """The ``n`` links per run with the largest modelled volume, with their node numbers."""
    keys = [RUN, "id", "facility_type"]

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(
            RUN,
            F.col("id").try_cast("bigint").alias("id"),
            F.col("FACTYPE").cast("string").alias("facility_type"),
            F.col(volume).cast("double").alias(name),
        ).filter(F.col(name).isNotNull())

    joined = side(counts, "observed").join(side(volumes, "modeled"), keys)
    if links is not None:
        nodes = links.groupBy(RUN, F.col("id").try_cast("bigint").alias("id")).agg(
            F.min("From_Node").alias("From_Node"), F.min("To_Node").alias("To_Node")
        )
        joined = joined.join(nodes, [RUN, "id"], "left")
    order = [F.col("modeled").desc(), F.col("id").asc()]
    # Best n per bucket first, so no task ranks all links of a run.
    bucket = F.pmod(F.hash("id"), F.lit(64))
    near = joined.withColumn("_b", bucket).withColumn(
        "_r", F.row_number().over(per_run("_b").orderBy(*order))
    )
    best = near.filter(F.col("_r") <= n).withColumn(
        "position", F.row_number().over(per_run().orderBy(*order))
    )
    difference = F.col("modeled") - F.col("observed")
    return (
        best.filter(F.col("position") <= n)
        .withColumn("difference", difference)
        .withColumn(
            "percent_difference",
            F.when(F.col("observed") != 0, percent_text(difference / F.col("observed") * 100.0))
            .otherwise(""),
        )
        .drop("_b", "_r")
    )


# --- flows ---------------------------------------------------------------------------------------


def flow_matrix_long(matrix: DataFrame, origin: str, value: str, totals: bool = False) -> DataFrame:
    """A wide flow matrix (one column per destination) in long form."""
    destinations = [
        c
        for c in matrix.columns
        if c not in (RUN, origin) and (totals or c.lower() != "total")
    ]
    rows = matrix if totals else matrix.filter(F.lower(F.col(origin)) != "total")
    return (
        rows.withColumnRenamed(origin, "Origin")
        .unpivot([RUN, "Origin"], destinations, "Destination", value)
        .withColumn(value, zero(F.col(value).cast("double")))
    )


def modeled_flows(flows: DataFrame, level: str, totals: bool = False) -> DataFrame:
    """Commuting flows of one level, optionally with row, column and grand totals.

    Total rows that come with the flows are left out; totals are made from the cells.
    """
    rows = flows.filter(
        (F.col("origin_geography_type") == level) & (F.col("destination_geography_type") == level)
    )
    for place in ("origin_geography_id", "destination_geography_id"):
        rows = rows.filter(~is_true(lowered(place) == "total"))
    base = rows.groupBy(
        RUN,
        F.col("origin_geography_id").alias("Origin"),
        F.col("destination_geography_id").alias("Destination"),
    ).agg(total("commuter_count").alias("modeled"))
    if not totals:
        return base
    for column in ("Origin", "Destination"):
        base = base.withColumn(column, F.explode(F.array(F.col(column), F.lit("Total"))))
    return base.groupBy(RUN, "Origin", "Destination").agg(total("modeled").alias("modeled"))


def with_default_observed(
    observed: DataFrame, modeled: DataFrame, default_run: str | None = None
) -> DataFrame:
    """Observed flows of the modelled runs; a run without its own has those of the default run.

    default_run: whose flows are lent, the first by name where it is not given.
    """
    runs, own = modeled.select(RUN).distinct(), observed.select(RUN).distinct()
    lender = F.lit(default_run) if default_run else own.agg(F.min(RUN)).scalar()
    borrowers = runs.join(own, RUN, "left_anti").agg(F.collect_list(RUN)).scalar()
    lent = observed.filter(F.col(RUN) == lender).withColumn(RUN, F.explode(borrowers))
    return observed.join(runs, RUN, "left_semi").unionByName(lent)


def flow_comparison(
    observed: DataFrame, modeled: DataFrame, default_run: str | None = None
) -> DataFrame:
    """Observed and modelled flows on the full matrix of the places either table names.

    Runs are those with modelled flows; one without observed flows takes the default run's.
    The result is a complete matrix by definition; its size is the square of the places of a
    reporting level (districts, counties).
    """
    observed = with_default_observed(observed, modeled, default_run)
    both = observed.join(modeled, [RUN, "Origin", "Destination"], "full")
    by_origin = both.groupBy(RUN, "Origin").agg(
        F.map_from_entries(
            F.collect_list(
                F.struct("Destination", F.struct("observed", "modeled").alias("m"))
            )
        ).alias("_m")
    )
    places = both.groupBy(RUN).agg(F.collect_set("Destination").alias("_places"))
    grid = by_origin.join(places, RUN).select(
        RUN, "Origin", F.explode("_places").alias("Destination"), "_m"
    )
    cell = F.try_element_at("_m", F.col("Destination"))
    filled = grid.select(
        RUN,
        "Origin",
        "Destination",
        zero(cell["observed"]).alias("observed"),
        zero(cell["modeled"]).alias("modeled"),
    )
    difference = F.col("modeled") - F.col("observed")
    percent = F.when(F.col("observed") != 0, difference / F.col("observed") * 100.0)
    return filled.withColumn("difference", difference).withColumn(
        "percent_difference", percent
    ).withColumn("absolute_percent_difference", F.abs(percent))


def transit_by_operator(
    df: DataFrame, technology: str = "All", access_mode: str = "All"
) -> DataFrame:
    """Boardings (sum) or transfer rate (mean) by operator."""
    rows = df if technology == "All" else df.filter(F.col("technology") == technology)
    if access_mode != "All" and "access_mode" in df.columns:
        rows = rows.filter(F.col("access_mode") == access_mode)
    if "boardings" in df.columns:
        return rows.groupBy(RUN, "operator").agg(total("boardings").alias("boardings"))
    return rows.groupBy(RUN, "operator").agg(F.avg("transfer_rate").alias("transfer_rate"))


# --- vehicle miles -------------------------------------------------------------------------------

DAILY = "Daily"


def percent_of_daily(df: DataFrame, value: str, output: str) -> DataFrame:
    """Percent of the Daily row, or of the sum when there is no positive Daily row."""
    daily = F.sum(F.when(F.col("category") == DAILY, F.col(value))).over(per_run())
    everything = F.sum(value).over(per_run())
    base = F.when(daily > 0, daily).otherwise(everything)
    return df.withColumn(output, share(F.col(value), base))


def miles_by(
    df: DataFrame,
    breakdown: str,
    measure: str = "auto_vmt",
    filters: dict[str, str] | None = None,
    top: int | None = None,
) -> DataFrame:
    """Miles and trips by one column after filters. Daily rows are used where they exist."""
    filters = {k: v for k, v in (filters or {}).items() if v != "All"}
    rows = df
    for column, value in filters.items():
        if column != breakdown:
            rows = rows.filter(F.col(column) == value)
    if breakdown != "time_period" and "time_period" not in filters:
        groups = ["geography_type", "geography_id", "mode", "income_segment", "household_size"]
        has_daily = F.max((F.col("time_period") == DAILY).cast("int")).over(per_run(*groups))
        rows = rows.withColumn("_daily", has_daily).filter(
            (F.col("time_period") == DAILY) | (F.col("_daily") == 0)
        )
    sums = rows.groupBy(RUN, F.col(breakdown).cast("string").alias("category")).agg(
        total(measure).alias(measure), total("trip_count").alias("trip_count")
    )
    if breakdown == "time_period":
        return percent_of_daily(sums, measure, f"{measure}_percent")
    if top is not None:
        order = per_run().orderBy(F.col(measure).desc(), F.col("category"))
        return sums.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= top).drop(
            "_r"
        )
    return sums


def wide_by_period(
    df: DataFrame,
    columns: Sequence[str],
    breakdown: str,
    period_column: str = "tod",
    period: str = DAILY,
) -> DataFrame:
    """A table with one column per type and one row per period, summed by type or period.

    By type, the Daily row is used when there is one, else the period rows are summed. By
    period, a Daily row is added when absent.
    """
    present = [c for c in columns if c in df.columns]
    is_daily = F.lower(F.col(period_column)) == DAILY.lower()
    if breakdown == "type":
        if period not in ("All", DAILY):
            rows = df.filter(F.col(period_column) == period)
        else:
            has_daily = F.max(is_daily.cast("int")).over(per_run())
            marked = df.withColumn("_has", has_daily)
            rows = marked.filter(is_daily | (F.col("_has") == 0)).drop("_has")
        long = rows.unpivot([RUN, period_column], present, "category", "value")
        return long.groupBy(RUN, "category").agg(total("value").alias("value"))
    long = df.unpivot([RUN, period_column], present, "_type", "value")
    sums = long.groupBy(RUN, F.col(period_column).alias("category")).agg(
        total("value").alias("value")
    )
    has_daily = F.max((F.col("category") == DAILY).cast("int")).over(per_run())
    spread = F.when(
        F.col("_has") == 0, F.array(F.col("category"), F.lit(DAILY))
    ).otherwise(F.array(F.col("category")))
    completed = (
        sums.withColumn("_has", has_daily)
        .select(RUN, F.explode(spread).alias("category"), "value")
        .groupBy(RUN, "category")
        .agg(total("value").alias("value"))
    )
    return percent_of_daily(completed, "value", "value_percent")


def total_miles(df: DataFrame, measure: str) -> DataFrame:
    """Miles of a run from the all-geographies Daily rows of a segmented table."""
    rows = df.filter(
        (F.col("geography_type") == ALL_GEOGRAPHIES) & (F.col("time_period") == DAILY)
    )
    return rows.groupBy(RUN).agg(total(measure).alias("vmt"))


def total_wide_miles(df: DataFrame, columns: Sequence[str], period_column: str = "tod") -> DataFrame:
    by_type = wide_by_period(df, columns, "type", period_column)
    return by_type.groupBy(RUN).agg(total("value").alias("vmt"))


def miles_overview(categories: dict[str, DataFrame]) -> DataFrame:
    """Miles by category (each a (run, vmt) table) with their share of the run's total."""
    parts = [
        df.select(RUN, F.lit(name).alias("category"), "vmt") for name, df in categories.items()
    ]
    completed = complete_categories(
        reduce(DataFrame.unionByName, parts), "category", list(categories), ["vmt"]
    )
    return add_percent_of_total(completed, "vmt", "percent_of_total")
