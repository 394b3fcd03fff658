"""Long-term location summaries: distances, flows, land-use targets, residuals, tours by zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from tripweave.functions.expressions import (
    category_token,
    distance_bin,
    distance_bin_labels,
    internal_commuter,
    is_student,
    is_true,
    is_worker,
    lowered,
    normalized,
    residual_metrics,
    total,
    truthy,
    works_from_home,
)
from tripweave.model import ALL_GEOGRAPHIES, Config, Run, first_column
from tripweave.operators.aggregate import (
    across_geographies,
    densify,
    geography_dimensions,
    land_use_dimensions,
    residual_histogram,
    weighted_average_across_geographies,
    weighted_sum,
)
from tripweave.plans.registry import summary
from tripweave.plans.summaries.activity import purpose_column

DISTANCE_CAP = 51
DISTANCE_SCHEMA = (
    "distance_bin string, geography_type string, geography_id string, person_count double"
)
RESIDUAL_COLUMNS = (
    "target_count double, modeled_count double, residual_count double, "
    "absolute_residual_count double, percent_error double"
)
HISTOGRAM_COLUMNS = "bin_start double, bin_end double, geography_count double"


def weight() -> Column:
    return F.col("finalweight")


def home_dimensions(df: DataFrame, config: Config):
    return geography_dimensions(df.columns, config, "home", (config.zone_base, "home_zone_id"))


def work_dimensions(df: DataFrame, config: Config):
    return geography_dimensions(
        df.columns, config, "work", (config.zone_base, "workplace_zone_id")
    )


# --- persons by purpose ------------------------------------------------------------------


def commuters(run: Run) -> DataFrame | None:
    condition = internal_commuter(run.per.columns)
    return None if condition is None else run.per.filter(condition)


def students(run: Run, university: bool, tokens=None) -> DataFrame | None:
    """Students with a school zone: person type 3 (university) or 6 and above (school)."""
    if not run.has("per", "person_type", "is_student", "school_zone_id"):
        return None
    flag = is_student() if tokens is None else truthy("is_student", tokens)
    kind = F.col("person_type").cast("string")
    of_type = kind == "3" if university else kind.try_cast("int") >= 6
    return run.per.filter((F.col("school_zone_id") > 0) & flag & of_type)


def distance_distribution(
    persons: DataFrame | None, distance: str, config: Config
) -> DataFrame | None:
    if persons is None or distance not in persons.columns:
        return None
    binned = persons.withColumn("distance_bin", distance_bin(distance, DISTANCE_CAP)).filter(
        F.col("distance_bin").isNotNull()
    )
    counts = across_geographies(
        binned,
        home_dimensions(binned, config),
        {"person_count": weight()},
        keys=["distance_bin"],
    )
    return densify(
        counts,
        ["geography_type", "geography_id"],
        "distance_bin",
        distance_bin_labels(DISTANCE_CAP),
        ["person_count"],
    )


@summary(
    "work_location_distance_distribution_by_geography",
    DISTANCE_SCHEMA,
    {
        "per": "distance_to_work external_workplace_zone_id finalweight is_external_worker "
        "is_worker work_from_home workplace_zone_id"
    },
)
def work_distance(run: Run, config: Config) -> DataFrame | None:
    return distance_distribution(commuters(run), "distance_to_work", config)


@summary(
    "university_location_distance_distribution_by_geography",
    DISTANCE_SCHEMA,
    {"per": "distance_to_school finalweight"},
)
def university_distance(run: Run, config: Config) -> DataFrame | None:
    return distance_distribution(students(run, True), "distance_to_school", config)


@summary(
    "school_location_distance_distribution_by_geography",
    DISTANCE_SCHEMA,
    {"per": "distance_to_school finalweight"},
)
def school_distance(run: Run, config: Config) -> DataFrame | None:
    return distance_distribution(students(run, False), "distance_to_school", config)


@summary(
    "work_from_home_rate_by_geography",
    "geography_type string, geography_id string, worker_count double, "
    "work_from_home_worker_count double",
    {"per": "is_worker home_zone_id finalweight"},
)
def work_from_home_rate(run: Run, config: Config) -> DataFrame:
    workers = run.per.filter(is_worker() & F.col("home_zone_id").isNotNull())
    at_home = (
        truthy("work_from_home", ("true", "1"))
        if "work_from_home" in workers.columns
        else F.lit(False)
    )
    return across_geographies(
        workers,
        home_dimensions(workers, config),
        {
            "worker_count": weight(),
            "work_from_home_worker_count": F.when(at_home, weight()),
        },
        keep_null_ids=True,
    )


@summary(
    "internal_external_worker_by_geography",
    "geography_type string, geography_id string, internal_worker_count double, "
    "external_worker_count double",
    {"per": "is_worker is_external_worker home_zone_id finalweight"},
)
def internal_external_workers(run: Run, config: Config) -> DataFrame:
    external = truthy("is_external_worker", ("true", "1", "yes", "external"))
    workers = run.per.filter(
        is_worker() & F.col("is_external_worker").isNotNull() & F.col("home_zone_id").isNotNull()
    )
    return across_geographies(
        workers,
        home_dimensions(workers, config),
        {
            "internal_worker_count": F.when(~external, weight()),
            "external_worker_count": F.when(external, weight()),
        },
        keep_null_ids=True,
    )


@summary(
    "external_worker_workplace_locations",
    "geography_type string, geography_id string, external_worker_count double, "
    "all_worker_count double",
    {"per": "is_worker is_external_worker external_workplace_zone_id finalweight"},
)
def external_workplaces(run: Run, config: Config) -> DataFrame:
    base = run.per.filter(
        is_true(F.col("is_external_worker").cast("boolean"))
        & F.col("external_workplace_zone_id").isNotNull()
    )
    dimensions = geography_dimensions(
        base.columns, config, "work", (config.zone_base, "external_workplace_zone_id")
    )
    all_workers = run.per.filter(is_worker()).agg(total("finalweight"))
    return across_geographies(
        base, dimensions, {"external_worker_count": weight()}
    ).withColumn("all_worker_count", all_workers.scalar())


# --- land-use targets and modelled counts -------------------------------------------------


def _aligned(
    targets: DataFrame,
    target_dimensions: list[tuple[str, str]],
    target: Column,
    modeled: DataFrame,
    modeled_dimensions: list[tuple[str, str]],
    names: tuple[str, str],
    keys: tuple[str, ...] = (),
) -> DataFrame | None:
    """Target and modelled sums of the geography levels both sides have (full outer)."""
    shared = {kind for kind, _ in target_dimensions} & {kind for kind, _ in modeled_dimensions}
    if not shared:
        return None
    left = across_geographies(
        targets, [d for d in target_dimensions if d[0] in shared], {names[0]: target}, keys
    )
    right = across_geographies(
        modeled, [d for d in modeled_dimensions if d[0] in shared], {names[1]: weight()}, keys
    )
    on = ["geography_type", "geography_id", *keys]
    joined = left.join(right, on, "full")
    return joined.select(*on, *[F.coalesce(F.col(n), F.lit(0.0)).alias(n) for n in names])


def workplace_targets(run: Run, config: Config) -> DataFrame | None:
    if not (
        run.has("land_use", "MAZ", "employment_count")
        and run.has("per", "workplace_zone_id", "is_worker", "finalweight")
    ):
        return None
    workers = run.per.filter(is_worker() & F.col("workplace_zone_id").isNotNull())
    land_use = run.land_use.filter(F.col("employment_count").isNotNull())
    return _aligned(
        land_use,
        land_use_dimensions(land_use.columns, config),
        F.col("employment_count"),
        workers,
        work_dimensions(workers, config),
        ("employment_count", "worker_count"),
    )


def school_targets(run: Run, config: Config) -> DataFrame | None:
    if not (
        run.has("land_use", "MAZ", "enrollment_count", "student_type")
        and run.has("per", "school_zone_id", "is_student", "finalweight", "student_type")
    ):
        return None
    land_use = run.land_use.filter(
        F.col("student_type").isNotNull() & F.col("enrollment_count").isNotNull()
    )
    pupils = run.per.filter(
        is_student() & F.col("school_zone_id").isNotNull() & F.col("student_type").isNotNull()
    )
    return _aligned(
        land_use,
        land_use_dimensions(land_use.columns, config),
        F.col("enrollment_count"),
        pupils,
        geography_dimensions(
            pupils.columns, config, "school", (config.zone_base, "school_zone_id")
        ),
        ("enrollment_count", "student_count"),
        ("student_type",),
    )


def _residuals(aligned: DataFrame, target: str, modeled: str, keys=()) -> DataFrame:
    metrics = residual_metrics(target, modeled)
    return aligned.select(
        "geography_type",
        "geography_id",
        *keys,
        F.col(target).alias("target_count"),
        F.col(modeled).alias("modeled_count"),
        *[expr.alias(name) for name, expr in metrics.items()],
    )


EMPLOYMENT_INPUTS = {
    "land_use": "MAZ employment_count",
    "per": "workplace_zone_id is_worker finalweight",
}
ENROLLMENT_INPUTS = {
    "land_use": "MAZ enrollment_count student_type",
    "per": "school_zone_id is_student finalweight",
}
ENROLLMENT_RESIDUAL_INPUTS = {
    "land_use": "MAZ enrollment_count student_type",
    "per": "school_zone_id is_student finalweight student_type",
}


@summary(
    "workplace_location_employment_comparison",
    "geography_type string, geography_id string, employment_count double, worker_count double",
    EMPLOYMENT_INPUTS,
)
def employment_comparison(run: Run, config: Config) -> DataFrame | None:
    return workplace_targets(run, config)


@summary(
    "commuting_flows",
    "origin_geography_type string, origin_geography_id string, "
    "destination_geography_type string, destination_geography_id string, commuter_count double",
    {"per": "home_zone_id workplace_zone_id is_worker finalweight"},
)
def commuting_flows(run: Run, config: Config) -> DataFrame:
    workers = run.per.filter(
        is_worker()
        & F.col("home_zone_id").isNotNull()
        & F.col("workplace_zone_id").isNotNull()
    )
    home, work = dict(home_dimensions(workers, config)), dict(work_dimensions(workers, config))
    pairs = [(kind, home[kind], work[kind]) for kind in home if kind in work]
    zone_columns = sorted({c for _, h, w in pairs for c in (h, w)})
    by_zone = weighted_sum(workers, zone_columns, "finalweight", "commuter_count")

    def level(kind: str, origin: Column, destination: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"),
            origin.cast("string").alias("o"),
            destination.cast("string").alias("d"),
        )

    levels = [level(kind, F.col(h), F.col(w)) for kind, h, w in pairs]
    levels.append(level(ALL_GEOGRAPHIES, F.lit(ALL_GEOGRAPHIES), F.lit(ALL_GEOGRAPHIES)))
    return (
        by_zone.select("commuter_count", F.explode(F.array(*levels)).alias("_l"))
        .filter(F.col("_l.o").isNotNull() & F.col("_l.d").isNotNull())
        .groupBy(
            F.col("_l.kind").alias("origin_geography_type"),
            F.col("_l.o").alias("origin_geography_id"),
            F.col("_l.kind").alias("destination_geography_type"),
            F.col("_l.d").alias("destination_geography_id"),
        )
        .agg(total("commuter_count").alias("commuter_count"))
    )


@summary(
    "school_location_enrollment_comparison",
    "geography_type string, geography_id string, student_type string, "
    "enrollment_count double, student_count double",
    ENROLLMENT_INPUTS,
)
def enrollment_comparison(run: Run, config: Config) -> DataFrame | None:
    return school_targets(run, config)


@summary(
    "workplace_shadow_pricing_residuals",
    f"geography_type string, geography_id string, {RESIDUAL_COLUMNS}",
    EMPLOYMENT_INPUTS,
)
def workplace_residuals(run: Run, config: Config) -> DataFrame | None:
    aligned = workplace_targets(run, config)
    return None if aligned is None else _residuals(aligned, "employment_count", "worker_count")


@summary(
    "school_shadow_pricing_residuals",
    f"geography_type string, geography_id string, student_type string, {RESIDUAL_COLUMNS}",
    ENROLLMENT_RESIDUAL_INPUTS,
)
def school_residuals(run: Run, config: Config) -> DataFrame | None:
    aligned = school_targets(run, config)
    if aligned is None:
        return None
    return _residuals(aligned, "enrollment_count", "student_count", ("student_type",))


@summary(
    "workplace_shadow_pricing_residual_histogram",
    f"geography_type string, {HISTOGRAM_COLUMNS}",
    EMPLOYMENT_INPUTS,
)
def workplace_residual_histogram(run: Run, config: Config) -> DataFrame | None:
    residuals = workplace_residuals(run, config)
    if residuals is None:
        return None
    return residual_histogram(residuals, ["geography_type"], "residual_count")


@summary(
    "school_shadow_pricing_residual_histogram",
    f"geography_type string, student_type string, {HISTOGRAM_COLUMNS}",
    ENROLLMENT_RESIDUAL_INPUTS,
)
def school_residual_histogram(run: Run, config: Config) -> DataFrame | None:
    residuals = school_residuals(run, config)
    if residuals is None:
        return None
    # Each residual counts for its own student type and for "All".
    both = residuals.withColumn(
        "student_type", F.explode(F.array(F.col("student_type"), F.lit("All")))
    )
    return residual_histogram(both, ["geography_type", "student_type"], "residual_count")


def park_and_ride_counts(run: Run, config: Config) -> DataFrame | None:
    """Lot use and capacity by geography, or nothing when a used lot has no capacity."""
    capacity = first_column(run.land_use.columns, config.candidates("pnr_lot_capacity"))
    if capacity is None:
        return None
    if run.has("tours", "pnr_zone_id") and "MAZ" in run.land_use.columns:
        key, zone, kind = "pnr_zone_id", "MAZ", "maz"
    elif run.has("tours", "pnr_taz") and "TAZ" in run.land_use.columns:
        key, zone, kind = "pnr_taz", "TAZ", "taz"
    else:
        return None
    modes = sorted(mode.lower() for mode in config.pnr_tour_modes)
    used = (
        run.tours.filter(
            lowered("tour_mode").isin(*modes)
            & F.col(key).isNotNull()
            & F.col("finalweight").isNotNull()
        )
        .groupBy(F.col(key).cast("bigint").alias("_lot"))
        .agg(total("finalweight").alias("pnr_tour_count"))
    )
    dimensions = [(kind, "_lot")]
    columns = []
    if zone == "MAZ" and "TAZ" in run.land_use.columns:
        dimensions.append(("taz", "TAZ"))
        columns.append("TAZ")
    for name, column in land_use_dimensions(run.land_use.columns, config):
        if column not in (zone, *columns):
            dimensions.append((name, column))
            columns.append(column)
    lots = (
        run.land_use.filter(F.col(capacity).isNotNull() & F.col(zone).isNotNull())
        .groupBy(F.col(zone).cast("bigint").alias("_lot"))
        .agg(
            total(F.col(capacity).cast("double")).alias("pnr_lot_capacity"),
            *[F.min(c).alias(c) for c in columns],
        )
    )
    matched = used.join(lots, "_lot", "left")
    incomplete = matched.agg(F.count_if(F.col("pnr_lot_capacity").isNull()))
    complete = matched.filter(incomplete.scalar() == 0)
    return across_geographies(
        complete,
        dimensions,
        {
            "pnr_tour_count": F.col("pnr_tour_count"),
            "pnr_lot_capacity": F.col("pnr_lot_capacity"),
        },
    )


@summary(
    "park_and_ride_location_residuals",
    "geography_type string, geography_id string, pnr_tour_count double, "
    "pnr_lot_capacity double, residual_count double, absolute_residual_count double, "
    "percent_error double",
    {"tours": "tour_mode finalweight", "land_use": ""},
)
def park_and_ride_residuals(run: Run, config: Config) -> DataFrame | None:
    counts = park_and_ride_counts(run, config)
    if counts is None:
        return None
    metrics = residual_metrics("pnr_lot_capacity", "pnr_tour_count")
    return counts.select("*", *[expr.alias(name) for name, expr in metrics.items()])


@summary(
    "park_and_ride_location_residual_histogram",
    f"geography_type string, {HISTOGRAM_COLUMNS}",
    {"tours": "tour_mode finalweight", "land_use": ""},
)
def park_and_ride_histogram(run: Run, config: Config) -> DataFrame | None:
    residuals = park_and_ride_residuals(run, config)
    if residuals is None:
        return None
    return residual_histogram(residuals, ["geography_type"], "residual_count")


@summary(
    "free_parking_eligibility_by_workplace_geography",
    "geography_type string, geography_id string, workers_without_free_parking_count double, "
    "workers_with_free_parking_count double",
    {"per": "is_worker free_parking_at_work workplace_zone_id finalweight"},
)
def free_parking(run: Run, config: Config) -> DataFrame:
    kind = run.per.schema["free_parking_at_work"].dataType
    column = F.col("free_parking_at_work")
    if isinstance(kind, BooleanType):
        free = column
    elif isinstance(kind, NumericType):
        free = column == 2
    else:
        free = normalized("free_parking_at_work").isin("true", "yes", "y", "2")
    workers = run.per.filter(
        is_worker() & F.col("workplace_zone_id").isNotNull() & column.isNotNull()
    )
    return across_geographies(
        workers,
        work_dimensions(workers, config),
        {
            "workers_without_free_parking_count": F.when(~free, weight()),
            "workers_with_free_parking_count": F.when(free, weight()),
        },
        keep_null_ids=True,
        with_all=False,
    )


@summary(
    "telecommute_frequency_distribution",
    "geography_type string, geography_id string, telecommute_frequency string, "
    "person_count double",
    {"per": "telecommute_frequency finalweight is_worker work_from_home home_zone_id"},
)
def telecommute(run: Run, config: Config) -> DataFrame:
    workers = run.per.filter(
        F.col("telecommute_frequency").isNotNull()
        & (F.col("telecommute_frequency") != "")
        & is_worker()
        & ~works_from_home()
    )
    return across_geographies(
        workers,
        home_dimensions(workers, config),
        {"person_count": weight()},
        keys=["telecommute_frequency"],
    )


# --- tours by geography -------------------------------------------------------------------


@summary(
    "average_mandatory_tour_distance_by_purpose_and_geography",
    "mandatory_tour_purpose string, geography_type string, geography_id string, "
    "average_tour_distance double, person_count double",
    {"per": "finalweight home_zone_id"},
)
def mandatory_distance(run: Run, config: Config) -> DataFrame | None:
    """One pass over persons: each person is tagged with the purpose it belongs to."""
    per = run.per
    tagged: list[Column] = []

    def tag(purpose: str, condition: Column, distance: str) -> None:
        if distance in per.columns:
            tagged.append(
                F.when(
                    condition,
                    F.struct(
                        F.lit(purpose).alias("purpose"),
                        F.col(distance).cast("double").alias("distance"),
                    ),
                )
            )

    commuting = internal_commuter(per.columns)
    if commuting is not None:
        tag("work", commuting, "distance_to_work")
    if {"person_type", "is_student", "school_zone_id"} <= set(per.columns):
        pupil = truthy("is_student", ("true", "1")) & (F.col("school_zone_id") > 0)
        kind = F.col("person_type").cast("string")
        tag("university", pupil & (kind == "3"), "distance_to_school")
        tag("school", pupil & (kind.try_cast("int") >= 6), "distance_to_school")
    if not tagged:
        return None
    dimensions = home_dimensions(per, config)
    rows = (
        per.filter(F.col("finalweight").isNotNull())
        .select(
            *[c for _, c in dimensions],
            F.col("finalweight").cast("double").alias("finalweight"),
            F.explode(F.array(*tagged)).alias("_t"),
        )
        .filter(F.col("_t.distance").isNotNull())
        .select(
            "*",
            F.col("_t.purpose").alias("mandatory_tour_purpose"),
            F.col("_t.distance").alias("_distance"),
        )
    )
    return weighted_average_across_geographies(
        rows,
        dimensions,
        "_distance",
        "average_tour_distance",
        keys=["mandatory_tour_purpose"],
        count="person_count",
    )


def _with_home(run: Run, tours: DataFrame, config: Config) -> tuple[DataFrame, list]:
    """Tours with the home geographies of their person."""
    dimensions = home_dimensions(run.per, config)
    columns = [c for _, c in dimensions]
    home = run.per.filter(F.col("home_zone_id").isNotNull()).select("person_id", *columns)
    return tours.drop(*[c for c in columns if c in tours.columns]).join(
        home, "person_id"
    ), dimensions


@summary(
    "average_nonmandatory_tour_distance_by_purpose_and_geography",
    "nonmandatory_tour_purpose string, geography_type string, geography_id string, "
    "average_tour_distance double, tour_count double",
    {"per": "person_id home_zone_id",
     "tours": "person_id tour_category tour_purpose finalweight"},
)
def nonmandatory_distance(run: Run, config: Config) -> DataFrame | None:
    if "SKIMDIST" not in run.tours.columns:
        return None
    tours = run.tours.filter(
        (category_token() == "non_mandatory")
        & F.col("person_id").isNotNull()
        & F.col("tour_purpose").isNotNull()
        & F.col("SKIMDIST").isNotNull()
        & F.col("finalweight").isNotNull()
    ).withColumn(
        "nonmandatory_tour_purpose", F.col(purpose_column(run.tours)).cast("string")
    )
    base, dimensions = _with_home(run, tours, config)
    return weighted_average_across_geographies(
        base,
        dimensions,
        "SKIMDIST",
        "average_tour_distance",
        keys=["nonmandatory_tour_purpose"],
        count="tour_count",
    )


@summary(
    "internal_external_nonmandatory_tour_frequency_by_home_geography",
    "geography_type string, geography_id string, internal_nonmandatory_tour_count double, "
    "external_nonmandatory_tour_count double",
    {"per": "person_id home_zone_id",
     "tours": "person_id tour_category is_external_tour finalweight"},
)
def internal_external_tours(run: Run, config: Config) -> DataFrame:
    tours = run.tours.filter(
        (lowered("tour_category") == "non_mandatory")
        & F.col("person_id").isNotNull()
        & F.col("is_external_tour").isNotNull()
    )
    base, dimensions = _with_home(run, tours, config)
    external = F.col("is_external_tour").cast("boolean")
    return across_geographies(
        base,
        dimensions,
        {
            "internal_nonmandatory_tour_count": F.when(~external, weight()),
            "external_nonmandatory_tour_count": F.when(external, weight()),
        },
    )


@summary(
    "external_nonmandatory_tour_locations",
    "geography_type string, geography_id string, external_nonmandatory_tour_count double",
    {"tours": "tour_category is_external_tour destination finalweight"},
)
def external_tour_locations(run: Run, config: Config) -> DataFrame:
    tours = run.tours.filter(
        (lowered("tour_category") == "non_mandatory")
        & is_true(F.col("is_external_tour").cast("boolean"))
        & F.col("destination").isNotNull()
    )
    dimensions = geography_dimensions(
        tours.columns, config, "destination", (config.zone_base, "destination")
    )
    return across_geographies(
        tours, dimensions, {"external_nonmandatory_tour_count": weight()}
    )
