"""School-escort summaries: adult-side escorting and students' own school tours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripweave.functions.expressions import (
    clip,
    distance_bin,
    escort_explicit,
    escort_present,
    escort_type,
    is_child,
    lowered,
    total,
    trip_direction,
)
from tripweave.model import Config, Run
from tripweave.operators.aggregate import ensure_zero_bin, weighted_sum
from tripweave.plans.registry import summary
from tripweave.plans.summaries.activity import purpose_column

OUT, IN = "school_esc_outbound", "school_esc_inbound"
ESCORT_COLUMNS = f"{OUT} {IN} finalweight"


def _with_person_columns(run: Run, tours: DataFrame, *columns: str) -> DataFrame:
    """Add person columns the tour table lacks, when persons carry them."""
    wanted = [c for c in columns if c not in tours.columns]
    if not wanted or not run.has("per", "person_id", *wanted):
        return tours
    return tours.join(run.per.select("person_id", *wanted), "person_id", "left")


def adult_escorted_tours(run: Run) -> DataFrame:
    """Escorted tours of adults: those with purpose escort when any exist, else all."""
    tours = _with_person_columns(run, run.tours, "person_type")
    if "person_type" in tours.columns:
        tours = tours.filter(~is_child())
    escorted = tours.filter(escort_present(OUT) | escort_present(IN))
    purpose = purpose_column(tours)
    if purpose is None:
        return escorted
    by_purpose = escorted.filter(lowered(purpose) == "escort")
    has_purpose = run.fact("has_escort_purpose", lambda: not by_purpose.limit(1).isEmpty())
    return by_purpose if has_purpose else escorted


def explicit_escorted_tours(run: Run) -> DataFrame:
    return adult_escorted_tours(run).filter(escort_explicit(OUT) | escort_explicit(IN))


def student_school_tours(run: Run) -> DataFrame | None:
    tours = _with_person_columns(run, run.tours, "person_type")
    purpose = purpose_column(tours)
    if "person_type" not in tours.columns or purpose is None:
        return None
    return tours.filter(is_child() & (lowered(purpose) == "school"))


def student_households(run: Run) -> DataFrame:
    """Households with children of school type, and how many."""
    counts = (
        run.per.filter(F.col("household_id").isNotNull() & is_child())
        .groupBy("household_id")
        .agg(F.count(F.lit(1)).alias("student_count"))
    )
    return run.hh.select(
        "household_id", F.col("finalweight").cast("double").alias("finalweight")
    ).join(counts, "household_id")


def directions(
    outbound: Column, inbound: Column, both: str = "both", either: bool = False
) -> Column:
    """Array of direction labels of one record: outbound, inbound and a combined label.

    ``either`` lists the combined label once per present direction (stacked), otherwise once
    when both directions are present.
    """
    labels = [F.when(outbound, "outbound"), F.when(inbound, "inbound")]
    if either:
        labels += [F.when(outbound, both), F.when(inbound, both)]
    else:
        labels += [F.when(outbound & inbound, both)]
    return F.filter(F.array(*labels), lambda label: label.isNotNull())


@summary("escorted_tour_totals", "tour_count double", {"tours": ESCORT_COLUMNS})
def escorted_tour_totals(run: Run, config: Config) -> DataFrame:
    return adult_escorted_tours(run).agg(total("finalweight").alias("tour_count"))


@summary(
    "school_escorted_tours_by_escort_type_and_direction",
    "escort_type string, direction string, tour_count double",
    {"tours": f"tour_purpose {ESCORT_COLUMNS}"},
)
def escorted_by_type(run: Run, config: Config) -> DataFrame:
    def labelled(column: str, name: str) -> Column:
        return F.when(
            escort_present(column),
            F.array(
                *[
                    F.struct(
                        F.col(column).cast("string").alias("escort_type"),
                        F.lit(d).alias("direction"),
                    )
                    for d in (name, "all_directions")
                ]
            ),
        ).otherwise(F.array())

    rows = adult_escorted_tours(run).select(
        F.explode(F.concat(labelled(OUT, "outbound"), labelled(IN, "inbound"))).alias("_e"),
        "finalweight",
    )
    return weighted_sum(
        rows.select("_e.escort_type", "_e.direction", "finalweight"),
        ["escort_type", "direction"],
        "finalweight",
        "tour_count",
    )


@summary(
    "adult_escorted_tour_purposes_by_direction",
    "tour_purpose string, direction string, tour_count double",
    {"tours": f"tour_purpose {ESCORT_COLUMNS}"},
)
def escorted_purposes(run: Run, config: Config) -> DataFrame:
    tours = adult_escorted_tours(run)
    purpose = F.col(purpose_column(tours))
    rows = tours.filter(purpose.isNotNull()).select(
        purpose.cast("string").alias("tour_purpose"),
        F.explode(
            directions(escort_present(OUT), escort_present(IN), "all_directions", either=True)
        ).alias("direction"),
        "finalweight",
    )
    return weighted_sum(rows, ["tour_purpose", "direction"], "finalweight", "tour_count")


@summary(
    "adult_escorted_tours_by_person_type_and_direction",
    "person_type string, direction string, tour_count double",
    {"tours": ESCORT_COLUMNS},
)
def escorted_by_person_type(run: Run, config: Config) -> DataFrame | None:
    tours = adult_escorted_tours(run)
    if "person_type" not in tours.columns:
        return None
    rows = tours.filter(F.col("person_type").isNotNull()).select(
        F.col("person_type").cast("string").alias("person_type"),
        F.explode(directions(escort_present(OUT), escort_present(IN))).alias("direction"),
        "finalweight",
    )
    return weighted_sum(rows, ["person_type", "direction"], "finalweight", "tour_count")


@summary(
    "student_school_escort_status_by_direction",
    "direction string, escort_type string, tour_count double",
    {"tours": f"tour_purpose {ESCORT_COLUMNS}"},
)
def student_escort_status(run: Run, config: Config) -> DataFrame | None:
    tours = student_school_tours(run)
    if tours is None:
        return None
    outbound, inbound = escort_type(OUT), escort_type(IN)
    combined = F.when(outbound == inbound, outbound).otherwise("ride_share")

    def entry(direction: str, kind: Column) -> Column:
        return F.struct(F.lit(direction).alias("direction"), kind.alias("escort_type"))

    entries = F.array(
        entry("outbound", outbound),
        entry("inbound", inbound),
        F.when(escort_present(OUT) & escort_present(IN), entry("both", combined)),
    )
    rows = tours.select(F.explode(entries).alias("_e"), "finalweight").filter("_e IS NOT NULL")
    return weighted_sum(
        rows.select("_e.direction", "_e.escort_type", "finalweight"),
        ["direction", "escort_type"],
        "finalweight",
        "tour_count",
    )


@summary(
    "student_households_by_student_count",
    "student_count bigint, household_count double",
    {"hh": "household_id finalweight", "per": "household_id person_type"},
)
def students_per_household(run: Run, config: Config) -> DataFrame:
    return weighted_sum(
        student_households(run), ["student_count"], "finalweight", "household_count"
    )


@summary(
    "households_with_school_escorting_by_student_count_and_direction",
    "student_count bigint, direction string, household_count double",
    {
        "hh": "household_id finalweight",
        "per": "household_id person_type",
        "tours": f"tour_purpose {ESCORT_COLUMNS}",
    },
)
def households_with_escorting(run: Run, config: Config) -> DataFrame:
    households = student_households(run)
    tours = student_school_tours(run)
    if tours is not None:
        tours = _with_person_columns(run, tours, "household_id")
    if tours is None or "household_id" not in tours.columns:
        flagged = households.select(
            "*", *[F.lit(False).alias(d) for d in ("outbound", "inbound", "both")]
        )
    else:
        out, inb = escort_present(OUT), escort_present(IN)
        escorting = (
            tours.filter(F.col("household_id").isNotNull())
            .groupBy("household_id")
            .agg(
                F.max(out).alias("outbound"),
                F.max(inb).alias("inbound"),
                F.max(out & inb).alias("both"),
            )
        )
        flagged = households.join(escorting, "household_id", "left")
    counts = flagged.groupBy("student_count").agg(
        *[
            total(F.when(F.col(d), F.col("finalweight"))).alias(d)
            for d in ("outbound", "inbound", "both")
        ]
    )
    return counts.unpivot(
        ["student_count"], ["outbound", "inbound", "both"], "direction", "household_count"
    )


@summary(
    "schoolkids_per_escorted_tour_by_student_count_and_direction",
    "student_count bigint, direction string, avg_schoolkids_per_tour double, tour_count double",
    {
        "hh": "household_id finalweight",
        "per": "household_id person_type",
        "tours": f"{OUT} {IN} num_escortees finalweight",
    },
)
def schoolkids_per_tour(run: Run, config: Config) -> DataFrame | None:
    tours = _with_person_columns(run, adult_escorted_tours(run), "household_id")
    if "household_id" not in tours.columns:
        return None
    w = F.col("finalweight").cast("double")
    rows = (
        tours.filter(F.col("household_id").isNotNull() & F.col("num_escortees").isNotNull())
        .select(
            "household_id",
            w.alias("_w"),
            (F.col("num_escortees").cast("double") * w).alias("_kids"),
            F.explode(directions(escort_present(OUT), escort_present(IN))).alias("direction"),
        )
        .groupBy("household_id", "direction")
        .agg(total("_w").alias("_w"), total("_kids").alias("_kids"))
        .join(student_households(run).select("household_id", "student_count"), "household_id")
    )
    sums = rows.groupBy("student_count", "direction").agg(
        total("_w").alias("tour_count"), total("_kids").alias("_kids")
    )
    mean = F.when(F.col("tour_count") > 0, F.col("_kids") / F.col("tour_count")).otherwise(0.0)
    return sums.select(
        "student_count", "direction", mean.alias("avg_schoolkids_per_tour"), "tour_count"
    )


@summary(
    "adult_escorted_tour_distance_distribution_by_direction",
    "distance_bin string, direction string, tour_count double",
    {"tours": f"SKIMDIST {ESCORT_COLUMNS}"},
)
def escorted_tour_distance(run: Run, config: Config) -> DataFrame:
    rows = (
        adult_escorted_tours(run)
        .select(
            distance_bin("SKIMDIST").alias("distance_bin"),
            F.explode(directions(escort_explicit(OUT), escort_explicit(IN))).alias("direction"),
            "finalweight",
        )
        .filter(F.col("distance_bin").isNotNull())
    )
    counts = weighted_sum(rows, ["distance_bin", "direction"], "finalweight", "tour_count")
    return ensure_zero_bin(counts, ["direction"], "tour_count")


def _trips_on_explicit_tours(run: Run) -> DataFrame:
    tours = explicit_escorted_tours(run).select("tour_id", OUT, IN).distinct()
    trips = run.trips.drop(*[c for c in (OUT, IN) if c in run.trips.columns])
    return trips.join(tours, "tour_id")


@summary(
    "adult_escorted_trip_distance_distribution_by_direction",
    "distance_bin string, direction string, trip_count double",
    {"tours": f"tour_id {OUT} {IN}", "trips": "tour_id od_dist finalweight"},
)
def escorted_trip_distance(run: Run, config: Config) -> DataFrame | None:
    direction = trip_direction(run.trips.columns)
    if direction is None:
        return None
    labels = F.array(
        F.when((direction == "outbound") & escort_explicit(OUT), "outbound"),
        F.when((direction == "inbound") & escort_explicit(IN), "inbound"),
        F.when(escort_explicit(OUT) & escort_explicit(IN), "both"),
    )
    rows = (
        _trips_on_explicit_tours(run)
        .select(
            distance_bin("od_dist").alias("distance_bin"),
            F.explode(labels).alias("direction"),
            "finalweight",
        )
        .filter(F.col("distance_bin").isNotNull() & F.col("direction").isNotNull())
    )
    counts = weighted_sum(rows, ["distance_bin", "direction"], "finalweight", "trip_count")
    return ensure_zero_bin(counts, ["direction"], "trip_count")


@summary(
    "adult_escort_event_stop_distribution",
    "segment string, stop_count int, tour_count double",
    {
        "tours": f"tour_id {OUT} {IN}",
        "trips": "tour_id escort_event_role escort_stops_before_event "
        "escort_stops_after_event finalweight",
    },
)
def escort_event_stops(run: Run, config: Config) -> DataFrame:
    role = lowered("escort_event_role")
    before = F.col("escort_stops_before_event").cast("int")
    after = F.col("escort_stops_after_event").cast("int")

    def segments(leg: str, event: str) -> Column:
        return F.array(
            F.struct(F.lit(f"{leg}_before_{event}").alias("segment"), before.alias("n")),
            F.struct(F.lit(f"{leg}_after_{event}").alias("segment"), after.alias("n")),
        )

    entries = F.when(
        (role == "dropoff") & escort_explicit(OUT), segments("outbound", "dropoff")
    ).when((role == "pickup") & escort_explicit(IN), segments("inbound", "pickup"))
    rows = (
        _trips_on_explicit_tours(run)
        .filter(role.isin("dropoff", "pickup"))
        .select(F.explode(entries).alias("_e"), "finalweight")
    )
    return weighted_sum(
        rows.select("_e.segment", F.col("_e.n").alias("stop_count"), "finalweight"),
        ["segment", "stop_count"],
        "finalweight",
        "tour_count",
    )


@summary(
    "adult_escort_trip_stop_frequency",
    "tour_purpose string, outbound_stop_count int, inbound_stop_count int, "
    "total_stop_count int, tour_count double",
    {"tours": f"tour_purpose {OUT} {IN} num_ob_stops num_ib_stops num_tot_stops finalweight"},
)
def escort_stop_frequency(run: Run, config: Config) -> DataFrame:
    tours = adult_escorted_tours(run)
    return stop_frequency(tours.filter(F.col(purpose_column(tours)).isNotNull()), "finalweight")


def stop_frequency(tours: DataFrame, weight: str) -> DataFrame:
    """Tours by purpose and stop counts, capped at 3 per direction and 6 in all."""
    rows = tours.select(
        F.col(purpose_column(tours)).cast("string").alias("tour_purpose"),
        clip(F.col("num_ob_stops"), 0, 3).cast("int").alias("outbound_stop_count"),
        clip(F.col("num_ib_stops"), 0, 3).cast("int").alias("inbound_stop_count"),
        clip(F.col("num_tot_stops"), 0, 6).cast("int").alias("total_stop_count"),
        weight,
    )
    return weighted_sum(
        rows,
        ["tour_purpose", "outbound_stop_count", "inbound_stop_count", "total_stop_count"],
        weight,
        "tour_count",
    )

