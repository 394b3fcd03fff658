"""Tour profiles: category, purpose, mode, stops, time of day, distance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripweave.functions.expressions import category_token, distance_bin, lowered, total
from tripweave.model import ALL_TOUR_PURPOSES, Config, Run
from tripweave.operators.aggregate import (
    add_totals,
    densify,
    ensure_zero_bin,
    weighted_sum_with_totals,
)
from tripweave.operators.travel_weights import (
    attach_person_travel_weights,
    with_household_tour_weight,
    with_household_tour_weights,
)
from tripweave.plans.counts import Counted, Source, count_summary
from tripweave.plans.registry import summary
from tripweave.plans.summaries.activity import purpose_column
from tripweave.plans.summaries.escort import stop_frequency as stops_by_purpose

ALL_PURPOSES = {"tour_purpose": ALL_TOUR_PURPOSES}
HALF_HOUR_PERIODS = 48
HOUR_PERIODS = 24


def trim_time_bins(dense: DataFrame, observed_max, bin_column: str = "time_bin") -> DataFrame:
    """Keep bins up to 24 when no observed period exceeds 24, else up to 48."""
    last = F.when(observed_max <= HOUR_PERIODS, HOUR_PERIODS).otherwise(HALF_HOUR_PERIODS)
    return dense.filter(F.col(bin_column) <= last)


def weighed_person_tours(run: Run, weights: dict[str, str]) -> DataFrame:
    return attach_person_travel_weights(run, run.tours, "NUMBER_HH", weights)


def weighed_tours_of_category(run: Run, weights: dict[str, str]) -> DataFrame:
    return with_household_tour_weights(
        run.tours.filter(F.col("tour_category").isNotNull()), weights, by=run.by
    )


def weighed_tours_of_purpose(run: Run, weights: dict[str, str]) -> DataFrame:
    purpose = purpose_column(run.tours)
    tours = run.tours.filter(F.col(purpose).isNotNull())
    return with_household_tour_weights(tours, weights, by=run.by)


PERSON_TOURS = Source("tours", weighed_person_tours)
TOURS_OF_CATEGORY = Source("tours", weighed_tours_of_category)
TOURS_OF_PURPOSE = Source("tours", weighed_tours_of_purpose)


@count_summary(
    "tour_category_distribution",
    "tour_category string, tour_count double",
    {"tours": "tour_category finalweight"},
    TOURS_OF_CATEGORY,
)
def tour_category(tours: DataFrame) -> Counted:
    return Counted(F.lit(True), {"tour_category": F.col("tour_category")}, {"tour_count": None})


@count_summary(
    "tour_purpose_distribution",
    "tour_purpose string, tour_count double",
    {"tours": "tour_purpose finalweight"},
    TOURS_OF_PURPOSE,
)
def tour_purpose(tours: DataFrame) -> Counted:
    purpose = F.col(purpose_column(tours)).cast("string")
    return Counted(F.lit(True), {"tour_purpose": purpose}, {"tour_count": None})


SUFFICIENCY_COUNTS = {
    0: "tour_count_zero_auto",
    1: "tour_count_auto_deficient",
    2: "tour_count_auto_sufficient",
}


def with_all_households(counts: DataFrame, extra: list[str]) -> DataFrame:
    overall = sum((F.col(n) for n in SUFFICIENCY_COUNTS.values()), F.lit(0.0))
    return counts.withColumn("tour_count_all_households", overall)


@count_summary(
    "tour_mode_by_tour_purpose_and_auto_sufficiency",
    "tour_mode string, tour_purpose string, tour_count_zero_auto double, "
    "tour_count_auto_deficient double, tour_count_auto_sufficient double, "
    "tour_count_all_households double",
    {"tours": "tour_mode tour_purpose tour_category NUMBER_HH finalweight AUTOSUFF"},
    PERSON_TOURS,
    ALL_PURPOSES,
    with_all_households,
)
def tour_mode(tours: DataFrame) -> Counted:
    purpose = F.col(purpose_column(tours))
    return Counted(
        purpose.isNotNull() & F.col("tour_mode").isNotNull() & F.col("AUTOSUFF").isNotNull(),
        {"tour_mode": F.col("tour_mode"), "tour_purpose": purpose.cast("string")},
        {name: F.col("AUTOSUFF") == k for k, name in SUFFICIENCY_COUNTS.items()},
    )


@summary(
    "tour_stop_frequency_by_tour_purpose",
    "tour_purpose string, outbound_stop_count int, inbound_stop_count int, "
    "total_stop_count int, tour_count double",
    {"tours": "tour_purpose tour_category num_ob_stops num_ib_stops num_tot_stops finalweight"},
)
def stop_frequency(run: Run, config: Config) -> DataFrame:
    tours = with_household_tour_weight(run.tours.filter(F.col("tour_category").isNotNull()))
    return stops_by_purpose(tours, "_tour_weight")


@summary(
    "atwork_subtour_frequency_distribution",
    "atwork_subtour_frequency_category string, atwork_subtour_count double",
    {"tours": "tour_purpose tour_category atwork_subtour_frequency finalweight"},
)
def atwork_subtours(run: Run, config: Config) -> DataFrame:
    tours = run.tours.filter(
        (lowered("tour_purpose") == "work")
        & (lowered("tour_category") == "mandatory")
        & F.col("atwork_subtour_frequency").isNotNull()
    )
    return tours.groupBy(
        F.col("atwork_subtour_frequency").cast("string").alias(
            "atwork_subtour_frequency_category"
        )
    ).agg(total("finalweight").alias("atwork_subtour_count"))


@summary(
    "tour_time_of_day_by_tour_purpose",
    "time_bin int, tour_purpose string, departure_tour_count double, "
    "arrival_tour_count double, duration_tour_count double",
    {"tours": "tour_category tour_purpose finalweight"},
)
def tour_time_of_day(run: Run, config: Config) -> DataFrame:
    purpose = purpose_column(run.tours)
    tours = with_household_tour_weight(run.tours.filter(F.col(purpose).isNotNull()))
    measures = {
        "departure_tour_count": "start_hour",
        "arrival_tour_count": "end_hour",
        "duration_tour_count": "tourdur",
    }
    events = F.array(
        *[
            F.struct(
                F.lit(measure).alias("measure"),
                (F.col(c).cast("int") if c in tours.columns else F.lit(None).cast("int")).alias(
                    "time_bin"
                ),
            )
            for measure, c in measures.items()
        ]
    )
    long = (
        tours.select(
            F.col(purpose).cast("string").alias("tour_purpose"),
            "_tour_weight",
            F.explode(events).alias("_e"),
        )
        .groupBy("tour_purpose", F.col("_e.time_bin").alias("time_bin"))
        .agg(
            *[
                total(F.when(F.col("_e.measure") == m, F.col("_tour_weight"))).alias(m)
                for m in measures
            ]
        )
    )
    counts = add_totals(long, ALL_PURPOSES, ["tour_purpose", "time_bin"], list(measures))
    dense = densify(
        counts, ["tour_purpose"], "time_bin", list(range(HALF_HOUR_PERIODS + 1)), list(measures)
    )
    # Late arrivals and long durations keep the half-hour bins too, not only late departures.
    hours = [F.max(c) for c in ("start_hour", "end_hour", "tourdur") if c in run.tours.columns]
    if not hours:
        return dense
    latest = hours[0] if len(hours) == 1 else F.greatest(*hours)
    return trim_time_bins(dense, run.tours.agg(latest).scalar())


@summary(
    "tour_distance_by_tour_purpose",
    "distance_bin string, tour_purpose string, tour_count double",
    {"tours": "tour_purpose tour_category finalweight"},
)
def tour_distance(run: Run, config: Config) -> DataFrame | None:
    if "SKIMDIST" not in run.tours.columns:
        return None
    purpose = purpose_column(run.tours)
    tours = with_household_tour_weight(
        run.tours.filter(
            F.col(purpose).isNotNull()
            & F.col("SKIMDIST").isNotNull()
            & category_token().isin("non_mandatory", "joint", "atwork")
        )
    )
    rows = tours.select(
        distance_bin("SKIMDIST").alias("distance_bin"),
        F.col(purpose).cast("string").alias("tour_purpose"),
        "_tour_weight",
    ).filter(F.col("distance_bin").isNotNull())
    counts = weighted_sum_with_totals(
        rows, ["distance_bin", "tour_purpose"], "_tour_weight", "tour_count", ALL_PURPOSES
    )
    return ensure_zero_bin(counts, ["tour_purpose"], "tour_count")


