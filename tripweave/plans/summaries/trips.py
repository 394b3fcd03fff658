"""Trip profiles: purpose, stops, mode, parking, time of day, distance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripweave.functions.expressions import distance_bin, distance_bin_labels, total
from tripweave.model import ALL_TOUR_MODES, ALL_TOUR_PURPOSES, Config, Run, first_column
from tripweave.operators.aggregate import (
    across_geographies,
    add_totals,
    densify,
    ensure_zero_bin,
    geography_dimensions,
)
from tripweave.operators.travel_weights import attach_person_travel_weights
from tripweave.plans.counts import Counted, Source, count_summary
from tripweave.plans.registry import summary
from tripweave.plans.summaries.activity import purpose_column
from tripweave.plans.summaries.tours import ALL_PURPOSES, HALF_HOUR_PERIODS, trim_time_bins


def weighed_trips(run: Run, weights: dict[str, str]) -> DataFrame:
    """Trips with person-travel weights and text ``tour_purpose``."""
    trips = attach_person_travel_weights(run, run.trips, "num_participants", weights)
    return trips.withColumn("tour_purpose", F.col(purpose_column(trips)).cast("string"))


PERSON_TRIPS = Source("trips", weighed_trips)


def is_stop():
    return F.col("stops") == 1


@count_summary(
    "trip_purpose_distribution",
    "tour_purpose string, trip_purpose string, trip_count double",
    {"trips": "tour_purpose trip_purpose finalweight"},
    PERSON_TRIPS,
    ALL_PURPOSES,
)
def trip_purpose(trips: DataFrame) -> Counted:
    return Counted(
        F.col("trip_purpose").isNotNull() & F.col("tour_purpose").isNotNull(),
        {"tour_purpose": F.col("tour_purpose"), "trip_purpose": F.col("trip_purpose")},
        {"trip_count": None},
    )


@count_summary(
    "stop_destination_purpose_by_tour_purpose",
    "stop_destination_purpose string, tour_purpose string, stop_count double",
    {"trips": "stops tour_purpose trip_purpose finalweight"},
    PERSON_TRIPS,
)
def stop_purpose(trips: DataFrame) -> Counted:
    purpose = F.col("trip_purpose").cast("string")
    return Counted(
        is_stop() & F.col("tour_purpose").isNotNull() & F.col("trip_purpose").isNotNull(),
        {"stop_destination_purpose": purpose, "tour_purpose": F.col("tour_purpose")},
        {"stop_count": None},
    )


@count_summary(
    "trip_mode_by_tour_purpose_and_tour_mode",
    "tour_purpose string, tour_mode string, trip_mode string, trip_count double",
    {"trips": "tour_purpose tour_mode trip_mode finalweight"},
    PERSON_TRIPS,
    {"tour_purpose": ALL_TOUR_PURPOSES, "tour_mode": ALL_TOUR_MODES},
)
def trip_mode(trips: DataFrame) -> Counted:
    keys = {name: F.col(name) for name in ("tour_purpose", "tour_mode", "trip_mode")}
    present = F.lit(True)
    for key in keys.values():
        present = present & key.isNotNull()
    return Counted(present, keys, {"trip_count": None})


@summary(
    "parking_locations",
    "geography_type string, geography_id string, trip_count double",
    {"trips": "parking_zone finalweight"},
)
def parking_locations(run: Run, config: Config) -> DataFrame:
    trips = run.trips.filter(F.col("parking_zone").try_cast("bigint") > 0)
    # Only the zone itself is reported: parking zones carry no configured geographies.
    dimensions = geography_dimensions(
        ["parking_zone"], config, "parking", (config.zone_base, "parking_zone")
    )
    return across_geographies(
        trips, dimensions, {"trip_count": F.col("finalweight")}, with_all=False
    )


@summary(
    "trip_departure_time_by_purpose",
    "tour_purpose string, time_bin int, departure_trip_count double, "
    "departure_stop_count double",
    {"trips": "tour_purpose stops finalweight"},
)
def trip_departures(run: Run, config: Config) -> DataFrame | None:
    departure = first_column(run.trips.columns, ("depart", "depart_hour"))
    if departure is None:
        return None
    measures = ["departure_trip_count", "departure_stop_count"]
    detail = (
        weighed_trips(run, {"finalweight": "_w"})
        .groupBy("tour_purpose", F.col(departure).cast("int").alias("time_bin"))
        .agg(
            total("_w").alias(measures[0]),
            total(F.when(is_stop(), F.col("_w"))).alias(measures[1]),
        )
    )
    # Trips without a purpose count in the total only.
    counts = add_totals(detail, ALL_PURPOSES, ["tour_purpose", "time_bin"], measures).filter(
        F.col("tour_purpose").isNotNull()
    )
    dense = densify(
        counts, ["tour_purpose"], "time_bin", list(range(1, HALF_HOUR_PERIODS + 1)), measures
    )
    return trim_time_bins(dense, run.trips.agg(F.max(departure)).scalar())


@count_summary(
    "trip_distance_by_purpose",
    "distance_bin string, tour_purpose string, trip_count double",
    {"trips": "tour_purpose od_dist num_participants finalweight"},
    PERSON_TRIPS,
    ALL_PURPOSES,
    lambda counts, extra: ensure_zero_bin(counts, ["tour_purpose", *extra], "trip_count"),
)
def trip_distance(trips: DataFrame) -> Counted:
    own = distance_bin("od_dist")
    return Counted(
        F.col("tour_purpose").isNotNull() & F.col("od_dist").isNotNull() & own.isNotNull(),
        {"distance_bin": own, "tour_purpose": F.col("tour_purpose")},
        {"trip_count": None},
    )


def dense_stop_bins(counts: DataFrame, extra: list[str]) -> DataFrame:
    """All bins of each purpose; stops without a purpose count in the total only."""
    return densify(
        counts.filter(F.col("tour_purpose").isNotNull()),
        ["tour_purpose", *extra],
        "distance_bin",
        distance_bin_labels(),
        ["stop_count"],
    )


@count_summary(
    "stop_out_of_direction_distance_by_tour_purpose",
    "distance_bin string, tour_purpose string, stop_count double",
    {"trips": "stops out_dir_dist tour_purpose finalweight"},
    PERSON_TRIPS,
    ALL_PURPOSES,
    dense_stop_bins,
)
def stop_out_of_direction(trips: DataFrame) -> Counted:
    own = distance_bin("out_dir_dist")
    return Counted(
        is_stop() & F.col("out_dir_dist").isNotNull() & own.isNotNull(),
        {"distance_bin": own, "tour_purpose": F.col("tour_purpose")},
        {"stop_count": None},
    )
