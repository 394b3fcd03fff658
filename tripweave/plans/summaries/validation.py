"""Validation against counts, transit and commercial tables, and vehicle-miles summaries.

Count, transit, commercial and bicycle tables are optional run tables that the caller adds
under the names used below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripweave.functions.expressions import (
    NON_MOTORIZED_MODES,
    auto_mode,
    is_true,
    lowered,
    stated_occupancy,
    total,
)
from tripweave.model import ALL_GEOGRAPHIES, Config, Run
from tripweave.operators.aggregate import (
    DAILY,
    geography_dimensions,
    resolve,
    with_daily_rows,
)
from tripweave.plans.registry import summary

ALL_INCOME_SEGMENTS = "all_income_segments"
ALL_HOUSEHOLD_SIZES = "all_household_sizes"
ALL_AUTO_MODES = "All Auto"

# Accepted column names of the optional tables, first match wins.
OPERATOR = ("operator", "operator_name", "transit_operator", "line_operator")
TECHNOLOGY = ("technology", "mode", "transit_mode", "system")
ACCESS_MODE = (
    "access_mode",
    "accessmode",
    "trip_access_mode",
    "first_mode",
    "boarding_access_mode",
)
BOARDINGS = ("boardings", "boarding_count", "volume", "passenger_volume", "transit_boardings")
ASSIGNED_BOARDINGS = (
    "assigned_boardings",
    "boardings",
    "transit_boardings",
    "boarding_count",
    "passenger_boardings",
)
LINKED_TRIPS = (
    "linked_trips",
    "linked_trip_count",
    "transit_linked_trips",
    "passenger_trips",
    "trips",
)
COMMERCIAL_TYPE = ("commercial_vehicle_type", "vehicle_type", "truck_type", "mode", "veh_type")
TRIP_CLASS = ("trip_class", "internal_external", "trip_type", "externality")
IS_EXTERNAL = ("is_external", "external_trip", "is_external_trip")
COMMERCIAL_VMT = ("vmt", "trip_vmt", "distance", "trip_distance", "miles")
EXTERNAL_CLASSES = ("external", "ext", "ie_external", "ee", "external_trip")
BIKE_FACILITY = (
    "facility_type",
    "bike_facility_type",
    "bicycle_facility_type",
    "facility",
    "bike_facility",
    "link_facility_type",
)
BIKE_VMT = ("bicycle_vmt", "bike_vmt", "vmt")
BIKE_TRIPS = (
    "assigned_bicycle_trips",
    "assigned_bike_trips",
    "bike_trips",
    "bicycle_volume",
    "bike_volume",
    "volume",
)
LINK_LENGTH = ("link_distance", "distance", "length", "link_length", "miles")


def all_present(*columns: str) -> Column:
    condition = F.lit(True)
    for name in columns:
        condition = condition & F.col(name).isNotNull()
    return condition


# --- counts and flows --------------------------------------------------------------------


@summary(
    "traffic_count_comparisons",
    "count_location_id string, direction string, count_period string, observed_volume double, "
    "modeled_volume double",
    {
        "observed_traffic_counts": "count_location_id direction count_period count",
        "modeled_traffic_counts": "count_location_id direction count_period count",
    },
)
def traffic_counts(run: Run, config: Config) -> DataFrame:
    keys = ["count_location_id", "direction", "count_period"]

    def volumes(table: DataFrame, name: str) -> DataFrame:
        rows = table.filter(all_present(*keys, "count"))
        return rows.groupBy(*[F.col(k).cast("string").alias(k) for k in keys]).agg(
            total(F.col("count")).alias(name)
        )

    return volumes(run.observed_traffic_counts, "observed_volume").join(
        volumes(run.modeled_traffic_counts, "modeled_volume"), keys
    )


@summary(
    "screenline_flow_comparisons",
    "screenline_id string, direction string, count_period string, facility_type string, "
    "observed_volume double, modeled_volume double",
    {
        "observed_screenline_flows": "screenline_id direction count_period volume",
        "modeled_screenline_flows": "screenline_id direction count_period volume",
    },
)
def screenlines(run: Run, config: Config) -> DataFrame:
    keys = ["screenline_id", "direction", "count_period"]

    def flows(table: DataFrame, name: str) -> DataFrame:
        (facility,) = resolve(table.columns, ("facility_type", "FACTYPE"))
        label = F.col(facility) if facility else F.lit(None)
        rows = table.filter(all_present(*keys, "volume"))
        return rows.groupBy(*[F.col(k).cast("string").alias(k) for k in keys]).agg(
            total("volume").alias(name), F.min(label.cast("string")).alias(f"_{name}_type")
        )

    observed = flows(run.observed_screenline_flows, "observed_volume")
    modeled = flows(run.modeled_screenline_flows, "modeled_volume")
    return observed.join(modeled, keys).select(
        *keys,
        F.coalesce("_modeled_volume_type", "_observed_volume_type", F.lit("All")).alias(
            "facility_type"
        ),
        "observed_volume",
        "modeled_volume",
    )


@summary(
    "transit_boardings_by_operator_and_technology",
    "operator string, technology string, boardings double",
    {"transit_boardings": ""},
)
def transit_boardings(run: Run, config: Config) -> DataFrame | None:
    table = run.transit_boardings
    operator, technology, boardings = resolve(table.columns, OPERATOR, TECHNOLOGY, BOARDINGS)
    if None in (operator, technology, boardings):
        return None
    return (
        table.filter(all_present(operator, technology, boardings))
        .groupBy(
            F.col(operator).cast("string").alias("operator"),
            F.col(technology).cast("string").alias("technology"),
        )
        .agg(total(boardings).alias("boardings"))
    )


@summary(
    "transit_transfer_rate",
    "operator string, technology string, access_mode string, transfer_rate double",
    {"transit_assignment": ""},
)
def transit_transfers(run: Run, config: Config) -> DataFrame | None:
    table = run.transit_assignment
    names = resolve(
        table.columns, OPERATOR, TECHNOLOGY, ACCESS_MODE, ASSIGNED_BOARDINGS, LINKED_TRIPS
    )
    if None in names:
        return None
    operator, technology, access, boardings, linked = names
    sums = (
        table.filter(all_present(operator, technology, access))
        .groupBy(
            F.col(operator).cast("string").alias("operator"),
            F.col(technology).cast("string").alias("technology"),
            F.col(access).cast("string").alias("access_mode"),
        )
        .agg(total(boardings).alias("_boardings"), total(linked).alias("_linked"))
    )
    return sums.select(
        "operator",
        "technology",
        "access_mode",
        F.when(F.col("_linked") > 0, F.col("_boardings") / F.col("_linked")).alias(
            "transfer_rate"
        ),
    )


# --- vehicle miles -----------------------------------------------------------------------


def _with_occupancy(trips: DataFrame) -> DataFrame:
    """Add ``_occupancy``. Household-level joint records and escort events count once.

    A joint trip stored as several person records (same joint trip id) is divided by its
    occupancy instead; only those ids are joined back.
    """
    stated = stated_occupancy(trips.columns)
    once: Column = F.lit(False)
    if "escort_event_role" in trips.columns:
        once = F.col("escort_event_role").isNotNull()
    if "tour_category" not in trips.columns:
        return trips.withColumn("_occupancy", F.when(once, 1.0).otherwise(stated))
    joint = is_true(lowered("tour_category") == "joint")
    if "joint_trip_id" not in trips.columns:
        return trips.withColumn("_occupancy", F.when(once | joint, 1.0).otherwise(stated))
    identified = joint & F.col("joint_trip_id").isNotNull()
    keys = ["tour_category", "joint_trip_id"]
    shared = (
        trips.filter(identified)
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .filter("_rows > 1")
    )
    rest = trips.filter(~identified).withColumn(
        "_occupancy", F.when(once | joint, 1.0).otherwise(stated)
    )
    matched = (
        trips.filter(identified)
        .join(shared, keys, "left")
        .withColumn(
            "_occupancy", F.when(once | F.col("_rows").isNull(), 1.0).otherwise(stated)
        )
        .drop("_rows")
    )
    return rest.unionByName(matched)


def auto_miles(run: Run, config: Config) -> tuple[DataFrame, str] | None:
    """Personal auto trips with ``auto_vmt`` = distance x weight / occupancy."""
    trips = run.trips
    if not run.has("trips", "finalweight", "trip_mode"):
        return None
    base = None
    if "skim_auto_distance" in trips.columns:
        looked_up = trips.filter(
            auto_mode(config, include_drive_transit=True)
            & F.col("skim_auto_distance").isNotNull()
        )
        if run.fact("has_auto_distance", lambda: not looked_up.limit(1).isEmpty()):
            base, source = looked_up, "skim_auto_distance"
    if base is None and "od_dist" in trips.columns:
        base = trips.filter(
            auto_mode(config, include_drive_transit=False) & F.col("od_dist").isNotNull()
        )
        source = "od_dist"
    if base is None:
        return None
    miles = (
        F.col(source).cast("double") * F.col("finalweight").cast("double") / F.col("_occupancy")
    )
    return (
        _with_occupancy(base)
        .withColumn("auto_vmt", miles)
        .filter(F.col("auto_vmt").isNotNull()),
        source,
    )


def non_motorized_miles(run: Run) -> DataFrame | None:
    """Walk and bike trips with ``non_motorized_vmt`` and the distance source used.

    Zone-level walk or bike lookups come first (fine zones, then coarse), then the prepared
    distance.
    """
    if not run.has("trips", "finalweight", "trip_mode"):
        return None
    columns = run.trips.columns
    prepared = [c for c in ("prepared_non_motorized_distance",) if c in columns]
    walk = [c for c in ("skim_walk_maz_distance", "skim_walk_distance") if c in columns]
    bike = [c for c in ("skim_bike_maz_distance", "skim_bike_distance") if c in columns]
    if not (walk or bike or prepared):
        return None

    def first_usable(names: list[str]) -> tuple[Column, Column]:
        if not names:
            return F.lit(None).cast("double"), F.lit(None).cast("string")
        return (
            F.coalesce(*[F.col(c).cast("double") for c in names]),
            F.coalesce(*[F.when(F.col(c).isNotNull(), c) for c in names]),
        )

    mode = F.upper(F.col("trip_mode").cast("string"))
    walk_distance, walk_source = first_usable([*walk, *prepared])
    bike_distance, bike_source = first_usable([*bike, *prepared])
    is_walk = mode == "WALK"
    return (
        run.trips.filter(mode.isin(*NON_MOTORIZED_MODES))
        .withColumn("mode", mode)
        .withColumn("_distance", F.when(is_walk, walk_distance).otherwise(bike_distance))
        .withColumn("distance_source", F.when(is_walk, walk_source).otherwise(bike_source))
        .filter(F.col("_distance").isNotNull() & F.col("finalweight").isNotNull())
        .withColumn("non_motorized_vmt", F.col("_distance") * F.col("finalweight").cast("double"))
    )


def with_time_period(run: Run, trips: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Trip period when any trip has one (others Daily), else Daily throughout."""
    if "trip_period" in trips.columns:
        present = run.fact(
            f"has_trip_period:{name}",
            lambda: not trips.filter(F.col("trip_period").isNotNull()).limit(1).isEmpty(),
        )
        if present:
            period = F.coalesce(F.col("trip_period").cast("string"), F.lit(DAILY))
            return trips.withColumn("time_period", period), "trip_period"
    return trips.withColumn("time_period", F.lit(DAILY)), "daily"


def with_household_segments(run: Run, trips: DataFrame) -> DataFrame:
    """Attach household income, size and home geographies; the trip's own income comes first."""
    household: list[str] = []
    if "household_id" in trips.columns and run.has("hh", "household_id"):
        wanted = ("income_segment", "HHSIZE", "hhsize", "home_taz", "home_county", "home_mpo")
        household = [c for c in wanted if c in run.hh.columns]
        household += sorted(c for c in run.hh.columns if c.startswith("home_geo__"))
        replaced = [c for c in household if c != "income_segment" and c in trips.columns]
        attributes = run.hh.select(
            "household_id",
            *[
                F.col(c).alias("_hh_income" if c == "income_segment" else c)
                for c in household
            ],
        )
        trips = trips.drop(*replaced).join(attributes, "household_id", "left")
    incomes = [c for c in ("income_segment", "_hh_income") if c in trips.columns]
    income = [F.col(c).cast("string") for c in incomes] + [F.lit(ALL_INCOME_SEGMENTS)]
    sizes = [F.col(c).cast("string") for c in ("HHSIZE", "hhsize") if c in trips.columns][:1]
    return trips.withColumn("_income", F.coalesce(*income)).withColumn(
        "household_size", F.coalesce(*sizes, F.lit(ALL_HOUSEHOLD_SIZES))
    )


def miles_by_segment(
    trips: DataFrame,
    config: Config,
    measure: str,
    period_source: str,
    source: Column | None,
) -> DataFrame:
    """Miles and trips by home geography, income, household size, period and mode.

    Trips are summed once over all keys; geography levels and Daily rows come from that.
    """
    dimensions = geography_dimensions(trips.columns, config, "home", ("home_taz", "home_taz"))
    keys = ["income_segment", "household_size", "time_period", "mode"]
    carried = trips.withColumn("income_segment", F.col("_income")).withColumn(
        "_source", source if source is not None else F.col("distance_source")
    )
    by_zone = carried.groupBy(*keys, *[c for _, c in dimensions]).agg(
        total(measure).alias(measure),
        total(F.col("finalweight").cast("double")).alias("trip_count"),
        F.min("_source").alias("distance_source"),
    )
    levels = [
        F.struct(
            F.lit(ALL_GEOGRAPHIES).alias("geography_type"),
            F.lit(ALL_GEOGRAPHIES).alias("geography_id"),
        )
    ] + [
        F.struct(
            F.lit(kind).alias("geography_type"),
            F.col(column).cast("string").alias("geography_id"),
        )
        for kind, column in dimensions
    ]
    detail = (
        by_zone.select("*", F.explode(F.array(*levels)).alias("_g"))
        .filter(F.col("_g.geography_id").isNotNull())
        .groupBy(
            F.col("_g.geography_type").alias("geography_type"),
            F.col("_g.geography_id").alias("geography_id"),
            *keys,
        )
        .agg(
            total(measure).alias(measure),
            total("trip_count").alias("trip_count"),
            F.min("distance_source").alias("distance_source"),
        )
    )
    return with_daily_rows(
        detail,
        ["geography_type", "geography_id", "income_segment", "household_size", "mode"],
        [measure, "trip_count"],
        ["distance_source"],
    ).withColumn("time_period_source", F.lit(period_source))


@summary("auto_vmt_totals", "auto_vmt double", {"trips": "trip_mode finalweight"})
def auto_vmt_totals(run: Run, config: Config) -> DataFrame:
    selected = auto_miles(run, config)
    if selected is None:
        return run.trips.sparkSession.range(1).select(F.lit(0.0).alias("auto_vmt"))
    return selected[0].agg(total("auto_vmt").alias("auto_vmt"))


SEGMENT_COLUMNS = (
    "geography_type string, geography_id string, income_segment string, household_size string, "
    "time_period string, mode string, {measure} double, trip_count double, "
    "distance_source string, time_period_source string"
)


@summary(
    "auto_vmt_by_home_geography_income_hhsize_time_period",
    SEGMENT_COLUMNS.format(measure="auto_vmt"),
    {"trips": "trip_mode finalweight"},
)
def auto_vmt_by_segment(run: Run, config: Config) -> DataFrame | None:
    selected = auto_miles(run, config)
    if selected is None:
        return None
    trips, source = selected
    trips, period_source = with_time_period(run, trips, "auto")
    trips = with_household_segments(run, trips).withColumn(
        "mode", F.coalesce(F.col("trip_mode").cast("string"), F.lit(ALL_AUTO_MODES))
    )
    return miles_by_segment(trips, config, "auto_vmt", period_source, F.lit(source))


@summary(
    "non_motorized_vmt_by_home_geography_income_hhsize_time_period",
    SEGMENT_COLUMNS.format(measure="non_motorized_vmt"),
    {"trips": "finalweight trip_mode"},
)
def non_motorized_vmt_by_segment(run: Run, config: Config) -> DataFrame | None:
    trips = non_motorized_miles(run)
    if trips is None:
        return None
    trips, period_source = with_time_period(run, trips, "non_motorized")
    trips = with_household_segments(run, trips)
    return miles_by_segment(trips, config, "non_motorized_vmt", period_source, None)


@summary(
    "commercial_vmt_totals",
    "commercial_vehicle_type string, external_vmt double, internal_vmt double",
    {"commercial_vehicle_trips": ""},
)
def commercial_vmt(run: Run, config: Config) -> DataFrame | None:
    table = run.commercial_vehicle_trips
    kind, flag, trip_class, miles = resolve(
        table.columns, COMMERCIAL_TYPE, IS_EXTERNAL, TRIP_CLASS, COMMERCIAL_VMT
    )
    if kind is None or miles is None or (flag is None and trip_class is None):
        return None
    external = (
        F.col(flag).cast("boolean") if flag else lowered(trip_class).isin(*EXTERNAL_CLASSES)
    )
    rows = table.select(
        F.col(kind).cast("string").alias("commercial_vehicle_type"),
        F.col(miles).cast("double").alias("_vmt"),
        external.alias("_external"),
    ).filter(all_present("commercial_vehicle_type", "_vmt", "_external"))
    return rows.groupBy("commercial_vehicle_type").agg(
        total(F.when(F.col("_external"), F.col("_vmt"))).alias("external_vmt"),
        total(F.when(~F.col("_external"), F.col("_vmt"))).alias("internal_vmt"),
    )


@summary(
    "bicycle_vmt_by_facility_type",
    "facility_type string, bicycle_vmt double",
    {"bicycle_assignment_links": ""},
)
def bicycle_vmt(run: Run, config: Config) -> DataFrame | None:
    table = run.bicycle_assignment_links
    facility, miles, trips, length = resolve(
        table.columns, BIKE_FACILITY, BIKE_VMT, BIKE_TRIPS, LINK_LENGTH
    )
    if facility is None or (miles is None and (trips is None or length is None)):
        return None
    value = (
        F.col(miles).cast("double")
        if miles
        else F.col(trips).cast("double") * F.col(length).cast("double")
    )
    rows = table.select(
        F.col(facility).cast("string").alias("facility_type"), value.alias("_vmt")
    ).filter(all_present("facility_type", "_vmt"))
    return rows.groupBy("facility_type").agg(total("_vmt").alias("bicycle_vmt"))
