"""Adapter: a travel run built from the star-schema tables (customer, orders, lineitem, ...).

Columns are plain SQL expressions over integer keys, so the same text can be evaluated by an
independent SQL engine. Households come from customers, persons and vehicles by repeating a
household, tours from orders, trips from line items, zones from nations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripweave.functions.expressions import summary_purpose
from tripweave.model import Config, GeographyAggregation, Run

SOURCES = ("region", "nation", "customer", "supplier", "orders", "lineitem", "part")

CONFIG = Config(
    use_maz=False,
    geographies=(GeographyAggregation("district"),),
    group_joint_tour_purposes=False,
    labels={
        "person_type": {
            "1": "Full-time worker",
            "2": "Part-time worker",
            "3": "University student",
        },
        "transit_subsidy": {"1": "Subsidy", "2": "No subsidy"},
    },
    aliases={"pnr_lot_capacity": ("PNR_SPACES",)},
)

ZONE = {
    "zone": "CAST(n_nationkey AS BIGINT)",
    "county": "r_name",
    "district": "'D' || CAST(n_nationkey % 3 AS STRING)",
}

HH = {
    "household_id": "c_custkey",
    "home_zone_id": "CAST(c_nationkey AS BIGINT)",
    "home_taz": "CAST(c_nationkey AS BIGINT)",
    "home_county": "county",
    "home_geo__district": "district",
    "HHSIZE": "1 + c_custkey % 5",
    "HHVEH": "c_custkey % 4",
    "income_segment": "c_mktsegment",
    "av_ownership": "c_custkey % 7 = 0",
    "market": "CASE WHEN c_custkey % 3 = 0 THEN 'north' ELSE 'south' END",
    "finalweight": "1 + CAST(c_custkey % 8 AS DOUBLE) / 8",
}

# Persons: h is the household, n the person number.
PER_KEYS = {
    "person_id": "household_id * 10 + n",
    "n": "n",
    "person_type": "CAST(1 + (household_id * 3 + n) % 8 AS INT)",
    "workplace_zone_id": "CASE WHEN (household_id * 3 + n) % 8 IN (0, 1) AND n <> 5 "
    "THEN (home_zone_id + n * 7 + household_id % 3) % 25 END",
    "school_zone_id": "CASE WHEN (household_id * 3 + n) % 8 IN (2, 5, 6, 7) "
    "THEN (home_zone_id + n * 3) % 25 END",
}
PER = {
    "person_id": "person_id",
    "household_id": "household_id",
    "home_zone_id": "home_zone_id",
    "home_county": "home_county",
    "home_geo__district": "home_geo__district",
    "work_geo__district": "work_district",
    "school_geo__district": "school_district",
    "person_type": "person_type",
    "age": "(household_id * 7 + n * 13) % 90",
    "is_worker": "CASE WHEN person_type IN (1, 2) THEN 'true' ELSE 'false' END",
    "is_student": "CASE WHEN person_type IN (3, 6, 7, 8) THEN 'true' ELSE 'false' END",
    "student_type": "CASE WHEN person_type = 3 THEN 'University' "
    "WHEN person_type >= 6 THEN 'School' END",
    "workplace_zone_id": "workplace_zone_id",
    "external_workplace_zone_id": "CASE WHEN person_type IN (1, 2) AND household_id % 10 = 3 "
    "THEN 20 + household_id % 5 END",
    "is_external_worker": "person_type IN (1, 2) AND household_id % 10 = 3",
    "work_from_home": "CASE WHEN person_type IN (1, 2) AND household_id % 6 = 1 THEN 'true' "
    "ELSE 'false' END",
    "school_zone_id": "school_zone_id",
    "distance_to_work": "CAST(ABS(home_zone_id - workplace_zone_id) AS DOUBLE) * 2.5",
    "distance_to_school": "CAST(ABS(home_zone_id - school_zone_id) AS DOUBLE) * 0.75",
    "has_license": "(household_id + n) % 3 <> 0",
    "bike_comfort": "CASE WHEN n < 5 THEN 'level_' || CAST((household_id + n) % 4 AS STRING) END",
    "transit_pass_ownership": "(household_id + n) % 4 = 0",
    "transit_pass_subsidy": "CASE WHEN n <> 4 THEN 1 + (household_id + n) % 3 END",
    "telecommute_frequency": "CASE (household_id + n) % 4 WHEN 0 THEN 'never' "
    "WHEN 1 THEN '1_day' WHEN 2 THEN '' END",
    "free_parking_at_work": "CASE WHEN n <> 3 THEN 1 + (household_id + n) % 2 END",
    "cdap_activity": "CASE (household_id + n) % 4 WHEN 0 THEN 'M' WHEN 1 THEN 'N' "
    "WHEN 2 THEN 'H' END",
    "imf_choice": "CASE WHEN (household_id + n) % 3 = 0 THEN (household_id + n) % 6 END",
    "finalweight": "finalweight + CAST(n AS DOUBLE) / 8",
}

# Person-days: two days in even households, one in odd ones; p is the person, d the day.
DAY = {
    "day_id": "household_id * 10 + d",
    "person_id": "person_id",
    "household_id": "household_id",
    "day_num": "d",
    "cdap_activity": "CASE (person_id + d) % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'N' END",
    "finalweight": "CASE WHEN person_id % 5 <> 0 THEN CAST(1 + (person_id + d) % 4 AS DOUBLE) / 4 "
    "END",
}

TOUR_KEYS = {
    "pn": "1 + o_orderkey % HHSIZE",
    "k": "o_orderkey",
    "category": "CASE WHEN o_orderstatus = 'P' THEN 'joint' WHEN o_orderstatus = 'O' "
    "THEN 'non_mandatory' WHEN o_orderkey % 7 = 0 THEN 'atwork' ELSE 'mandatory' END",
    "party": "2 + o_orderkey % 3",
    "tour_destination": "(home_zone_id + o_orderkey) % 25",
}
DISCRETIONARY = (
    "CASE o_orderpriority WHEN '1-URGENT' THEN 'shopping' WHEN '2-HIGH' THEN 'othmaint' "
    "WHEN '3-MEDIUM' THEN {} WHEN '4-NOT SPECIFIED' THEN 'social' ELSE 'othdiscr' END"
)
TOURS = {
    "tour_id": "k",
    "household_id": "household_id",
    "person_id": "household_id * 10 + pn",
    "person_type": "CAST(1 + (household_id * 3 + pn) % 8 AS INT)",
    "day_num": "1 + CASE WHEN household_id % 2 = 0 THEN k % 2 ELSE 0 END",
    "day_id": "household_id * 10 + 1 + CASE WHEN household_id % 2 = 0 THEN k % 2 ELSE 0 END",
    "tour_category": "category",
    "tour_purpose": "CASE category "
    "WHEN 'mandatory' THEN CASE k % 3 WHEN 0 THEN 'work' WHEN 1 THEN 'school' "
    "ELSE 'university' END "
    "WHEN 'atwork' THEN CASE k % 3 WHEN 0 THEN 'eat' WHEN 1 THEN 'maint' ELSE 'business' END "
    "WHEN 'joint' THEN " + DISCRETIONARY.format("'eatout'") + " "
    "ELSE " + DISCRETIONARY.format("'escort'") + " END",
    "tour_mode": "CASE k % 8 WHEN 0 THEN 'DRIVEALONE' WHEN 1 THEN 'SHARED2' "
    "WHEN 2 THEN 'SHARED3' WHEN 3 THEN 'WALK' WHEN 4 THEN 'BIKE' WHEN 5 THEN 'WALK_TRANSIT' "
    "WHEN 6 THEN 'PNR_TRANSIT' ELSE 'TNC_SINGLE' END",
    "start_hour": "CAST(1 + k % 40 AS INT)",
    "end_hour": "CAST(1 + (k * 7) % 48 AS INT)",
    "tourdur": "CASE WHEN k % 13 <> 0 THEN CAST((k * 3) % 49 AS INT) END",
    "origin": "home_zone_id",
    "destination": "tour_destination",
    "destination_geo__district": "destination_district",
    "SKIMDIST": "CASE WHEN k % 23 <> 0 THEN CAST(ABS(tour_destination - home_zone_id) AS DOUBLE) "
    "* 2.25 - CASE WHEN k % 19 = 0 THEN 2 ELSE 0 END END",
    "is_external_tour": "CASE WHEN k % 29 <> 0 THEN k % 11 = 0 END",
    "stop_frequency": "CAST(k % 5 AS STRING) || 'out_' || CAST((k * 3) % 4 AS STRING) || 'in'",
    "num_ob_stops": "CAST(k % 5 AS INT)",
    "num_ib_stops": "CAST((k * 3) % 4 AS INT)",
    "num_tot_stops": "CAST(k % 5 + (k * 3) % 4 AS INT)",
    "NUMBER_HH": "CASE WHEN category <> 'joint' THEN 1 WHEN k % 17 = 0 THEN 995 ELSE party END",
    "joint_tour_id": "CASE WHEN category <> 'joint' OR k % 5 = 1 THEN NULL "
    "WHEN k % 5 = 2 THEN 995 "
    "ELSE 1 + household_id * 2 + CASE WHEN household_id % 2 = 0 THEN k % 2 ELSE 0 END END",
    "composition": "CASE WHEN category = 'joint' AND k % 11 <> 0 THEN CASE k % 4 "
    "WHEN 0 THEN 'adults' WHEN 1 THEN 'children' ELSE 'mixed' END END",
    "AUTOSUFF": "CASE WHEN k % 31 = 0 THEN NULL WHEN HHVEH = 0 THEN 0 "
    "WHEN HHVEH < HHSIZE THEN 1 ELSE 2 END",
    "school_esc_outbound": "CASE CAST(FLOOR(k / 3) AS BIGINT) % 5 WHEN 0 THEN 'pure_escort' "
    "WHEN 1 THEN 'Ride Share' WHEN 2 THEN 'none' WHEN 3 THEN '1' END",
    "school_esc_inbound": "CASE CAST(FLOOR(k / 2) AS BIGINT) % 5 WHEN 0 THEN 'pure_escort' "
    "WHEN 1 THEN 'Ride Share' WHEN 2 THEN '' WHEN 3 THEN 'taxi' END",
    "num_escortees": "CASE WHEN k % 4 <> 3 THEN 1 + k % 3 END",
    "atwork_subtour_frequency": "CASE k % 4 WHEN 0 THEN 'no_subtours' WHEN 1 THEN 'eat' "
    "WHEN 2 THEN 'business1' END",
    "vehicle_occup_1": "CASE WHEN k % 6 <> 0 THEN CASE k % 3 WHEN 0 THEN 'Car' WHEN 1 THEN 'SUV' "
    "ELSE 'Van' END || '_' || CAST(k % 26 AS STRING) || '_Gas' END",
    "vehicle_occup_2": "CASE WHEN k % 5 <> 0 THEN 'Car_' || CAST((k * 3) % 26 AS STRING) || "
    "CASE WHEN k % 2 = 0 THEN '_BEV' ELSE '_Gas' END END",
    "vehicle_occup_3.5": "CASE WHEN k % 4 = 0 THEN 'non_av' WHEN k % 4 = 1 THEN 'Van_x_Gas' "
    "ELSE 'Van_' || CAST(k % 20 AS STRING) || '_Hybrid' END",
    "pnr_zone_id": "CASE WHEN k % 8 = 6 THEN 1 + k % 24 END",
    "skim_tour_time": "CASE WHEN k % 8 <> 3 AND k % 5 <> 0 THEN CAST(k % 40 AS DOUBLE) / 2 END",
    "finalweight": "1 + CAST(k % 8 AS DOUBLE) / 8",
}

# Lines of an order are numbered over all other columns, as no shorter key is unique.
LINE_COLUMNS = (
    "l_partkey",
    "l_suppkey",
    "l_linenumber",
    "l_quantity",
    "l_extendedprice",
    "l_discount",
    "l_tax",
    "l_returnflag",
    "l_linestatus",
    "l_shipdate",
)
# A total order of lines as text, for lookups that keep the last row.
LINE_ORDER = " || '_' || ".join(
    f"CAST({c} AS STRING)"
    for c in (
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        "l_linenumber",
        "CAST(l_quantity AS BIGINT)",
        "CAST(l_extendedprice * 100 AS BIGINT)",
    )
)

# Trips: line item columns (with line_no) plus columns of the tour.
TRIPS = {
    "trip_id": "l_orderkey * 10000000 + line_no",
    "tour_id": "l_orderkey",
    "household_id": "household_id",
    "person_id": "person_id",
    "trip_num": "l_linenumber",
    "outbound": "l_linestatus = 'O'",
    "trip_purpose": "CASE l_partkey % 7 WHEN 0 THEN 'work' WHEN 1 THEN 'school' "
    "WHEN 2 THEN 'escort' WHEN 3 THEN 'shopping' WHEN 4 THEN 'social' WHEN 5 THEN 'home' END",
    "trip_mode": "CASE (l_suppkey + l_linenumber) % 8 WHEN 0 THEN 'DRIVEALONE' "
    "WHEN 1 THEN 'SHARED2' WHEN 2 THEN 'SHARED3' WHEN 3 THEN 'WALK' WHEN 4 THEN 'BIKE' "
    "WHEN 5 THEN 'WALK_TRANSIT' WHEN 6 THEN 'PNR_TRANSIT' ELSE 'TNC_SINGLE' END",
    "tour_mode": "tour_mode",
    "tour_purpose": "tour_purpose",
    "tour_category": "tour_category",
    "num_participants": "NUMBER_HH",
    "origin": "l_suppkey % 25",
    "destination": "l_partkey % 25",
    "od_dist": "CASE WHEN l_partkey % 37 <> 0 THEN l_quantity - 1 END",
    "out_dir_dist": "CASE WHEN l_suppkey % 11 <> 0 THEN (l_quantity - 1) / 4 END",
    "depart": "CAST(1 + l_partkey % 48 AS INT)",
    "trip_period": "CASE WHEN l_partkey % 48 < 6 THEN 'EA' WHEN l_partkey % 48 < 14 THEN 'AM' "
    "WHEN l_partkey % 48 < 25 THEN 'MD' WHEN l_partkey % 48 < 34 THEN 'PM' END",
    "stops": "CAST(l_linenumber % 2 AS INT)",
    "parking_zone": "CASE WHEN l_partkey % 5 = 0 THEN l_suppkey % 25 END",
    "joint_trip_id": "CASE WHEN l_suppkey % 2 = 0 THEN l_orderkey * 10 + l_linenumber END",
    "escort_event_role": "CASE WHEN l_partkey % 9 = 0 THEN "
    "CASE WHEN l_linestatus = 'O' THEN 'dropoff' ELSE 'Pickup' END END",
    "escort_stops_before_event": "CAST(l_linenumber - 1 AS INT)",
    "escort_stops_after_event": "CAST(7 - l_linenumber AS INT)",
    "skim_auto_distance": "CASE WHEN (l_suppkey + l_linenumber) % 8 IN (0, 1, 2, 6, 7) "
    "AND l_partkey % 9 <> 1 THEN (l_quantity - 1) / 2 END",
    "skim_walk_distance": "CASE WHEN (l_suppkey + l_linenumber) % 8 = 3 AND l_partkey % 3 = 0 "
    "THEN l_quantity / 8 END",
    "prepared_non_motorized_distance": "CASE WHEN l_partkey % 4 <> 0 THEN l_quantity / 4 END",
    "finalweight": "1 + CAST(l_partkey % 8 AS DOUBLE) / 8",
}

VEHICLES = {
    "vehicle_id": "household_id * 10 + v",
    "household_id": "household_id",
    "vehicle_num": "v",
    "vehicle_type": "CASE (household_id + v) % 3 WHEN 0 THEN 'Car' WHEN 1 THEN 'SUV' ELSE 'Van' "
    "END || '_' || CAST((household_id * 3 + v) % 26 AS STRING) || '_' || "
    "CASE (household_id + v) % 2 WHEN 0 THEN 'Gas' ELSE 'BEV' END",
    "body_type": "CASE (household_id + v) % 3 WHEN 0 THEN 'Car' WHEN 1 THEN 'SUV' ELSE 'Van' END",
    "vehicle_age": "(household_id * 3 + v) % 26",
    "fuel_type": "CASE (household_id + v) % 2 WHEN 0 THEN 'Gas' ELSE 'BEV' END",
    "finalweight": "finalweight",
}

PARTICIPANTS = {
    "tour_id": "tour_id",
    "person_id": "household_id * 10 + n",
    "household_id": "household_id",
}

LAND_USE = {
    "MAZ": "zone",
    "TAZ": "zone",
    "county": "county",
    "land_use_geo__district": "district",
    "employment_count": "CASE WHEN zone <> 7 THEN CAST(suppliers * 12 AS DOUBLE) END",
    "PNR_SPACES": "CAST(20 + zone * 5 AS DOUBLE)",
    "student_type": "CAST(NULL AS STRING)",
    "enrollment_count": "CAST(NULL AS DOUBLE)",
}
LAND_USE_ENROLLMENT = {
    **LAND_USE,
    "employment_count": "CAST(NULL AS DOUBLE)",
    "PNR_SPACES": "CAST(NULL AS DOUBLE)",
    "student_type": "kind",
    "enrollment_count": "CASE WHEN kind = 'School' THEN CAST(zone * 9 AS DOUBLE) "
    "WHEN zone % 4 <> 0 THEN CAST(zone * 4 AS DOUBLE) END",
}

# Count, screenline, transit, commercial and bicycle tables.
_DIRECTION = "CASE WHEN l_linestatus = 'O' THEN 'NB' ELSE 'SB' END"
_PERIOD = "CASE l_linenumber % 3 WHEN 0 THEN 'AM' WHEN 1 THEN 'MD' ELSE 'PM' END"
VALIDATION = {
    "observed_traffic_counts": ("lineitem", {
        "count_location_id": "l_suppkey % 40",
        "direction": _DIRECTION,
        "count_period": _PERIOD,
        "count": "l_quantity",
    }),
    "modeled_traffic_counts": ("lineitem", {
        "count_location_id": "l_suppkey % 45 - 2",
        "direction": _DIRECTION,
        "count_period": _PERIOD,
        "count": "l_quantity + l_partkey % 3",
    }),
    "observed_screenline_flows": ("lineitem", {
        "screenline_id": "'S' || CAST(l_partkey % 12 AS STRING)",
        "direction": _DIRECTION,
        "count_period": _PERIOD,
        "volume": "CASE WHEN l_suppkey % 13 <> 0 THEN l_quantity END",
        "facility_type": "CASE WHEN l_partkey % 4 <> 0 THEN 'F' || CAST(l_partkey % 4 AS STRING) "
        "END",
    }),
    "modeled_screenline_flows": ("lineitem", {
        "screenline_id": "'S' || CAST(l_partkey % 14 AS STRING)",
        "direction": _DIRECTION,
        "count_period": _PERIOD,
        "volume": "l_quantity * 1.25",
        "FACTYPE": "CASE WHEN l_partkey % 14 < 5 THEN l_partkey % 14 END",
    }),
    "transit_boardings": ("orders", {
        "operator_name": "'Op' || CAST(o_custkey % 4 AS STRING)",
        "transit_mode": "CASE WHEN o_orderkey % 3 = 0 THEN 'rail' ELSE 'bus' END",
        "first_mode": "CASE o_orderkey % 4 WHEN 0 THEN 'walk' WHEN 1 THEN 'pnr' WHEN 2 THEN 'knr' "
        "END",
        "boarding_count": "CASE WHEN o_orderkey % 17 <> 0 THEN CAST(o_orderkey % 50 AS DOUBLE) END",
        "linked_trips": "CAST(o_orderkey % 32 AS DOUBLE)",
    }),
    "commercial_vehicle_trips": ("lineitem", {
        "truck_type": "l_returnflag",
        "trip_class": "CASE l_linenumber % 3 WHEN 0 THEN 'External' WHEN 1 THEN 'ee' "
        "ELSE 'internal' END",
        "miles": "l_quantity",
    }),
    "bicycle_assignment_links": ("part", {
        "facility": "p_type",
        "bike_volume": "p_size",
        "length": "CAST(p_size AS DOUBLE) / 4",
    }),
}
# Count locations: one per supplier, volumes linear in counts within a facility type.
COUNTS = {
    "id": "s_suppkey",
    "FACTYPE": "s_suppkey % 4",
    "am_vol": "CAST((s_suppkey * 37) % 500 AS DOUBLE)",
    "md_vol": "CASE WHEN s_suppkey % 9 <> 0 THEN CAST((s_suppkey * 53) % 400 AS DOUBLE) END",
    "pm_vol": "CAST(100 AS DOUBLE)",
    "day_vol": "CAST((s_suppkey * 37) % 500 + (s_suppkey * 53) % 400 AS DOUBLE)",
}
VOLUMES = {
    "id": "s_suppkey + s_suppkey % 11",
    "FACTYPE": "(s_suppkey + s_suppkey % 11) % 4",
    "am_vol": "CAST((s_suppkey * 41) % 600 AS DOUBLE)",
    "md_vol": "CAST((s_suppkey * 59) % 300 AS DOUBLE)",
    "pm_vol": "CAST((s_suppkey * 7) % 250 AS DOUBLE)",
    "day_vol": "CAST(120 AS DOUBLE)",
}


def _select(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{expr} AS `{name}`" for name, expr in columns.items()])


def load(spark: SparkSession, directory: str) -> dict[str, DataFrame]:
    """The source tables; nothing is read until a query needs it."""
    return {name: spark.read.parquet(f"{directory}/{name}.parquet") for name in SOURCES}


def zones(tables: dict[str, DataFrame]) -> DataFrame:
    named = tables["nation"].join(
        tables["region"], F.col("n_regionkey") == F.col("r_regionkey"), "left"
    )
    return _select(named, ZONE)


def _district(zone_table: DataFrame, key: str, name: str) -> DataFrame:
    return zone_table.select(F.col("zone").alias(key), F.col("district").alias(name))


def build_run(tables: dict[str, DataFrame], config: Config = CONFIG, label: str = "base") -> Run:
    """All eight run tables as lazy DataFrames."""
    zone_table = zones(tables)
    customers = tables["customer"].join(
        zone_table, F.col("c_nationkey") == F.col("zone"), "left"
    )
    hh = _select(customers, HH)

    members = hh.withColumn("n", F.explode(F.sequence(F.lit(1), F.col("HHSIZE"))))
    keyed = members.selectExpr(
        "household_id",
        "home_zone_id",
        "home_county",
        "home_geo__district",
        "finalweight",
        *[f"{e} AS `{c}`" for c, e in PER_KEYS.items()],
    )
    per = _select(
        keyed.join(_district(zone_table, "workplace_zone_id", "work_district"),
                   "workplace_zone_id", "left")
        .join(_district(zone_table, "school_zone_id", "school_district"),
              "school_zone_id", "left"),
        PER,
    )

    days = F.sequence(F.lit(1), F.when(F.col("household_id") % 2 == 0, 2).otherwise(1))
    day = _select(
        members.selectExpr("household_id", "household_id * 10 + n AS person_id").withColumn(
            "d", F.explode(days)
        ),
        DAY,
    )

    home = hh.select("household_id", "home_zone_id", "HHSIZE", "HHVEH")
    ordered = tables["orders"].join(home, F.col("o_custkey") == F.col("household_id"))
    tour_rows = ordered.selectExpr(
        "*", *[f"{e} AS `{c}`" for c, e in TOUR_KEYS.items()]
    ).join(
        _district(zone_table, "tour_destination", "destination_district"),
        "tour_destination",
        "left",
    )
    tours = _select(tour_rows, TOURS)
    tours = tours.withColumn("summary_tour_purpose", summary_purpose(tours.columns, config))

    of_tour = tours.select(
        "tour_id",
        "household_id",
        "person_id",
        "tour_mode",
        "tour_purpose",
        "tour_category",
        "NUMBER_HH",
    )
    numbering = Window.partitionBy("l_orderkey").orderBy(*LINE_COLUMNS)
    lines = tables["lineitem"].withColumn("line_no", F.row_number().over(numbering))
    trips = _select(
        lines.join(of_tour, F.col("l_orderkey") == F.col("tour_id")), TRIPS
    )
    trips = trips.withColumn("summary_tour_purpose", summary_purpose(trips.columns, config))

    vehicles = _select(
        hh.filter("HHVEH > 0").withColumn("v", F.explode(F.sequence(F.lit(1), F.col("HHVEH")))),
        VEHICLES,
    )
    party = ordered.filter("o_orderstatus = 'P'").selectExpr(
        "o_orderkey AS tour_id", "household_id", "LEAST(2 + o_orderkey % 3, HHSIZE) AS size"
    )
    participants = _select(
        party.withColumn("n", F.explode(F.sequence(F.lit(1), F.col("size")))), PARTICIPANTS
    )

    per_zone = tables["supplier"].groupBy(F.col("s_nationkey").alias("zone")).agg(
        F.count(F.lit(1)).alias("suppliers")
    )
    land = zone_table.join(per_zone, "zone", "left")
    enrolment = land.withColumn("kind", F.explode(F.array(F.lit("School"), F.lit("University"))))
    land_use = _select(land, LAND_USE).unionByName(
        _select(enrolment, LAND_USE_ENROLLMENT).filter("enrollment_count IS NOT NULL")
    )
    return Run(
        label,
        {
            "hh": hh,
            "per": per,
            "day": day,
            "tours": tours,
            "trips": trips,
            "vehicles": vehicles,
            "joint_participants": participants,
            "land_use": land_use,
        },
    )


def add_validation_tables(run: Run, tables: dict[str, DataFrame]) -> Run:
    """The run with count, screenline, transit, commercial and bicycle tables."""
    extra = {
        name: _select(tables[source], exprs) for name, (source, exprs) in VALIDATION.items()
    }
    return run.with_tables(**extra, transit_assignment=extra["transit_boardings"])


def count_tables(tables: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Observed counts and modelled volumes, one row per location."""
    supplier = tables["supplier"]
    return _select(supplier, COUNTS), _select(supplier, VOLUMES)


def star_run(spark: SparkSession, directory: str, config: Config = CONFIG) -> Run:
    return build_run(load(spark, directory), config)
