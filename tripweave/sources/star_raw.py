"""Raw (not yet prepared) tables over the star-schema run, for the preparation queries."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripweave.model import Config, GeographyAggregation, Run, StudentType
from tripweave.operators.zones import Skim, explode_matrix
from tripweave.sources import star

CONFIG = Config(
    use_maz=True,
    geography_column="county",
    geography_labels={"ASIA": "Asia", "EUROPE": "Europe"},
    sample_rate_column="sample_rate",
    escort_labels={"1": "pure_escort", "Ride Share": "ride_share", "none": "not_escorted"},
    student_types=(
        StudentType("University", ("college",), is_university=True),
        StudentType("High school", ("high",), school_segment=("high",)),
        StudentType("Grade school", ("grade", "nursery"), is_university=False,
                    school_segment=("grade",)),
    ),
    period_breakpoints=(0, 6, 12, 25, 32, 48),
    period_labels=("EA", "AM", "MD", "PM", "EV"),
)
COARSE_ZONES = 10

HH = {
    "household_id": "household_id",
    "hhsize": "1 + household_id % 8",
    "auto_ownership": "household_id % 7",
    "num_workers": "household_id % 3",
    "num_adults": "1 + household_id % 3",
    "home_zone_id": "CASE WHEN household_id % 50 = 7 THEN 99 ELSE home_zone_id END",
    "home_county": "home_county",
    "income": "household_id % 4",
    "sample_rate": "CASE WHEN household_id % 2 = 0 THEN CAST(1 AS DOUBLE) / 4 "
    "ELSE CAST(1 AS DOUBLE) / 2 END",
    "hh_weight": "finalweight",
}
PER = {
    "person_id": "person_id",
    "household_id": "household_id",
    "ptype": "person_type",
    "age": "age",
    "is_worker": "CASE WHEN person_type IN (1, 2) THEN 'Yes' ELSE 'no' END",
    "work_from_home": "CASE WHEN household_id % 6 = 1 THEN '1' WHEN household_id % 6 = 2 THEN NULL "
    "ELSE '0' END",
    "external_worker_identification": "CASE WHEN household_id % 4 <> 1 THEN 'TRUE' END",
    "adult": "CASE WHEN age >= 18 THEN 1 ELSE 0 END",
    "has_license": "CASE WHEN age >= 18 AND person_id % 3 <> 0 THEN 'licensed' "
    "WHEN person_id % 7 = 0 THEN NULL ELSE 'no' END",
    "workplace_zone_id": "workplace_zone_id",
    "school_zone_id": "school_zone_id",
    "home_county": "CASE WHEN person_id % 4 = 0 THEN 'own' END",
    "mandatory_tour_frequency": "CASE person_id % 7 WHEN 0 THEN 'work1' WHEN 1 THEN 'work2' "
    "WHEN 2 THEN 'school1' WHEN 3 THEN 'school2' WHEN 4 THEN 'work_and_school' WHEN 5 THEN 'x' END",
    "student": "CASE WHEN person_type IN (3, 6, 7, 8) THEN 'T' ELSE 'false' END",
    "major_uni": "CASE WHEN person_type = 3 THEN 'y' ELSE 'n' END",
    "school_segment": "CASE WHEN person_type = 6 THEN 'high' WHEN person_type >= 7 THEN 'grade' "
    "END",
    "person_weight": "CASE WHEN person_id % 9 <> 0 THEN finalweight END",
}
DAY = {
    "day_id": "day_id",
    "person_id": "CASE WHEN person_id % 11 = 0 THEN -1 ELSE person_id END",
    "hh_id": "household_id",
    "day_weight": "finalweight",
}
TOURS = {
    "tour_id": "tour_id",
    "household_id": "household_id",
    "person_id": "person_id",
    "tour_category": "CASE WHEN tour_category = 'atwork' THEN ' AtWork ' ELSE tour_category END",
    "tour_mode": "tour_mode",
    "tour_purpose": "tour_id % 5",
    "primary_purpose": "tour_purpose",
    "start": "start_hour",
    "end": "end_hour",
    "origin": "(tour_id * 3) % 25",
    "destination": "destination",
    "stop_frequency": "stop_frequency",
    "parent_tour_id": "CASE WHEN tour_category = 'atwork' AND tour_id % 2 = 1 THEN "
    "CAST(tour_id - 1 AS DOUBLE) END",
    "number_of_participants": "CASE WHEN tour_id % 6 = 0 THEN 4 END",
    "pnr_zone_id": "pnr_zone_id",
    "out_escort_type": "CASE WHEN tour_id % 4 = 0 THEN ' ' ELSE school_esc_outbound END",
    "out_escorting_type": "CASE WHEN tour_id % 8 = 0 THEN 'pure_escort' END",
    "inb_escort_type": "school_esc_inbound",
    "num_escorted": "CASE WHEN tour_id % 10 = 0 THEN 9 END",
    "out_escorted_tour_ids": "CASE tour_id % 4 WHEN 0 THEN CAST(tour_id + 1 AS STRING) WHEN 1 THEN "
    "CAST(tour_id + 1 AS STRING) || '_' || CAST(tour_id + 2 AS STRING) WHEN 2 THEN '' END",
    "inb_escorted_tour_ids": "CASE WHEN tour_id % 3 = 0 THEN CAST(tour_id + 3 AS STRING) END",
    "vot_bin_raw": "CASE tour_id % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'high' WHEN 2 THEN 'odd' END",
    "tour_start_hour": "CASE WHEN tour_id % 30 = 0 THEN 25 ELSE tour_id % 24 END",
    "tour_start_minute": "tour_id % 60",
}
TRIPS = {
    "trip_id": "trip_id",
    "tour_id": "tour_id",
    "household_id": "household_id",
    "person_id": "person_id",
    "trip_mode": "trip_mode",
    "purpose": "trip_purpose",
    "depart": "depart",
    "outbound": "outbound",
    "trip_num": "trip_num",
    "origin": "origin",
    "destination": "destination",
    "escort_participants": "CASE WHEN trip_id % 3 <> 0 THEN CAST(household_id AS STRING) || '_' || "
    "CAST(trip_num AS STRING) END",
    "trip_weight": "CASE WHEN trip_id % 5 <> 0 THEN finalweight END",
}
LAND_USE = {
    "zone_id": "MAZ",
    "TAZ": f"TAZ % {COARSE_ZONES}",
    "county": "county",
    "EMPLOY_TOT": "employment_count",
    "college": "CASE WHEN MAZ % 3 = 0 THEN CAST(MAZ * 10 AS DOUBLE) END",
    "high": "CAST(MAZ * 4 AS DOUBLE)",
    "grade": "CAST(MAZ * 6 AS DOUBLE)",
    "nursery": "CASE WHEN MAZ % 5 <> 0 THEN CAST(MAZ AS DOUBLE) END",
}
# Matrix rows: one per coarse zone, with some missing and some sentinel cells.
MATRICES = {
    "DIST": "transform(sequence(0, 9), d -> CASE WHEN (o * 7 + d) % 23 = 0 THEN NULL "
    "ELSE CAST(abs(o - d) AS DOUBLE) * 1.5 + 1 END)",
    "TIME__AM": "transform(sequence(0, 9), d -> CASE WHEN (o * 3 + d) % 11 = 0 THEN 9999.0D "
    "ELSE CAST(abs(o - d) AS DOUBLE) * 4 + 2 END)",
    "TIME__MD": "transform(sequence(0, 9), d -> CAST(abs(o - d) AS DOUBLE) * 3 + 1)",
}


def matrix_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """(matrix, o_idx, values) rows of every matrix, one matrix row per coarse zone."""
    origins = (
        tables["nation"].selectExpr(f"CAST(n_nationkey % {COARSE_ZONES} AS INT) AS o").distinct()
    )
    return origins.selectExpr(
        "o AS o_idx",
        "stack({}, {}) AS (matrix, values)".format(
            len(MATRICES), ", ".join(f"'{n}', {e}" for n, e in MATRICES.items())
        ),
    ).select("matrix", "o_idx", "values")


def zone_map(tables: dict[str, DataFrame]) -> DataFrame:
    """Coarse zone number to matrix index, in reverse order."""
    return (
        tables["nation"]
        .selectExpr(f"CAST(n_nationkey % {COARSE_ZONES} AS BIGINT) AS zone")
        .distinct()
        .selectExpr("zone", f"CAST({COARSE_ZONES - 1} - zone AS INT) AS idx")
    )


def skim(tables: dict[str, DataFrame], name: str = "DIST", mapped: bool = False) -> Skim:
    long = explode_matrix(matrix_rows(tables).filter(F.col("matrix") == name))
    return Skim(
        long.select("o_idx", "d_idx", "value"),
        COARSE_ZONES,
        zone_map(tables) if mapped else None,
    )


def config(tables: dict[str, DataFrame]) -> Config:
    """Settings with a county grouping of fine zones and a district grouping of coarse ones."""
    zone_table = star.zones(tables)
    county = zone_table.select("zone", F.col("county").alias("label"))
    district = (
        zone_table.filter(F.col("zone") < COARSE_ZONES)
        .select("zone", F.col("district").alias("label"))
    )
    return replace(
        CONFIG,
        geographies=(
            GeographyAggregation("county", "maz", county),
            GeographyAggregation("district", "taz", district),
        ),
    )


def raw_run(tables: dict[str, DataFrame]) -> Run:
    prepared = star.build_run(tables)
    select = star._select
    base_zones = prepared.land_use.filter("student_type IS NULL")
    return Run(
        "raw",
        {
            "hh": select(prepared.hh, HH),
            "per": select(prepared.per, PER),
            "day": select(prepared.day, DAY),
            "tours": select(prepared.tours, TOURS),
            "trips": select(prepared.trips, TRIPS),
            "vehicles": prepared.vehicles.select(
                "vehicle_id", "household_id", "vehicle_num", "vehicle_type"
            ),
            "joint_participants": prepared.joint_participants.select("tour_id", "person_id"),
            "land_use": select(base_zones, LAND_USE),
        },
    )
