"""Canonical columns: alias resolution, materialisation, category recodes, final types."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from tripweave.functions.expressions import clock_to_period
from tripweave.model import Config, Run
from tripweave.operators.aggregate import smallest_values


def is_numeric(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, NumericType)


def resolve_source(
    df: DataFrame, candidates: Iterable[str], require_non_numeric: bool = False
) -> str | None:
    """First candidate present; when asked, a non-numeric one is preferred."""
    present = [c for c in dict.fromkeys(candidates) if c and c in df.columns]
    if require_non_numeric:
        for name in present:
            if not is_numeric(df, name):
                return name
    return present[0] if present else None


def materialize(
    df: DataFrame, target: str, source: str | None, overwrite: bool = False
) -> DataFrame:
    """Copy ``source`` to ``target`` unless the target exists already."""
    if source is None or source == target or (target in df.columns and not overwrite):
        return df
    return df.withColumn(target, F.col(f"`{source}`"))


@dataclass(frozen=True)
class Canonical:
    """One canonical column: configuration key of its aliases, and how to fill it."""

    target: str
    key: str
    fallbacks: tuple[str, ...] = ()
    overwrite: bool = False
    text: bool = False


def _same(*names: str) -> tuple[Canonical, ...]:
    return tuple(Canonical(name, name) for name in names)


PURPOSE_FALLBACKS = ("tour_purpose", "primary_purpose", "tour_type", "purpose")
PERSON_TYPE = Canonical("person_type", "ptype", ("person_type", "ptype"), overwrite=True)

CANONICAL: dict[str, tuple[Canonical, ...]] = {
    "hh": _same("household_id", "home_zone_id"),
    "per": (
        *_same("household_id", "person_id"),
        PERSON_TYPE,
        *_same("home_zone_id", "workplace_zone_id", "school_zone_id", "has_license"),
        *_same("mandatory_tour_frequency", "is_student", "is_university", "school_segment"),
        *_same("is_worker", "adult"),
        Canonical("SCHG", "schg"),
        *_same("pstudent"),
    ),
    "day": (
        Canonical("household_id", "household_id", ("hh_id",)),
        *_same("person_id", "day_id", "day_weight"),
    ),
    "tours": (
        *_same("household_id", "person_id"),
        PERSON_TYPE,
        *_same("tour_id", "tour_category", "tour_mode"),
        Canonical("tour_purpose", "tour_purpose", PURPOSE_FALLBACKS, text=True),
        Canonical("start_hour", "tour_start"),
        Canonical("end_hour", "tour_end"),
        Canonical("tourdur", "tour_duration"),
        Canonical("origin", "tour_origin"),
        Canonical("destination", "tour_destination"),
        *_same("stop_frequency", "pnr_zone_id"),
    ),
    "trips": (
        *_same("household_id", "person_id", "tour_id", "trip_id", "trip_mode"),
        Canonical("trip_purpose", "trip_purpose", text=True),
        Canonical("depart_hour", "trip_depart"),
        Canonical("origin", "trip_origin"),
        Canonical("destination", "trip_destination"),
        Canonical("outbound", "trip_outbound"),
        *_same("trip_num", "tour_mode", "tour_category"),
        Canonical("tour_purpose", "tour_purpose", text=True),
    ),
    "vehicles": _same("household_id", "vehicle_id", "vehicle_num", "vehicle_type"),
    "joint_participants": _same("person_id", "tour_id"),
    "land_use": (
        Canonical("MAZ", "maz"),
        Canonical("TAZ", "taz"),
        Canonical("EMPLOYMENT", "total_employment"),
        Canonical("employment_count", "total_employment"),
    ),
}


def canonicalize(table: str, df: DataFrame, config: Config) -> DataFrame:
    """Add the canonical columns of one table from whichever alias is present."""
    for spec in CANONICAL[table]:
        names = [*config.candidates(spec.key), *spec.fallbacks]
        source = resolve_source(df, names, require_non_numeric=spec.text)
        overwrite = spec.overwrite
        if spec.text and source and spec.target in df.columns and source != spec.target:
            # A numeric placeholder gives way to a text source.
            overwrite = is_numeric(df, spec.target) and not is_numeric(df, source)
        df = materialize(df, spec.target, source, overwrite)
    if table == "joint_participants":
        df = cast_present(df, {"person_id": "bigint", "tour_id": "bigint"})
    return df


def canonicalize_run(run: Run, config: Config) -> Run:
    tables = {
        name: canonicalize(name, run.tables[name], config)
        for name in CANONICAL
        if run.tables.get(name) is not None
    }
    return raw_survey_periods(run.with_tables(**tables))


CLOCK_SURVEY = {
    "hh": ("num_people", "num_vehicles"),
    "per": ("can_drive", "person_type"),
    "tours": (
        "tour_start_hour",
        "tour_start_minute",
        "tour_end_hour",
        "tour_end_minute",
        "tour_mode",
        "tour_purpose",
        "duration_minutes",
        "distance_miles",
    ),
    "trips": (
        "linked_trip_mode",
        "d_purpose_category",
        "depart_hour",
        "depart_minute",
        "distance_miles",
    ),
}


def raw_survey_periods(run: Run) -> Run:
    """A survey recorded in clock times gets model periods and its reported distances."""
    if not all(run.has(table, *columns) for table, columns in CLOCK_SURVEY.items()):
        return run
    start = clock_to_period("tour_start_hour", "tour_start_minute")
    end = clock_to_period("tour_end_hour", "tour_end_minute")
    miles = F.col("distance_miles").try_cast("double")
    tours = run.tours.withColumns(
        {"start": start, "start_hour": start, "end": end, "end_hour": end, "SKIMDIST": miles}
    )
    if "joint_num_participants" in tours.columns:
        tours = tours.withColumn(
            "number_of_participants", F.col("joint_num_participants").try_cast("bigint")
        )
    trips = run.trips.withColumns(
        {
            "depart": clock_to_period("depart_hour", "depart_minute"),
            "od_dist": miles,
            "prepared_non_motorized_distance": miles,
        }
    )
    hh = run.hh.withColumns(
        {"hhsize": F.col("num_people"), "auto_ownership": F.col("num_vehicles")}
    )
    return run.with_tables(hh=hh, tours=tours, trips=trips)


@dataclass(frozen=True)
class CategoryMapping:
    """Recode of one source column; unmapped values are kept or become null."""

    target: str
    source: str
    mapping: dict[str, str | bool]
    boolean: bool = False
    preserve_unmapped: bool = True


def map_categories(df: DataFrame, spec: CategoryMapping) -> DataFrame:
    if spec.source not in df.columns:
        return df
    text = F.col(f"`{spec.source}`").cast("string")
    pairs = [F.lit(part) for pair in spec.mapping.items() for part in pair]
    mapped = F.try_element_at(F.create_map(*pairs), text)
    if spec.boolean:
        keep = spec.preserve_unmapped and isinstance(
            df.schema[spec.source].dataType, BooleanType
        )
        mapped = mapped.cast("boolean")
        fallback = F.col(f"`{spec.source}`") if keep else None
    else:
        fallback = text if spec.preserve_unmapped else None
    return df.withColumn(spec.target, mapped if fallback is None else F.coalesce(mapped, fallback))


UNMATCHED_SHOWN = 20


def category_mapping_report(
    df: DataFrame, specs: Sequence[CategoryMapping], shown: int = UNMATCHED_SHOWN
) -> DataFrame:
    """Totals, unmatched counts and the smallest unmatched values of each mapping.

    shown: how many unmatched values are listed; counts cover all of them.
    """
    present = [s for s in specs if s.source in df.columns]
    values = F.array(
        *[
            F.struct(
                F.lit(s.target).alias("target"),
                F.col(f"`{s.source}`").cast("string").alias("value"),
                F.col(f"`{s.source}`").cast("string").isin(*map(str, s.mapping)).alias("known"),
            )
            for s in present
        ]
    )
    counts = (
        df.select(F.explode(values).alias("_v"))
        .filter(F.col("_v.value").isNotNull())
        .groupBy("_v.target", "_v.value", "_v.known")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    unknown = ~F.col("known")
    totals = counts.groupBy("target").agg(
        F.sum("n").alias("total"),
        F.coalesce(F.sum(F.when(unknown, F.col("n"))), F.lit(0)).alias("unresolved"),
    )
    listed = smallest_values(counts.filter(unknown), "target", "value", shown)
    return totals.join(
        listed.withColumnRenamed("smallest", "unmatched_values"), "target", "left"
    )


def cast_present(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Strict casts of the listed columns that exist."""
    return df.select(
        *[
            F.col(f"`{c}`").cast(types[c]).alias(c) if c in types else F.col(f"`{c}`")
            for c in df.columns
        ]
    )


# Types of the prepared columns.
PREPARED_TYPES: dict[str, dict[str, str]] = {
    "hh": {
        "household_id": "bigint",
        "finalweight": "double",
        "HHVEH": "int",
        "HHSIZE": "int",
        "WORKERS": "int",
        "LICENSEDDRIVERS": "int",
        "ADULTS": "int",
        "HGEO": "string",
    },
    "per": {
        "household_id": "bigint",
        "person_id": "bigint",
        "finalweight": "double",
        "HGEO": "string",
        "WGEO": "string",
        "is_worker": "string",
        "adult": "string",
        "student_type": "string",
        "work_from_home": "string",
        "mandatory_tour_frequency": "string",
        "distance_to_work": "double",
        "distance_to_school": "double",
    },
    "day": {
        "day_id": "bigint",
        "household_id": "bigint",
        "person_id": "bigint",
        "person_type": "string",
        "travel_date": "string",
        "day_num": "int",
        "travel_dow": "int",
        "daily_activity_pattern": "string",
        "finalweight": "double",
    },
    "tours": {
        "household_id": "bigint",
        "person_id": "bigint",
        "tour_id": "bigint",
        "tour_category": "string",
        "tour_mode": "string",
        "tour_purpose": "string",
        "summary_tour_purpose": "string",
        "school_esc_outbound": "string",
        "school_esc_inbound": "string",
        "start_hour": "int",
        "end_hour": "int",
        "start_period": "string",
        "end_period": "string",
        "first_inbound_trip_depart": "int",
        "first_inbound_trip_period": "string",
        "tourdur": "int",
        "o_maz": "bigint",
        "d_maz": "bigint",
        "pnr_zone_id": "bigint",
        "OTAZ": "int",
        "DTAZ": "int",
        "pnr_taz": "int",
        "income_segment": "bigint",
        "vot_bin": "string",
        "tour_distance": "double",
        "SKIMDIST": "double",
        "NUMBER_HH": "int",
        "AUTOSUFF": "int",
        "LICENSEDDRIVERS": "int",
        "num_escortees": "bigint",
        "finalweight": "double",
    },
    "trips": {
        "household_id": "bigint",
        "person_id": "bigint",
        "tour_id": "bigint",
        "trip_id": "bigint",
        "trip_mode": "string",
        "trip_purpose": "string",
        "tour_mode": "string",
        "tour_purpose": "string",
        "summary_tour_purpose": "string",
        "tour_category": "string",
        "depart_hour": "int",
        "trip_period": "string",
        "o_maz": "bigint",
        "d_maz": "bigint",
        "pnr_zone_id": "bigint",
        "OTAZ": "int",
        "DTAZ": "int",
        "pnr_taz": "int",
        "parking_zone": "bigint",
        "origin_parking_zone": "bigint",
        "income_segment": "bigint",
        "vot_bin": "string",
        "od_dist": "double",
        "prepared_non_motorized_distance": "double",
        "out_dir_dist": "double",
        "stops": "int",
        "inbound": "int",
        "trip_num": "int",
        "escort_event_role": "string",
        "escort_event_trip_num": "int",
        "escort_stops_before_event": "int",
        "escort_stops_after_event": "int",
        "escort_event_match_status": "string",
        "AUTOSUFF": "int",
        "LICENSEDDRIVERS": "int",
        "num_participants": "int",
        "finalweight": "double",
    },
    "land_use": {
        "MAZ": "bigint",
        "TAZ": "bigint",
        "EMPLOYMENT": "double",
        "employment_count": "double",
        "student_type": "string",
        "enrollment_count": "double",
    },
    "vehicles": {
        "household_id": "bigint",
        "vehicle_id": "bigint",
        "vehicle_num": "int",
        "vehicle_type": "string",
        "body_type": "string",
        "fuel_type": "string",
        "vehicle_age": "bigint",
        "finalweight": "double",
    },
}


def cast_prepared(run: Run) -> Run:
    """Final types of every prepared table; geography columns are text."""
    tables = {}
    for name, types in PREPARED_TYPES.items():
        df = run.tables.get(name)
        if df is None:
            continue
        geographies = {c: "string" for c in df.columns if "_geo__" in c}
        helpers = [c for c in df.columns if c.startswith("_autosuff_")]
        tables[name] = cast_present(df.drop(*helpers), {**types, **geographies})
    return run.with_tables(**tables)
