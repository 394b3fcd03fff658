"""Household, person, day, vehicle and land-use enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripweave.functions.expressions import clip, is_true, lowered, truthy
from tripweave.model import Config, Run, StudentType
from tripweave.operators.columns import resolve_source
from tripweave.operators.zones import (
    Skim,
    add_configured_geographies,
    add_geography,
    add_skim_value,
    to_taz,
)

FLAG_TOKENS = ("true", "1", "yes", "y", "t")

# Choice codes of mandatory tour frequency labels.
MANDATORY_CODES = {"work1": 1, "work2": 2, "school1": 3, "school2": 4, "work_and_school": 5}

# Default enrolment columns by student label.
DEFAULT_STUDENT_TYPES = (
    StudentType("School", ("ENROLLGRADEKto8", "ENROLLGRADE9to12")),
    StudentType("University", ("COLLEGEENROLL",)),
)

AUTO_SUFFICIENCY_COLUMNS = {
    "licensed_drivers": "LICENSEDDRIVERS",
    "workers": "_autosuff_workers",
    "adults": "_autosuff_adults",
}
NATIVE_GEOGRAPHIES = ("home_county", "home_mpo")


def enrich_households(run: Run, config: Config) -> Run:
    """Clipped size and vehicles, worker and adult counts, home zone and geographies."""
    hh = run.hh
    size, cars, workers, adults = (
        config.candidates(key)[0]
        for key in ("hhsize", "auto_ownership", "num_workers", "num_adults")
    )
    if cars in hh.columns:
        hh = hh.withColumn("HHVEH", clip(F.col(cars), 0, 4))
    if size in hh.columns:
        hh = hh.withColumn("HHSIZE", clip(F.col(size), 1, 5))
    if workers in hh.columns:
        hh = hh.withColumn("WORKERS", F.col(workers))
    if adults in hh.columns:
        hh = hh.withColumn("ADULTS", F.col(adults))
    hh = to_taz(hh, "home_zone_id", "home_taz", run.land_use, config)
    hh = add_geography(hh, "home_taz", "HGEO", run.land_use, config)
    hh = add_configured_geographies(hh, "home", "home_zone_id", "home_taz", config)
    return run.with_tables(hh=hh)


def joint_tours_per_person(participants: DataFrame) -> DataFrame:
    return (
        participants.filter(F.col("person_id").isNotNull() & F.col("tour_id").isNotNull())
        .groupBy("person_id")
        .agg(F.count_distinct("tour_id").cast("int").alias("num_joint_tours"))
    )


def add_num_joint_tours(run: Run) -> DataFrame:
    """Persons with the number of distinct joint tours they take part in."""
    if "num_joint_tours" in run.per.columns or not run.has(
        "joint_participants", "person_id", "tour_id"
    ):
        return run.per
    counted = run.per.join(joint_tours_per_person(run.joint_participants), "person_id", "left")
    return counted.withColumn("num_joint_tours", F.coalesce("num_joint_tours", F.lit(0)))


def add_external_worker_flag(per: DataFrame) -> DataFrame:
    """Worker, not at home, and identified as external; unknown counts as no."""
    needed = {"is_worker", "work_from_home", "external_worker_identification"}
    if "is_external_worker" in per.columns or not needed <= set(per.columns):
        return per
    return per.withColumn(
        "is_external_worker",
        is_true(
            truthy("is_worker")
            & ~truthy("work_from_home")
            & truthy("external_worker_identification")
        ),
    )


def copy_home_geographies(per: DataFrame, hh: DataFrame) -> DataFrame:
    """Home geographies of the household, where the person has none."""
    columns = [c for c in NATIVE_GEOGRAPHIES if c in hh.columns]
    if not columns or "household_id" not in per.columns:
        return per
    joined = per.join(
        hh.select("household_id", *[F.col(c).alias(f"_hh_{c}") for c in columns]),
        "household_id",
        "left",
    )
    for c in columns:
        own = [F.col(c)] if c in per.columns else []
        joined = joined.withColumn(c, F.coalesce(*own, F.col(f"_hh_{c}")))
    return joined.drop(*[f"_hh_{c}" for c in columns])


def mandatory_frequency_code(column: str = "mandatory_tour_frequency") -> Column:
    codes = F.create_map(*[F.lit(x) for pair in MANDATORY_CODES.items() for x in pair])
    return F.coalesce(F.try_element_at(codes, F.col(column)), F.lit(0))


def enrich_persons(run: Run, config: Config, skim: Skim | None = None) -> Run:
    """Joint tours, external flag, zones, geographies, commute distances, frequency code."""
    per = add_external_worker_flag(add_num_joint_tours(run))
    if "home_zone_id" not in per.columns and run.has("hh", "household_id", "home_zone_id"):
        per = per.join(run.hh.select("household_id", "home_zone_id"), "household_id", "left")
    per = copy_home_geographies(per, run.hh)
    roles = {
        "home": ("home_zone_id", "home_taz"),
        "work": ("workplace_zone_id", "work_taz"),
        "school": ("school_zone_id", "school_taz"),
    }
    for zone, taz in roles.values():
        per = to_taz(per, zone, taz, run.land_use, config)
    per = add_geography(per, "home_taz", "HGEO", run.land_use, config)
    per = add_geography(per, "work_taz", "WGEO", run.land_use, config)
    for role, (zone, taz) in roles.items():
        per = add_configured_geographies(per, role, zone, taz, config)
    if skim is not None:
        for taz, output in (("work_taz", "distance_to_work"), ("school_taz", "distance_to_school")):
            if {"home_taz", taz} <= set(per.columns):
                per = add_skim_value(per, skim, "home_taz", taz, output)
    if "mandatory_tour_frequency" in per.columns and "imf_choice" not in per.columns:
        per = per.withColumn("imf_choice", mandatory_frequency_code())
    run = run.with_tables(per=per)
    return run.with_tables(hh=add_household_counts(run))


def add_household_counts(run: Run) -> DataFrame:
    """Households with licensed drivers, workers and adults counted from persons (one pass)."""
    flags = {
        "LICENSEDDRIVERS": ("has_license", ("true", "1", "yes", "licensed")),
        "_autosuff_workers": ("is_worker", ("true", "1", "yes")),
        "_autosuff_adults": ("adult", ("true", "1", "yes")),
    }
    present = {k: v for k, v in flags.items() if v[0] in run.per.columns}
    if not present or not run.has("hh", "household_id") or not run.has("per", "household_id"):
        return run.hh
    counts = (
        run.per.filter(F.col("household_id").isNotNull())
        .groupBy("household_id")
        .agg(
            *[
                F.count_if(truthy(column, tokens)).cast("int").alias(name)
                for name, (column, tokens) in present.items()
            ]
        )
    )
    joined = run.hh.drop(*present).join(counts, "household_id", "left")
    return joined.withColumns({name: F.coalesce(F.col(name), F.lit(0)) for name in present})


def auto_sufficiency(df: DataFrame, config: Config) -> DataFrame:
    """Class 0 (no vehicle), 1 (fewer vehicles than drivers) or 2 (enough)."""
    reference = AUTO_SUFFICIENCY_COLUMNS[config.auto_sufficiency_basis]
    if "AUTOSUFF" in df.columns or not {"HHVEH", reference} <= set(df.columns):
        return df
    cars, drivers = F.col("HHVEH"), F.col(reference)
    return df.withColumn(
        "AUTOSUFF",
        F.when((cars > 0) & (cars < drivers), 1)
        .when((cars > 0) & (cars >= drivers), 2)
        .otherwise(0)
        .cast("int"),
    )


# --- students and enrolment ----------------------------------------------------------------


def _flag(df: DataFrame, names: tuple[str, ...]) -> Column:
    source = resolve_source(df, names)
    return F.lit(False) if source is None else is_true(lowered(source).isin(*FLAG_TOKENS))


def _member(df: DataFrame, column: str, values: tuple[str, ...]) -> Column:
    if column not in df.columns:
        return F.lit(False)
    return is_true(F.col(column).cast("string").isin(*values))


def student_selector(df: DataFrame, entry: StudentType) -> Column:
    """Whether a person is a student of this type."""
    university, student = _flag(df, ("is_university",)), _flag(df, ("is_student",))
    if not entry.has_selector:
        text = " ".join((entry.label, *entry.land_use_columns)).lower()
        is_university_type = "univ" in text or "college" in text
        return university if is_university_type else student & ~university
    condition = F.lit(True)
    if entry.is_university is not None:
        condition = condition & (university if entry.is_university else ~university)
    for column in ("school_segment", "SCHG", "pstudent"):
        values = getattr(entry, column)
        if values:
            condition = condition & _member(df, column, values)
    return condition


def resolved_student_types(land_use: DataFrame, config: Config) -> tuple[StudentType, ...]:
    if config.student_types:
        return config.student_types
    return tuple(
        StudentType(t.label, tuple(c for c in t.land_use_columns if c in land_use.columns))
        for t in DEFAULT_STUDENT_TYPES
        if any(c in land_use.columns for c in t.land_use_columns)
    )


def add_student_type(per: DataFrame, types: tuple[StudentType, ...]) -> DataFrame:
    """First matching student type in configured order."""
    if not types:
        return per
    labels = [F.when(student_selector(per, t), t.label) for t in types]
    return per.withColumn("student_type", F.coalesce(*labels))


def enrollment_overlay(
    land_use: DataFrame, types: tuple[StudentType, ...], config: Config
) -> DataFrame | None:
    """One extra land-use row per zone and student type with its summed enrolment."""
    wanted = [
        next((c for c in config.candidates("maz") if c in land_use.columns), None),
        next((c for c in config.candidates("taz") if c in land_use.columns), None),
        config.geography_column,
    ]
    keys = [c for c in dict.fromkeys(wanted) if c and c in land_use.columns]
    entries = []
    for entry in types:
        columns = [c for c in entry.land_use_columns if c in land_use.columns]
        if columns:
            enrolment = sum((F.col(c).cast("double") for c in columns), F.lit(0.0))
            entries.append(
                F.struct(
                    F.lit(entry.label).alias("student_type"), enrolment.alias("enrollment_count")
                )
            )
    if not keys or not entries:
        return None
    return (
        land_use.select(*keys, F.explode(F.array(*entries)).alias("_e"))
        .select(*keys, "_e.student_type", "_e.enrollment_count")
        .filter(F.col("enrollment_count").isNotNull())
    )


def add_student_enrollment(run: Run, config: Config) -> Run:
    types = resolved_student_types(run.land_use, config)
    overlay = enrollment_overlay(run.land_use, types, config)
    land_use = (
        run.land_use
        if overlay is None
        else run.land_use.unionByName(overlay, allowMissingColumns=True)
    )
    return run.with_tables(per=add_student_type(run.per, types), land_use=land_use)


def add_day_person_type(run: Run) -> DataFrame | None:
    """Person-days with the person's type."""
    day = run.day
    if not run.has("day", "person_id") or "person_type" in day.columns:
        return day
    if not run.has("per", "person_id", "person_type"):
        return day
    return day.join(run.per.select("person_id", "person_type").distinct(), "person_id", "left")
