"""Household vehicles, and vehicles allocated to tours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripweave.functions.expressions import is_true, total
from tripweave.model import Config, Run
from tripweave.operators.aggregate import weighted_sum
from tripweave.plans.registry import summary

OCCUPANCY_COLUMNS = {"1": "vehicle_occup_1", "2": "vehicle_occup_2", "3+": "vehicle_occup_3.5"}
OLDEST_AGE = 20


def capped(column: Column, cap: int) -> Column:
    """Integer as text with an open last class."""
    return F.when(column >= cap, f"{cap}+").otherwise(column.try_cast("bigint").cast("string"))


def split_vehicle_type(column: str) -> dict[str, Column]:
    """``body_age_fuel`` text as three columns; missing parts are null."""
    parts = F.split(F.col(f"`{column}`").cast("string"), "_")
    return {
        "body_type": F.get(parts, F.lit(0)),
        "vehicle_age": F.get(parts, F.lit(1)).try_cast("bigint"),
        "fuel_type": F.get(parts, F.lit(2)),
    }


@summary(
    "autonomous_vehicle_ownership_totals",
    "household_with_autonomous_vehicle_count double",
    {"hh": "av_ownership finalweight"},
)
def av_ownership(run: Run, config: Config) -> DataFrame:
    owners = run.hh.filter(is_true(F.col("av_ownership").cast("boolean")))
    return owners.agg(total("finalweight").alias("household_with_autonomous_vehicle_count"))


@summary(
    "auto_ownership_distribution",
    "household_size string, household_vehicle_count bigint, household_count double",
    {"hh": "HHSIZE HHVEH finalweight"},
)
def auto_ownership(run: Run, config: Config) -> DataFrame:
    rows = run.hh.select(
        capped(F.col("HHSIZE").try_cast("bigint"), 5).alias("household_size"),
        F.col("HHVEH").alias("household_vehicle_count"),
        "finalweight",
    )
    return weighted_sum(
        rows, ["household_size", "household_vehicle_count"], "finalweight", "household_count"
    )


def _vehicles_by(run: Run, column: str, value: Column, name: str) -> DataFrame:
    rows = run.vehicles.filter(F.col(column).isNotNull()).select(value.alias(name), "finalweight")
    return weighted_sum(rows, [name], "finalweight", "vehicle_count")


@summary(
    "vehicle_age_distribution",
    "age string, vehicle_count double",
    {"vehicles": "vehicle_age finalweight"},
)
def vehicle_age(run: Run, config: Config) -> DataFrame:
    return _vehicles_by(run, "vehicle_age", capped(F.col("vehicle_age"), OLDEST_AGE), "age")


@summary(
    "vehicle_fuel_type_distribution",
    "fuel_type string, vehicle_count double",
    {"vehicles": "fuel_type finalweight"},
)
def vehicle_fuel(run: Run, config: Config) -> DataFrame:
    return _vehicles_by(run, "fuel_type", F.col("fuel_type").cast("string"), "fuel_type")


@summary(
    "vehicle_body_type_distribution",
    "body_type string, vehicle_count double",
    {"vehicles": "body_type finalweight"},
)
def vehicle_body(run: Run, config: Config) -> DataFrame:
    return _vehicles_by(run, "body_type", F.col("body_type").cast("string"), "body_type")


def allocated_vehicles(run: Run) -> DataFrame:
    """One row per tour and occupancy class with the allocated vehicle's attributes."""
    entries = F.array(
        *[
            F.struct(
                F.lit(label).alias("occupancy"),
                F.col(f"`{column}`").cast("string").alias("vehicle_type"),
            )
            for label, column in OCCUPANCY_COLUMNS.items()
        ]
    )
    rows = run.tours.select("finalweight", F.explode(entries).alias("_v")).select(
        "finalweight", "_v.occupancy", "_v.vehicle_type"
    )
    parts = split_vehicle_type("vehicle_type")
    return (
        rows.select("finalweight", "occupancy", *[e.alias(n) for n, e in parts.items()])
        .filter("body_type IS NOT NULL AND vehicle_age IS NOT NULL AND fuel_type IS NOT NULL")
        .withColumn("age", capped(F.col("vehicle_age"), OLDEST_AGE))
    )


ALLOCATED = {"tours": "vehicle_occup_1 vehicle_occup_2 vehicle_occup_3.5 finalweight"}


def _allocated_by(run: Run, column: str) -> DataFrame:
    return weighted_sum(
        allocated_vehicles(run), [column, "occupancy"], "finalweight", "vehicle_count"
    )


@summary(
    "allocated_vehicle_age_by_occupancy",
    "age string, occupancy string, vehicle_count double",
    ALLOCATED,
)
def allocated_age(run: Run, config: Config) -> DataFrame:
    return _allocated_by(run, "age")


@summary(
    "allocated_vehicle_fuel_type_by_occupancy",
    "fuel_type string, occupancy string, vehicle_count double",
    ALLOCATED,
)
def allocated_fuel(run: Run, config: Config) -> DataFrame:
    return _allocated_by(run, "fuel_type")


@summary(
    "allocated_vehicle_body_type_by_occupancy",
    "body_type string, occupancy string, vehicle_count double",
    ALLOCATED,
)
def allocated_body(run: Run, config: Config) -> DataFrame:
    return _allocated_by(run, "body_type")
