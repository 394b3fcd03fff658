"""Person attributes by person type, each with an all-persons row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripweave.functions.expressions import is_worker
from tripweave.model import ALL_PERSON_TYPES, Config, Run, label_column
from tripweave.operators.aggregate import weighted_sum_with_totals
from tripweave.plans.registry import summary

DRIVER_CODES = (1, 3)
DRIVING_AGE = 16


def person_type_label(config: Config) -> Column:
    labels = {ALL_PERSON_TYPES: "All Person Types", **config.labels.get("person_type", {})}
    return label_column(F.col("person_type"), labels)


def _by_person_type(persons: DataFrame, value: Column, name: str, config: Config) -> DataFrame:
    rows = persons.filter(F.col("person_type").isNotNull()).select(
        F.col("person_type").cast("string").alias("person_type"),
        value.alias(name),
        "finalweight",
    )
    counts = weighted_sum_with_totals(
        rows,
        ["person_type", name],
        "finalweight",
        "person_count",
        {"person_type": ALL_PERSON_TYPES},
    )
    return counts.withColumn("person_type_label", person_type_label(config))


@summary(
    "license_holding_status_distribution",
    "person_type string, license_holding_status string, person_type_label string, "
    "person_count double",
    {"per": "person_type has_license finalweight age"},
)
def license_holding(run: Run, config: Config) -> DataFrame:
    if "can_drive" in run.per.columns:
        eligible = F.col("can_drive").try_cast("bigint").isin(*DRIVER_CODES)
    else:
        eligible = F.col("age") >= DRIVING_AGE
    status = F.when(F.col("has_license").cast("boolean"), "has_license").otherwise("no_license")
    return _by_person_type(
        run.per.filter(F.col("has_license").isNotNull() & eligible),
        status,
        "license_holding_status",
        config,
    )


@summary(
    "bicycle_comfort_level_distribution",
    "person_type string, bicycle_comfort_level string, person_type_label string, "
    "person_count double",
    {"per": "person_type bike_comfort finalweight"},
)
def bicycle_comfort(run: Run, config: Config) -> DataFrame:
    return _by_person_type(
        run.per.filter(F.col("bike_comfort").isNotNull()),
        F.col("bike_comfort").cast("string"),
        "bicycle_comfort_level",
        config,
    )


@summary(
    "transit_pass_ownership_by_person_type",
    "person_type string, transit_pass_ownership_status string, person_type_label string, "
    "person_count double",
    {"per": "person_type transit_pass_ownership finalweight"},
)
def transit_pass(run: Run, config: Config) -> DataFrame:
    owned = F.col("transit_pass_ownership").cast("boolean")
    return _by_person_type(
        run.per.filter(F.col("transit_pass_ownership").isNotNull()),
        F.when(owned, "has_transit_pass").otherwise("no_transit_pass"),
        "transit_pass_ownership_status",
        config,
    )


@summary(
    "transit_subsidy_by_person_type",
    "person_type string, transit_subsidy_status string, transit_subsidy_label string, "
    "person_type_label string, person_count double",
    {"per": "person_type transit_pass_subsidy is_worker is_student finalweight"},
)
def transit_subsidy(run: Run, config: Config) -> DataFrame:
    counts = _by_person_type(
        run.per.filter(F.col("transit_pass_subsidy").isNotNull() & is_worker()),
        F.col("transit_pass_subsidy").cast("string"),
        "transit_subsidy_status",
        config,
    )
    labels = config.labels.get("transit_subsidy", {})
    return counts.withColumn(
        "transit_subsidy_label", label_column(F.col("transit_subsidy_status"), labels)
    )
