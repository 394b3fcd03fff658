"""Survey and expansion weights of the prepared tables (column ``finalweight``)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripweave.model import Config, Run

WEIGHT = "finalweight"


def _has(df: DataFrame | None, *columns: str) -> bool:
    return df is not None and set(columns) <= set(df.columns)


def own_weight(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(WEIGHT, F.col(f"`{column}`").cast("double"))


def inherited(df: DataFrame, source: DataFrame, key: str, *fallbacks: Column) -> DataFrame:
    """Weight of the related row, else the fallbacks, else 1."""
    weights = source.select(key, F.col(WEIGHT).cast("double").alias("_inherited"))
    value = F.coalesce(F.col("_inherited"), *fallbacks, F.lit(1.0)).cast("double")
    return df.join(weights, key, "left").withColumn(WEIGHT, value).drop("_inherited")


def household_weights(
    hh: DataFrame, config: Config, weight_column: str | None, explicit: bool
) -> DataFrame:
    """Own column, else one over the sample rate when no weight is given at all, else 1."""
    rate = config.sample_rate_column or "sample_rate"
    if weight_column and weight_column in hh.columns:
        return own_weight(hh, weight_column)
    if not explicit and rate in hh.columns:
        return hh.withColumn(WEIGHT, F.lit(1.0) / F.col(rate).cast("double"))
    return hh.withColumn(WEIGHT, F.lit(1.0))


def related_weights(
    df: DataFrame, own: str | None, per: DataFrame | None, hh: DataFrame | None
) -> DataFrame:
    """Own column, else the person's weight, else the household's, else 1."""
    if own and own in df.columns:
        return own_weight(df, own)
    if _has(df, "person_id") and _has(per, "person_id", WEIGHT):
        return inherited(df, per, "person_id")
    if _has(df, "household_id") and _has(hh, "household_id", WEIGHT):
        return inherited(df, hh, "household_id")
    return df.withColumn(WEIGHT, F.lit(1.0))


def day_weights(
    day: DataFrame, per: DataFrame | None, hh: DataFrame | None, own: str | None
) -> DataFrame:
    """Row by row: own weight, else the person's, else the household's, else 1."""
    candidates = [F.col(f"`{own}`").cast("double")] if own and own in day.columns else []
    result, helpers = day, []
    for table, key, name in ((per, "person_id", "_pw"), (hh, "household_id", "_hw")):
        if _has(day, key) and _has(table, key, WEIGHT):
            result = result.join(table.select(key, F.col(WEIGHT).alias(name)), key, "left")
            candidates.append(F.col(name))
            helpers.append(name)
    return result.withColumn(WEIGHT, F.coalesce(*candidates, F.lit(1.0))).drop(*helpers)


def mean_trip_weight(trips: DataFrame) -> DataFrame:
    return trips.groupBy("tour_id").agg(F.avg(WEIGHT).alias(WEIGHT))


def tour_weights(
    tours: DataFrame,
    trips: DataFrame | None,
    per: DataFrame | None,
    hh: DataFrame | None,
    trip_weight_column: str | None,
) -> DataFrame:
    """Mean weight of the tour's trips when trips are weighted, else person, else household."""
    if trip_weight_column and _has(trips, trip_weight_column, "tour_id"):
        return inherited(tours, mean_trip_weight(trips), "tour_id")
    return related_weights(tours, None, per, hh)


@dataclass(frozen=True)
class WeightColumns:
    """Names of weight columns in the raw tables."""

    household: str | None = None
    person: str | None = None
    trip: str | None = None
    day: str | None = "day_weight"

    @property
    def explicit(self) -> bool:
        return any((self.household, self.person, self.trip))


def compute_weights(run: Run, config: Config, columns: WeightColumns = WeightColumns()) -> Run:
    """``finalweight`` on households, persons, trips, days, tours and vehicles."""
    hh = household_weights(run.hh, config, columns.household, columns.explicit)
    per = related_weights(run.per, columns.person, None, hh)
    tables: dict[str, DataFrame] = {"hh": hh, "per": per}
    if run.trips is not None:
        tables["trips"] = related_weights(run.trips, columns.trip, per, hh)
    if run.day is not None:
        tables["day"] = day_weights(run.day, per, hh, columns.day)
    if run.tours is not None:
        tables["tours"] = tour_weights(run.tours, tables.get("trips"), per, hh, columns.trip)
    if run.vehicles is not None:
        tables["vehicles"] = related_weights(run.vehicles, None, None, hh)
    return run.with_tables(**tables)


def unweighted(run: Run) -> Run:
    """Weight 1 wherever a weight exists."""
    return run.with_tables(
        **{
            name: df.withColumn(WEIGHT, F.lit(1.0))
            for name, df in run.tables.items()
            if _has(df, WEIGHT)
        }
    )


def column_weights(run: Run, columns: dict[str, str]) -> Run:
    """Weights from other columns of households, persons or trips, passed on by relation.

    Persons, trips, tours and days follow their person (else household); tours follow the
    mean of their trips when trips have their own column; hypothetical lookups follow theirs.
    """
    tables = dict(run.tables)
    household, person, trip = (columns.get(k) for k in ("households", "persons", "trips"))
    changed_hh, changed_per = household is not None, bool(person or household)

    def linked(df: DataFrame | None, source: DataFrame | None, key: str) -> bool:
        return _has(df, key) and _has(source, key, WEIGHT)

    def follow(df: DataFrame | None, source: DataFrame | None, key: str) -> DataFrame | None:
        """Take the related weight, else keep the present one; unrelated tables stay."""
        if not linked(df, source, key):
            return df
        previous = (F.col(WEIGHT),) if WEIGHT in df.columns else ()
        return inherited(df, source, key, *previous)

    def follow_person(df: DataFrame | None) -> DataFrame | None:
        if not changed_per:
            return df
        if linked(df, tables["per"], "person_id"):
            return follow(df, tables["per"], "person_id")
        return follow(df, tables["hh"], "household_id") if changed_hh else df

    if household:
        tables["hh"] = own_weight(tables["hh"], household)
    if person:
        tables["per"] = own_weight(tables["per"], person)
    elif changed_hh:
        tables["per"] = follow(tables["per"], tables["hh"], "household_id")
    if trip:
        tables["trips"] = own_weight(tables["trips"], trip)
    else:
        tables["trips"] = follow_person(tables.get("trips"))
    if trip and _has(tables["trips"], "tour_id"):
        means = mean_trip_weight(tables["trips"])
        tables["tours"] = follow(tables.get("tours"), means, "tour_id")
    else:
        tables["tours"] = follow_person(tables.get("tours"))
    tables["day"] = follow_person(tables.get("day"))
    if changed_hh:
        tables["vehicles"] = follow(tables.get("vehicles"), tables["hh"], "household_id")
    if trip or changed_per:
        for name, owner, key in (
            ("trip_hypothetical_skims", "trips", "trip_id"),
            ("tour_hypothetical_skims", "tours", "tour_id"),
        ):
            tables[name] = follow(tables.get(name), tables[owner], key)
    return run.with_tables(**tables)


def side_by_side(run: Run, transforms: dict[str, Callable[[Run], Run]]) -> Run:
    """The run with the weights of every transform in columns of their own, on the same rows.

    ``transforms`` maps an output column to a run-to-run function that changes weights only. A table
    lacks a column where the transform leaves it without a weight.
    """
    kept = "_run_weight"
    run = run.with_tables(
        **{
            name: df.withColumn(kept, F.col(WEIGHT))
            for name, df in run.tables.items()
            if _has(df, WEIGHT)
        }
    )

    def put_aside(df: DataFrame, output: str) -> DataFrame:
        moved = df.withColumn(output, F.col(WEIGHT))
        return moved.withColumn(WEIGHT, F.col(kept)) if kept in df.columns else moved.drop(WEIGHT)

    for output, transform in transforms.items():
        changed = transform(run)
        run = changed.with_tables(
            **{
                name: put_aside(df, output)
                for name, df in changed.tables.items()
                if _has(df, WEIGHT)
            }
        )
    return run.with_tables(
        **{name: df.drop(kept) for name, df in run.tables.items() if _has(df, kept)}
    )
