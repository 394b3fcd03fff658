"""Trip enrichment: tour attributes, endpoints, stops, out-of-direction and walk distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripweave.functions.expressions import NON_MOTORIZED_MODES, lowered, summary_purpose
from tripweave.model import Config, Run
from tripweave.operators.persons import auto_sufficiency
from tripweave.operators.tours import add_zone_columns, attach_household
from tripweave.operators.zones import Skim, add_skim_value

TOUR_COLUMNS = (
    "AUTOSUFF",
    "NUMBER_HH",
    "tour_purpose",
    "tour_mode",
    "tour_category",
    "atwork_subtour_frequency",
    "pnr_zone_id",
)


def is_outbound() -> Column:
    """Direction flag of text, number or boolean columns; null stays null."""
    return F.when(
        F.col("outbound").isNotNull(), ~lowered("outbound").isin("false", "0")
    )


def attach_tour(trips: DataFrame, tours: DataFrame) -> DataFrame:
    """Tour attributes and tour endpoints, in one join; the tour's purpose, mode and category
    come before the trip's own.
    """
    columns = [c for c in TOUR_COLUMNS if c in tours.columns]
    ends = [c for c in ("origin", "OTAZ", "DTAZ") if c in tours.columns]
    attributes = tours.select(
        "tour_id",
        *[F.col(c).alias(f"_t_{c}") for c in columns],
        *[F.col(c).alias(f"_end_{c}") for c in ends],
    )
    joined = trips.join(attributes, "tour_id", "left")
    for c in columns:
        target = "num_participants" if c == "NUMBER_HH" else c
        own = [F.col(target)] if target in trips.columns else []
        joined = joined.withColumn(target, F.coalesce(F.col(f"_t_{c}"), *own))
    return joined.drop(*[f"_t_{c}" for c in columns])


def repair_endpoints(trips: DataFrame) -> DataFrame:
    """First outbound trip starts, and last inbound trip ends, at the tour origin.

    Adds ``max_trip_num`` and the stop flag (not the last trip of its direction).
    """
    bounds = trips.groupBy("tour_id", "outbound").agg(
        F.min("trip_num").alias("_first_num"), F.max("trip_num").alias("max_trip_num")
    )
    joined = trips.drop("max_trip_num").join(bounds, ["tour_id", "outbound"], "left")
    number, outbound = F.col("trip_num"), F.col("outbound").try_cast("boolean")
    if {"_end_origin", "origin", "destination"} <= set(joined.columns):
        start = outbound & (number == F.col("_first_num"))
        end = ~outbound & (number == F.col("max_trip_num"))
        joined = joined.withColumns(
            {
                "origin": F.when(start, F.coalesce("_end_origin", "origin")).otherwise(
                    F.col("origin")
                ),
                "destination": F.when(end, F.coalesce("_end_origin", "destination")).otherwise(
                    F.col("destination")
                ),
            }
        )
    stops = F.when(number < F.col("max_trip_num"), 1).otherwise(0)
    return joined.withColumn("stops", stops).drop("_first_num")


def add_out_of_direction(trips: DataFrame, skim: Skim, known: str | None = None) -> DataFrame:
    """Extra distance of passing the destination on the way to the far end of the tour leg.

    known: a column that already holds this skim's value from OTAZ to DTAZ.
    """
    final = F.when(F.col("inbound") == 0, F.col("_end_DTAZ")).otherwise(F.col("_end_OTAZ"))
    legs = trips.withColumn("_final", final)
    if known is None:
        legs = add_skim_value(legs, skim, "OTAZ", "DTAZ", "_od")
    else:
        legs = legs.withColumn("_od", F.col(known))
    legs = add_skim_value(legs, skim, "OTAZ", "_final", "_of")
    legs = add_skim_value(legs, skim, "DTAZ", "_final", "_df")
    extra = F.col("_of") + F.col("_df") - F.col("_od")
    detour = F.when(extra.isNotNull(), F.greatest(extra, F.lit(0.0)))
    return legs.withColumn("out_dir_dist", detour).drop("_final", "_od", "_of", "_df")


def enrich_trips(run: Run, config: Config, skim: Skim | None = None) -> Run:
    trips = attach_household(run.trips, run.hh, config)
    if run.has("tours", "tour_id") and "tour_id" in trips.columns:
        trips = attach_tour(trips, run.tours)
    trips = auto_sufficiency(trips, config)
    if {"tour_id", "outbound", "trip_num"} <= set(trips.columns):
        trips = repair_endpoints(trips)
    elif "stops" not in trips.columns:
        trips = trips.withColumn("stops", F.lit(0))
    trips = add_zone_columns(trips, run, config)
    if skim is not None and {"OTAZ", "DTAZ"} <= set(trips.columns):
        trips = add_skim_value(trips.drop("od_dist"), skim, "OTAZ", "DTAZ", "od_dist")
    if "depart_hour" not in trips.columns:
        trips = trips.withColumn("depart_hour", F.lit(1))
    if "outbound" in trips.columns and "inbound" not in trips.columns:
        inbound = F.when(lowered("outbound").isin("false", "0"), 1).otherwise(0)
        trips = trips.withColumn("inbound", inbound)
    leg_columns = {"OTAZ", "DTAZ", "inbound", "_end_OTAZ", "_end_DTAZ"}
    if (
        skim is not None
        and "out_dir_dist" not in trips.columns
        and leg_columns <= set(trips.columns)
    ):
        trips = add_out_of_direction(trips, skim, known="od_dist")
    trips = trips.drop("_end_origin", "_end_OTAZ", "_end_DTAZ")
    if "tour_purpose" in trips.columns:
        trips = trips.withColumn("summary_tour_purpose", summary_purpose(trips.columns, config))
    return run.with_tables(trips=trips)


def add_walk_distance(trips: DataFrame, lookup: DataFrame) -> DataFrame:
    """Non-motorised distance of fine-zone pairs from a keyed (o, d, value) table."""
    table = lookup.select(
        F.col("o").cast("bigint").alias("o_maz"),
        F.col("d").cast("bigint").alias("d_maz"),
        F.col("value").cast("double").alias("prepared_non_motorized_distance"),
    )
    return trips.drop("prepared_non_motorized_distance").join(table, ["o_maz", "d_maz"], "left")


def walk_distance_unresolved(trips: DataFrame) -> DataFrame:
    """Rows with both zones, those without a distance, and walk or bike trips without one."""
    missing = F.col("prepared_non_motorized_distance").isNull()
    zones = F.col("o_maz").isNotNull() & F.col("d_maz").isNotNull()
    active = F.upper(F.col("trip_mode").cast("string")).isin(*NON_MOTORIZED_MODES)
    return trips.agg(
        F.count_if(zones).alias("total"),
        F.count_if(zones & missing).alias("unresolved"),
        F.count_if(active & missing).alias("eligible_non_motorized_unresolved"),
    )
