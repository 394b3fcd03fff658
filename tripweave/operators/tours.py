"""Tour enrichment: escort fields, origins, parties, composition, stops, periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tripweave.functions.expressions import (
    clip,
    integer_text,
    lowered,
    normalized,
    summary_purpose,
)
from tripweave.model import Config, Run, label_column
from tripweave.operators.columns import materialize, resolve_source
from tripweave.operators.persons import AUTO_SUFFICIENCY_COLUMNS, auto_sufficiency
from tripweave.operators.zones import Skim, add_configured_geographies, add_skim_value, to_taz

# Escort columns and the configuration keys of their aliases.
ESCORT_FIELDS = (
    "school_esc_outbound",
    "school_esc_inbound",
    "num_escortees",
    "out_escorted_tour_ids",
    "inb_escorted_tour_ids",
    "out_escorting_type",
    "inb_escorting_type",
    "out_chauffeur_tour_id",
    "inb_chauffeur_tour_id",
)
ESCORT_LABEL_SOURCES = {
    "school_esc_outbound": ("school_esc_outbound", "out_escort_type", "out_escorting_type"),
    "school_esc_inbound": ("school_esc_inbound", "inb_escort_type", "inb_escorting_type"),
}


def _listed_ids(df: DataFrame, column: str) -> Column:
    """How many ids a ``_``-separated list names; a single number counts once."""
    if column not in df.columns:
        return F.lit(0).cast("bigint")
    if not isinstance(df.schema[column].dataType, StringType):
        return F.when(F.col(column).isNull(), 0).otherwise(1).cast("bigint")
    text = F.trim(F.col(column))
    return (
        F.when(F.col(column).isNull() | (text == ""), 0)
        .otherwise(F.size(F.split(text, "_")))
        .cast("bigint")
    )


def normalize_escort_fields(tours: DataFrame, config: Config) -> DataFrame:
    """Escort labels per direction from three candidate columns, and the escortee count."""
    for name in ESCORT_FIELDS:
        tours = materialize(tours, name, resolve_source(tours, config.candidates(name)))

    def stated(column: str) -> Column:
        value = F.col(column).cast("string")
        return F.when(F.trim(value) != "", value)

    labels = {}
    for target, sources in ESCORT_LABEL_SOURCES.items():
        present = [stated(c) for c in sources if c in tours.columns]
        if present:
            labels[target] = label_column(F.coalesce(*present), config.escort_labels)
    counts = F.greatest(
        _listed_ids(tours, "out_escorted_tour_ids"), _listed_ids(tours, "inb_escorted_tour_ids")
    )
    given = (
        [F.col("num_escortees").try_cast("bigint")] if "num_escortees" in tours.columns else []
    )
    return tours.withColumns({**labels, "num_escortees": F.coalesce(*given, counts)})


def add_vot_bin(
    df: DataFrame, source: str, output: str, mapping: dict[str, str] | None, fallback: str | None
) -> DataFrame:
    """Value-of-time bin by label table, with a fallback for anything unmapped."""
    if output == source and output in df.columns:
        return df
    default = F.lit(fallback).cast("string")
    if source not in df.columns or not mapping:
        return df.withColumn(output, default)
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    found = F.try_element_at(table, F.col(source).cast("string"))
    return df.withColumn(output, F.coalesce(found, default))


def canonical_origins(tours: DataFrame, hh: DataFrame) -> DataFrame:
    """Home zone as origin; at-work subtours start at the parent tour's destination."""
    if "origin" not in tours.columns:
        return tours
    result, home = tours, F.lit(None).cast("bigint")
    if {"household_id", "home_zone_id"} <= set(hh.columns) and "household_id" in tours.columns:
        homes = hh.groupBy("household_id").agg(F.min("home_zone_id").alias("_home"))
        result, home = result.join(homes, "household_id", "left"), F.col("_home")
    parents: list[Column] = []
    for i, (parent, own) in enumerate(
        (("parent_tour_id", "tour_id"), ("survey_parent_tour_id", "survey_tour_id"))
    ):
        if not {parent, own, "destination"} <= set(tours.columns):
            continue
        destinations = (
            tours.select(integer_text(own).alias(f"_key{i}"), "destination")
            .filter(F.col(f"_key{i}").isNotNull())
            .groupBy(f"_key{i}")
            .agg(F.min("destination").alias(f"_parent{i}"))
        )
        # Only rows that name a parent are joined; the rest keep a null.
        named = result.filter(F.col(parent).isNotNull()).withColumn(
            f"_key{i}", integer_text(parent)
        )
        matched = named.join(destinations, f"_key{i}", "left").drop(f"_key{i}")
        result = matched.unionByName(
            result.filter(F.col(parent).isNull()), allowMissingColumns=True
        )
        parents.append(F.col(f"_parent{i}"))
    category = (
        normalized("tour_category") if "tour_category" in tours.columns else F.lit("")
    )
    origin = F.when(
        category.isin("atwork", "at_work"), F.coalesce(*parents, F.col("origin"))
    ).otherwise(F.coalesce(home, F.col("origin")))
    helpers = ["_home", "_parent0", "_parent1"]
    return result.withColumn("origin", origin).drop(*helpers)


def _adulthood(persons: DataFrame) -> Column | None:
    sources = []
    kind = next((c for c in ("person_type", "ptype", "PERTYPE") if c in persons.columns), None)
    if kind is not None:
        code = F.col(kind).try_cast("bigint")
        sources.append(F.when(code.between(1, 5), True).when(code.between(6, 8), False))
    age_column = next((c for c in ("age", "age_app", "age_fv") if c in persons.columns), None)
    if age_column is not None:
        age = F.col(age_column).try_cast("double")
        sources.append(F.when(age.between(0, 994), age >= 18))
    return F.coalesce(*sources) if sources else None


def joint_composition(tours: DataFrame, participants: DataFrame, persons: DataFrame) -> DataFrame:
    """Adults, children or mixed from the participants; a given value stays."""
    adult = _adulthood(persons)
    if (
        adult is None
        or "person_id" not in persons.columns
        or "person_id" not in participants.columns
    ):
        return tours
    people = persons.groupBy("person_id").agg(F.min(adult).alias("_adult"))
    members = participants.join(people, "person_id").filter(F.col("_adult").isNotNull())
    result = tours
    candidates = [F.col("composition").cast("string")] if "composition" in tours.columns else []
    helpers = []
    for i, key in enumerate(("joint_tour_id", "tour_id")):
        if key not in tours.columns or key not in participants.columns:
            continue
        kinds = (
            members.groupBy(integer_text(key).alias(f"_ck{i}"))
            .agg(F.min("_adult").alias("_all"), F.max("_adult").alias("_any"))
            .filter(F.col(f"_ck{i}").isNotNull())
            .select(
                f"_ck{i}",
                F.when(F.col("_all"), "adults")
                .when(~F.col("_any"), "children")
                .otherwise("mixed")
                .alias(f"_c{i}"),
            )
        )
        result = result.withColumn(f"_ck{i}", integer_text(key)).join(kinds, f"_ck{i}", "left")
        candidates.append(F.col(f"_c{i}"))
        helpers += [f"_ck{i}", f"_c{i}"]
    if not helpers:
        return tours
    return result.withColumn("composition", F.coalesce(*candidates)).drop(*helpers)


def add_stop_counts(tours: DataFrame) -> DataFrame:
    """Stops per direction from text like ``2out_1in``."""
    if "stop_frequency" not in tours.columns:
        return tours
    text = F.col("stop_frequency").cast("string")
    outbound = F.split(text, "out_").getItem(0).cast("int")
    inbound = F.regexp_replace(F.element_at(F.split(text, "out_"), -1), "in", "").cast("int")
    return tours.withColumns(
        {
            "num_ob_stops": outbound,
            "num_ib_stops": inbound,
            "num_tot_stops": outbound + inbound,
        }
    )


def add_party_size(tours: DataFrame, participants: DataFrame | None) -> DataFrame:
    """Party size: participant rows, else the stated number, else 1."""
    sources, result = [], tours
    if (
        participants is not None
        and "tour_id" in tours.columns
        and "tour_id" in participants.columns
    ):
        counts = participants.groupBy("tour_id").agg(F.count(F.lit(1)).alias("_party"))
        result = result.join(counts, "tour_id", "left")
        sources.append(F.col("_party"))
    for name in ("number_of_participants", "NUMBER_HH"):
        if name in tours.columns:
            sources.append(F.col(name).try_cast("bigint"))
    sources.append(F.lit(1).cast("bigint"))
    return result.withColumn("NUMBER_HH", F.coalesce(*sources)).drop("_party")


def first_inbound_trip(trips: DataFrame, value: str, output: str) -> DataFrame:
    """Value of the inbound trip with the lowest trip number of each tour."""
    inbound = trips.filter(lowered("outbound").isin("false", "0"))
    order = F.col("trip_num") if "trip_num" in trips.columns else F.lit(0)
    tie = F.col("trip_id") if "trip_id" in trips.columns else F.lit(0)
    return inbound.groupBy("tour_id").agg(
        F.min_by(F.struct(F.col(value).alias("v")), F.struct(order.alias("n"), tie.alias("t")))
        .getField("v")
        .alias(output)
    )


def attach_first_inbound_depart(tours: DataFrame, trips: DataFrame | None) -> DataFrame:
    needed = {"tour_id", "outbound", "trip_num", "depart_hour"}
    if trips is None or not needed <= set(trips.columns) or "tour_id" not in tours.columns:
        return tours
    name = "first_inbound_trip_depart"
    derived = first_inbound_trip(trips, "depart_hour", "_first_inbound")
    joined = tours.join(derived, "tour_id", "left")
    given = [F.col(name)] if name in tours.columns else []
    return joined.withColumn(name, F.coalesce(*given, F.col("_first_inbound"))).drop(
        "_first_inbound"
    )


HOUSEHOLD_COLUMNS = ("HHVEH", "WORKERS", "LICENSEDDRIVERS", "ADULTS")


def attach_household(df: DataFrame, hh: DataFrame, config: Config) -> DataFrame:
    """Income (own value first) and household counts, in one join."""
    if "household_id" not in df.columns or "household_id" not in hh.columns:
        return df
    income = resolve_source(hh, config.candidates("income_segment"))
    reference = AUTO_SUFFICIENCY_COLUMNS[config.auto_sufficiency_basis]
    wanted = dict.fromkeys((*HOUSEHOLD_COLUMNS, reference))
    counts = [c for c in wanted if c in hh.columns and c not in df.columns]
    extra = [F.col(income).alias("_hh_income")] if income else []
    joined = df.join(hh.select("household_id", *counts, *extra), "household_id", "left")
    if not income:
        return joined
    own = [F.col("income_segment")] if "income_segment" in df.columns else []
    return joined.withColumn(
        "income_segment", F.coalesce(*own, F.col("_hh_income"))
    ).drop("_hh_income")


def add_zone_columns(df: DataFrame, run: Run, config: Config) -> DataFrame:
    """Fine and coarse zones and geographies of origin, destination and lot."""
    if config.use_maz and {"origin", "destination"} <= set(df.columns):
        df = df.withColumns({"o_maz": F.col("origin"), "d_maz": F.col("destination")})
    for zone, taz in (("origin", "OTAZ"), ("destination", "DTAZ"), ("pnr_zone_id", "pnr_taz")):
        df = to_taz(df, zone, taz, run.land_use, config)
    df = add_configured_geographies(df, "origin", "origin", "OTAZ", config)
    return add_configured_geographies(df, "destination", "destination", "DTAZ", config)


def enrich_tours(run: Run, config: Config, skim: Skim | None = None) -> Run:
    tours = canonical_origins(run.tours, run.hh)
    tours = auto_sufficiency(attach_household(tours, run.hh, config), config)
    tours = add_zone_columns(add_stop_counts(tours), run, config)
    if skim is not None and {"OTAZ", "DTAZ"} <= set(tours.columns):
        tours = add_skim_value(tours.drop("SKIMDIST"), skim, "OTAZ", "DTAZ", "SKIMDIST")
    if {"SKIMDIST", "tour_distance"} <= set(tours.columns):
        tours = tours.withColumn(
            "tour_distance",
            F.coalesce(F.col("tour_distance").try_cast("double"), F.col("SKIMDIST")),
        )
    tours = add_party_size(tours, run.joint_participants)
    if run.joint_participants is not None:
        tours = joint_composition(tours, run.joint_participants, run.per)
    if {"start_hour", "end_hour"} <= set(tours.columns):
        duration = F.col("end_hour") - F.col("start_hour") + 1
        tours = tours.withColumn("tourdur", clip(duration, 1, 48))
    tours = attach_first_inbound_depart(tours, run.trips)
    if "tour_purpose" in tours.columns:
        tours = tours.withColumn("summary_tour_purpose", summary_purpose(tours.columns, config))
    return run.with_tables(tours=tours)


# --- time periods ------------------------------------------------------------------------------


def add_period(df: DataFrame, periods: DataFrame, source: str, output: str) -> DataFrame:
    """Label of a period number from the (period, label) table (one row per period of a day)."""
    if source not in df.columns:
        return df
    table = periods.select(F.col("period").alias("_period"), F.col("label").alias(output))
    keyed = df.drop(output).withColumn("_period", F.col(source).try_cast("bigint"))
    return keyed.join(table, "_period", "left").drop("_period")


def add_time_periods(run: Run, periods: DataFrame) -> Run:
    """Trip, tour start and tour end periods, and the period of the first inbound trip."""
    trips = add_period(run.trips, periods, "depart_hour", "trip_period")
    tours = add_period(run.tours, periods, "start_hour", "start_period")
    tours = add_period(tours, periods, "end_hour", "end_period")
    if {"tour_id", "outbound", "trip_period"} <= set(trips.columns):
        first = first_inbound_trip(trips, "trip_period", "first_inbound_trip_period")
        tours = tours.drop("first_inbound_trip_period").join(first, "tour_id", "left")
    return run.with_tables(trips=trips, tours=tours)
