"""Position of the escort event (drop-off or pick-up) within an escorting tour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripweave.functions.expressions import is_child, is_true, lowered, normalized
from tripweave.model import Run
from tripweave.operators.trips import is_outbound
from tripweave.sources.lineage import cut_lineage

EVENT_COLUMNS = {
    "escort_event_role": "string",
    "escort_event_trip_num": "int",
    "escort_stops_before_event": "int",
    "escort_stops_after_event": "int",
    "escort_event_match_status": "string",
}


def ensure_event_columns(trips: DataFrame) -> DataFrame:
    missing = {
        name: F.lit(None).cast(kind)
        for name, kind in EVENT_COLUMNS.items()
        if name not in trips.columns
    }
    return trips.withColumns(missing) if missing else trips


def event_values(role: Column, status: Column) -> dict[str, Column]:
    """Event columns of one trip row; only a matched event has a position."""
    number, matched = F.col("trip_num"), status == "matched"
    return {
        "escort_event_role": F.when(matched, role),
        "escort_event_trip_num": F.when(matched, number).cast("int"),
        "escort_stops_before_event": F.when(matched, number - 1).cast("int"),
        "escort_stops_after_event": F.when(matched, F.col("max_trip_num") - number).cast("int"),
        "escort_event_match_status": status,
    }


def with_events(trips: DataFrame, events: DataFrame) -> DataFrame:
    """Trips with these events (trip_id, _role, _status) in place of any they had.

    Where there is no event at all, the trips keep the columns they came with. Events are few and
    cut off from the plan, so what reads the trips later does not derive them again.
    """
    events = cut_lineage(events)
    if events.isEmpty():
        return trips
    values = event_values(F.col("_role"), F.col("_status"))
    return (
        trips.join(events, "trip_id", "left")
        .withColumns({name: expr.cast(EVENT_COLUMNS[name]) for name, expr in values.items()})
        .select(*[F.col(f"`{c}`") for c in trips.columns])
    )


def events_by_participants(run: Run) -> DataFrame:
    """Match adult escort trips and child trips that name the same participants.

    A key with one adult and one child trip is matched, with several on a side ambiguous.
    Only candidate rows are joined; the counts are one aggregate per key.
    """
    trips = ensure_event_columns(run.trips)
    needed = {"trip_id", "person_id", "trip_num", "outbound", "escort_participants",
              "max_trip_num", "summary_tour_purpose", "trip_purpose"}
    if not needed <= set(trips.columns) or not run.has("per", "person_id", "person_type"):
        return trips
    types = run.per.select("person_id", F.col("person_type").cast("string").alias("_ptype"))
    named = F.col("escort_participants").isNotNull() & F.col("outbound").isNotNull()
    keys = ["escort_participants", "_outbound"]
    purpose = lowered("trip_purpose")
    escorting = is_true(lowered("summary_tour_purpose") == "escort")
    delivered = is_true(purpose == F.when(is_outbound(), "school").otherwise("home"))
    child = is_child("_ptype")
    sided = (
        trips.filter(named & (escorting | delivered))
        .select("trip_id", "person_id", "escort_participants", is_outbound().alias("_outbound"),
                escorting.alias("_escorting"), delivered.alias("_delivered"))
        .join(types, "person_id", "left")
        .withColumn("_adult", is_true(~child & F.col("_escorting")))
        .withColumn("_child", is_true(child & F.col("_delivered")))
    )
    counts = sided.groupBy(*keys).agg(
        F.count_if("_adult").alias("_adults"), F.count_if("_child").alias("_children")
    )
    status = (
        F.when((F.col("_adults") == 1) & (F.col("_children") == 1), "matched")
        .when((F.col("_adults") > 1) | (F.col("_children") > 1), "ambiguous")
        .otherwise("unmatched")
    )
    role = F.when(F.col("_outbound"), "dropoff").otherwise("pickup")
    events = sided.filter("_adult").join(counts, keys, "left")
    return with_events(trips, events.select("trip_id", role.alias("_role"), status.alias("_status")))


def _linked_targets(escorting: DataFrame, trips: DataFrame) -> DataFrame:
    """(tour_id, outbound, target): where linked children's trips are met, for both directions."""
    def linked(ids: str, outbound: bool) -> Column:
        if ids not in escorting.columns:
            return F.array().cast("array<struct<outbound:boolean,child:bigint>>")
        parts = F.split(F.coalesce(F.col(ids).cast("string"), F.lit("")), "_")
        return F.transform(
            parts,
            lambda x: F.struct(
                F.lit(outbound).alias("outbound"), x.try_cast("bigint").alias("child")
            ),
        )

    both = F.concat(linked("out_escorted_tour_ids", True), linked("inb_escorted_tour_ids", False))
    links = escorting.select("tour_id", F.explode(both).alias("l")).select(
        "tour_id", F.col("l.outbound").alias("_outbound"), F.col("l.child").alias("_child")
    )
    places = {c: F.col(c) if c in trips.columns else F.lit(None) for c in ("origin", "destination")}
    met = F.when(is_outbound(), places["destination"]).otherwise(places["origin"])
    purpose = F.when(is_outbound(), "school").otherwise("home")
    child_trips = trips.filter(lowered("trip_purpose") == purpose).select(
        F.col("tour_id").alias("_child"),
        is_outbound().alias("_outbound"),
        met.try_cast("bigint").alias("_target"),
    )
    return (
        links.filter(F.col("_child").isNotNull())
        .join(child_trips, ["_child", "_outbound"])
        .filter(F.col("_target").isNotNull())
        .select("tour_id", "_outbound", "_target")
        .distinct()
    )


def events_by_tour_links(run: Run) -> DataFrame:
    """Pick the escort trip of each escorting tour and direction by its links.

    Priority: meets a linked child with the expected purpose, meets a linked child, has the
    expected purpose, is the only trip of its direction. A tie for the best leaves no event.
    Both directions share one pass: trips of escorting tours, where their links meet (trips of
    the linked tours), and one aggregate per tour and direction.
    """
    trips = ensure_event_columns(run.trips)
    needed = {"trip_id", "tour_id", "trip_num", "outbound", "trip_purpose", "max_trip_num"}
    tour_needed = ("tour_id", "summary_tour_purpose", "school_esc_outbound", "school_esc_inbound")
    if not needed <= set(trips.columns) or not run.has("tours", *tour_needed):
        return trips
    if "escort_participants" in trips.columns and run.fact(
        "has_escort_participants",
        lambda: not trips.filter(F.col("escort_participants").isNotNull()).limit(1).isEmpty(),
    ):
        return trips
    links = [c for c in ("out_escorted_tour_ids", "inb_escorted_tour_ids")
             if c in run.tours.columns]
    escorting = run.tours.filter(lowered("summary_tour_purpose") == "escort").select(
        "tour_id", "school_esc_outbound", "school_esc_inbound", *links
    )
    label = F.when(F.col("_outbound"), F.col("school_esc_outbound")).otherwise(
        F.col("school_esc_inbound")
    )
    places = {c: F.col(c) if c in trips.columns else F.lit(None) for c in ("origin", "destination")}
    place = F.when(is_outbound(), places["destination"]).otherwise(places["origin"])
    expected = F.when(is_outbound(), "escort").otherwise("home")
    rows = (
        trips.filter(F.col("outbound").isNotNull())
        .select("trip_id", "tour_id", is_outbound().alias("_outbound"),
                F.col("escort_event_role").isNull().alias("_open"),
                is_true(lowered("trip_purpose") == expected).alias("_expected"),
                place.try_cast("bigint").alias("_target"))
        .join(escorting.select("tour_id", "school_esc_outbound", "school_esc_inbound"), "tour_id")
        .filter(label.isNotNull() & ~normalized(label).isin("", "not_escorted"))
    )
    met = _linked_targets(escorting, trips).withColumn("_met", F.lit(True))
    rows = rows.join(met, ["tour_id", "_outbound", "_target"], "left")
    meets = is_true(F.col("_met"))
    ranks = (meets & F.col("_expected"), meets, F.col("_expected"), F.lit(True))
    counted = rows.groupBy("tour_id", "_outbound").agg(
        F.count(F.lit(1)).alias("_leg_trips"),
        *[F.count_if(F.col("_open") & rank).alias(f"_n{i}") for i, rank in enumerate(ranks)],
        *[F.min(F.when(F.col("_open") & rank, F.col("trip_id"))).alias(f"_trip{i}")
          for i, rank in enumerate(ranks)],
    )
    best = F.when(F.col("_n0") > 0, F.when(F.col("_n0") == 1, F.col("_trip0")))
    for i in (1, 2):
        best = best.when(F.col(f"_n{i}") > 0, F.when(F.col(f"_n{i}") == 1, F.col(f"_trip{i}")))
    best = best.when((F.col("_leg_trips") == 1) & (F.col("_n3") == 1), F.col("_trip3"))
    chosen = counted.select(
        best.alias("trip_id"),
        F.when(F.col("_outbound"), "dropoff").otherwise("pickup").alias("_role"),
        F.lit("matched").alias("_status"),
    ).filter("trip_id IS NOT NULL")
    return with_events(trips, chosen)
