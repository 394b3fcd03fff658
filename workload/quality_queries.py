"""Checks, fits, segments, weighting modes and profiles over the star-schema run."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oracle.summaries_sql import SUMMARY_SQL
from tripweave.operators import quality, segments
from tripweave.plans.registry import contract_violations, get_summary
from tripweave.plans.weighting import (
    counted_together,
    default_modes,
    summaries_by_mode,
    summaries_by_segment,
)
from tripweave.sources import star, tables
from tripweave.sources.lineage import cut_lineage
from workload.context import Registry

# A run with orphans in every relation: table, key, row identifier, its remainder zero, foreign key.
ORPHANS = (
    ("per", "household_id", "person_id", 47, -1),
    ("day", "household_id", "day_id", 43, -1),
    ("day", "person_id", "day_id", 41, -2),
    ("tours", "household_id", "tour_id", 89, -1),
    ("tours", "person_id", "tour_id", 83, -2),
    ("trips", "household_id", "trip_id", 97, -1),
    ("trips", "person_id", "trip_id", 71, -2),
    ("trips", "tour_id", "trip_id", 50, -5),
    ("vehicles", "household_id", "vehicle_id", 37, -1),
    ("joint_participants", "person_id", "tour_id", 31, -2),
    ("joint_participants", "tour_id", "person_id", 29, -5),
)
TARGETS = {"household_id": "hh", "person_id": "per", "tour_id": "tours"}
SCATTER = (
    "scatter AS (SELECT * FROM (SELECT id, CAST(FACTYPE AS VARCHAR) AS facility_type, UNNEST(['AM', "
    "'MD', 'PM', 'Day']) AS period, UNNEST([am_vol, md_vol, pm_vol, day_vol]) AS observed_volume FROM "
    "counts) JOIN (SELECT id, CAST(FACTYPE AS VARCHAR) AS facility_type, UNNEST(['AM', 'MD', 'PM', "
    "'Day']) AS period, UNNEST([am_vol, md_vol, pm_vol, day_vol]) AS modeled_volume FROM volumes) "
    "USING (id, facility_type, period) WHERE observed_volume IS NOT NULL AND modeled_volume IS NOT "
    "NULL)"
)
CTES = {"scatter": SCATTER[len("scatter AS (") : -1]}
registry = Registry(CTES)
query = registry.add
queries, oracle_sql = registry.queries, registry.oracle_sql


@query(
    "quality_relationships",
    "source_table string, key string, target_table string, state string, orphan_count bigint",
    "SELECT *, n AS orphan_count, CASE WHEN n > 0 THEN 'failed' ELSE 'passed' END AS state FROM ("
    + " UNION ALL ".join(
        f"SELECT '{table}' AS source_table, '{key}' AS key, '{TARGETS[key]}' AS target_table, COUNT(*) AS n "
        f"FROM {'participants' if table == 'joint_participants' else table} WHERE {own} % {part} = 0 AND "
        f"{key} IS NOT NULL"
        for table, key, own, part, _ in ORPHANS
    )
    + ")",
)
def relationships(ctx):
    run = ctx.run
    planted: dict[str, dict] = {}
    for table, key, own, part, foreign in ORPHANS:
        lost = F.expr(f"CASE WHEN {own} % {part} = 0 AND {key} IS NOT NULL THEN {foreign} ELSE {key} END")
        planted.setdefault(table, {})[key] = lost
    tables_ = {table: run.tables[table].withColumns(columns) for table, columns in planted.items()}
    return quality.relationship_report(run.with_tables(**tables_))


@query(
    "quality_count_scatter",
    "id bigint, facility_type string, period string, observed_volume double, modeled_volume double",
    "SELECT * FROM scatter",
)
def scatter(ctx):
    return quality.count_scatter(*star.count_tables(ctx.tables))


@query(
    "quality_count_fit",
    "facility_type string, period string, slope double, intercept double, r_squared double, "
    "n_locations bigint, observed_min double, observed_max double, equation_label string, "
    "r_squared_label string",
    "SELECT *, CASE WHEN slope IS NULL THEN '' ELSE printf('y = %.2fx %s %.2f', slope, CASE WHEN "
    "intercept >= 0 THEN '+' ELSE '-' END, ABS(intercept)) END AS equation_label, CASE WHEN slope IS "
    "NULL THEN '' ELSE printf('R² = %.2f', r_squared) END AS r_squared_label FROM (SELECT "
    "facility_type, period, CASE WHEN sp THEN slope END AS slope, CASE WHEN sp THEN my - slope * mx "
    "END AS intercept, CASE WHEN sp THEN CASE WHEN flat THEN 1.0 ELSE GREATEST(0, LEAST(1, r2)) END "
    "END AS r_squared, n_locations, observed_min, observed_max FROM (SELECT facility_type, period, "
    "COUNT(*) AS n_locations, MIN(x) AS observed_min, MAX(x) AS observed_max, MIN(x) < MAX(x) AS sp, "
    "MIN(y) = MAX(y) AS flat, AVG(x) AS mx, AVG(y) AS my, REGR_SXY(y, x) / NULLIF(REGR_SXX(y, x), 0) "
    "AS slope, 1 - (REGR_SYY(y, x) - POW(REGR_SXY(y, x), 2) / NULLIF(REGR_SXX(y, x), 0)) / "
    "NULLIF(REGR_SYY(y, x), 0) AS r2 FROM (SELECT *, observed_volume AS x, modeled_volume AS y FROM "
    "scatter UNION ALL SELECT * REPLACE ('All' AS facility_type), observed_volume, modeled_volume "
    "FROM scatter) GROUP BY ALL))",
)
def fit(ctx):
    return quality.count_fit(quality.count_scatter(*star.count_tables(ctx.tables)))


@query(
    "quality_summary_contracts",
    "summary_id string, violations int, rows bigint",
    "SELECT 'household_size_distribution' AS summary_id, 0 AS violations, COUNT(DISTINCT HHSIZE) AS "
    "rows FROM hh UNION ALL SELECT 'tour_category_distribution', 0, COUNT(DISTINCT tour_category) FROM "
    "tours",
)
def contracts(ctx):
    parts = []
    for summary_id in ("household_size_distribution", "tour_category_distribution"):
        definition = get_summary(summary_id)
        df = definition.build(ctx.run, star.CONFIG)
        found = len(contract_violations(df, definition))
        parts.append(
            df.agg(F.count(F.lit(1)).alias("rows")).select(
                F.lit(summary_id).alias("summary_id"), F.lit(found).alias("violations"), "rows"
            )
        )
    return parts[0].unionByName(parts[1])


@query(
    "quality_table_profile",
    "column string, type string, distinct_values bigint, first_values string",
    "SELECT c AS column, t AS type, COUNT(DISTINCT v) AS distinct_values, ARRAY_TO_STRING(LIST_SORT("
    "LIST(DISTINCT v) FILTER (v IS NOT NULL))[1:5], '|') AS first_values FROM (SELECT 'o_orderkey' "
    "AS c, 'bigint' AS t, CAST(o_orderkey AS VARCHAR) AS v FROM orders UNION ALL SELECT "
    "'o_orderstatus', 'string', o_orderstatus FROM orders UNION ALL SELECT 'o_orderpriority', "
    "'string', o_orderpriority FROM orders) GROUP BY ALL",
)
def profile(ctx):
    orders = ctx.tables["orders"].select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return tables.table_profile(orders)


@query(
    "quality_value_counts",
    "value string, records bigint",
    "SELECT trip_mode AS value, COUNT(*) AS records FROM trips GROUP BY 1",
)
def value_counts(ctx):
    return tables.value_counts(ctx.run.trips, "trip_mode")


# --- segments ------------------------------------------------------------------------------------

SEGMENT_SCHEMA = "segment_id string, table_name string, n bigint"
COUNTED = ("hh", "per", "tours", "trips", "vehicles", "joint_participants", "day")


def counted(units):
    parts = [
        unit.run.tables[t].agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(unit.segment_id).alias("segment_id"), F.lit(t).alias("table_name"), "n"
        )
        for unit in units
        for t in COUNTED
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def segment_sql(conditions: dict[str, dict[str, str]]) -> str:
    names = {"joint_participants": "participants"}
    return " UNION ALL ".join(
        f"SELECT '{segment}' AS segment_id, '{t}' AS table_name, COUNT(*) AS n FROM "
        f"{names.get(t, t)} WHERE {by_table[t]}"
        for segment, by_table in conditions.items()
        for t in COUNTED
    )


def in_hh(condition: str) -> dict[str, str]:
    member = f"household_id IN (SELECT household_id FROM hh WHERE {condition})"
    return dict.fromkeys(COUNTED, member)


@query(
    "segments_by_household_column",
    SEGMENT_SCHEMA,
    segment_sql({
        "full": in_hh("TRUE"),
        "north": in_hh("market = 'north'"),
        "rest": in_hh("market = 'south'"),
    }),
)
def by_household(ctx):
    spec = segments.Segmentation(
        "market", {"north": ("north",), "rest": ("south",)}, column="market"
    )
    return counted(segments.analysis_units(ctx.run, spec))


_MODES = "tour_id IN (SELECT tour_id FROM tours WHERE tour_mode IN ('WALK', 'BIKE'))"
_PEOPLE = "person_id IN (SELECT person_id FROM tours WHERE tour_mode IN ('WALK', 'BIKE'))"
_HOMES = "household_id IN (SELECT household_id FROM tours WHERE tour_mode IN ('WALK', 'BIKE'))"


@query(
    "segments_by_tour_mode",
    SEGMENT_SCHEMA,
    segment_sql({
        "full": dict.fromkeys(COUNTED, "TRUE"),
        "active": {"hh": _HOMES, "per": _PEOPLE, "tours": _MODES, "trips": _MODES,
                   "vehicles": _HOMES, "joint_participants": _MODES, "day": _PEOPLE},
    }),
)
def by_tour(ctx):
    """A person with several matching tours is kept once."""
    spec = segments.Segmentation(
        "mode", {"active": ("WALK", "BIKE")}, column="tour_mode", table="tours"
    )
    return counted(segments.analysis_units(ctx.run, spec))


@query(
    "segments_by_lookup",
    SEGMENT_SCHEMA,
    segment_sql({
        "full": in_hh("TRUE"),
        "odd": in_hh("home_zone_id % 2 = 1"),
    }),
)
def by_lookup(ctx):
    rows = ctx.tables["nation"].selectExpr(
        "n_nationkey AS key", "CASE WHEN n_nationkey % 2 = 1 THEN 'odd' ELSE 'even' END AS value"
    )
    spec = segments.Segmentation(
        "parity", {"odd": ("odd",)}, table="hh", lookup=rows, key="home_zone_id"
    )
    return counted(segments.analysis_units(ctx.run, spec))


@query(
    "segments_by_person_type_summary",
    "segment_id string, person_type string, person_count double",
    "SELECT 'full' AS segment_id, CAST(person_type AS VARCHAR) AS person_type, SUM(finalweight) AS "
    "person_count FROM per GROUP BY 2 UNION ALL SELECT 'students', CAST(person_type AS VARCHAR), "
    "SUM(finalweight) FROM per WHERE person_type IN (3, 6) GROUP BY 2",
)
def by_person(ctx):
    spec = segments.Segmentation(
        "type", {"students": (3, 6)}, column="person_type", table="per"
    )
    definition = get_summary("person_type_distribution")
    parts = [
        definition.build(unit.run, star.CONFIG).withColumn("segment_id", F.lit(unit.segment_id))
        for unit in segments.analysis_units(ctx.run, spec)
    ]
    return parts[0].unionByName(parts[1])


# Segments that overlap: a household of five is also one of three or more.
SIZES = segments.Segmentation(
    "size",
    {"single": (1,), "three_or_more": tuple(range(3, 20)), "five_or_more": tuple(range(5, 20))},
    column="HHSIZE",
    table="hh",
)
SIZE_CONDITIONS = {"single": "HHSIZE = 1", "three_or_more": "HHSIZE >= 3", "five_or_more": "HHSIZE >= 5"}


@query(
    "segments_as_membership",
    SEGMENT_SCHEMA,
    segment_sql({name: in_hh(condition) for name, condition in SIZE_CONDITIONS.items()}),
)
def membership(ctx):
    """Rows of every table by segment, each table read once for all of them."""
    together = segments.segments_together(ctx.run, SIZES)
    parts = [
        together.tables[t]
        .groupBy(F.col(segments.SEGMENT).alias("segment_id"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("table_name", F.lit(t))
        for t in COUNTED
    ]
    return reduce(DataFrame.unionByName, parts)


@query(
    "weighting_modes_of_one_summary",
    "tour_category string, tour_count double, weighting_mode string",
    "SELECT tour_category, SUM(htw) AS tour_count, 'weighted' AS weighting_mode FROM hh_tours GROUP BY "
    "1 UNION ALL SELECT tour_category, SUM(htw / finalweight), 'unweighted' FROM hh_tours GROUP BY 1",
)
def modes(ctx):
    return summaries_by_mode(ctx.run, star.CONFIG, "tour_category_distribution")


# Trips with their person-travel weight in each mode: all weights 1, or the household's size.
MODE_WEIGHTS = {"unweighted": "1.0", "by_size": "CAST(HHSIZE AS DOUBLE)"}


def mode_expressions() -> dict[str, str]:
    found = {}
    for mode, weight in MODE_WEIGHTS.items():
        found[f"persons_{mode}"] = (
            f"SELECT person_id, {weight} AS w FROM per JOIN (SELECT household_id, HHSIZE FROM hh) h "
            "USING (household_id)"
        )
        found[f"party_{mode}"] = (
            f"SELECT tour_id, SUM(w) AS pw FROM participants JOIN persons_{mode} USING (person_id) "
            "GROUP BY 1"
        )
        found[f"trips_{mode}"] = (
            "SELECT t.*, CASE WHEN tour_category <> 'joint' THEN w ELSE COALESCE(pw, w * CASE WHEN "
            "num_participants > 0 AND num_participants < 995 THEN num_participants ELSE 1 END) END AS "
            f"ptw FROM trips t LEFT JOIN persons_{mode} USING (person_id) LEFT JOIN party_{mode} USING "
            "(tour_id)"
        )
    return found


CTES.update(mode_expressions())

# Summary: its other keys as one text, and its measure.
TRIP_COUNTS = {
    "trip_purpose_distribution": (("trip_purpose",), "trip_count"),
    "stop_destination_purpose_by_tour_purpose": (("stop_destination_purpose",), "stop_count"),
    "trip_mode_by_tour_purpose_and_tour_mode": (("tour_mode", "trip_mode"), "trip_count"),
    "trip_distance_by_purpose": (("distance_bin",), "trip_count"),
    "stop_out_of_direction_distance_by_tour_purpose": (("distance_bin",), "stop_count"),
}


def trip_counts_sql() -> str:
    parts = []
    for mode in ("weighted", *MODE_WEIGHTS):
        for sid, (keys, measure) in TRIP_COUNTS.items():
            body = SUMMARY_SQL[sid]
            if mode != "weighted":
                body = body.replace("person_trips", f"trips_{mode}")
            names = ", ".join(f"CAST({k} AS VARCHAR)" for k in keys)
            parts.append(
                f"SELECT '{sid}' AS summary_id, '{mode}' AS weighting_mode, tour_purpose, "
                f"CONCAT_WS('/', {names}) AS category, {measure} AS value FROM ({body})"
            )
    return " UNION ALL ".join(parts)


@query(
    "weighting_trip_counts_of_one_scan",
    "summary_id string, weighting_mode string, tour_purpose string, category string, value double",
    trip_counts_sql(),
)
def trip_counts(ctx):
    modes = default_modes()
    modes.register_columns("by_size", "By household size", {"households": "HHSIZE"})
    (trips,) = counted_together(
        ctx.run, star.CONFIG, list(TRIP_COUNTS), ["weighted", *MODE_WEIGHTS], modes
    )
    trips.grouped = cut_lineage(trips.grouped)
    parts = [
        trips.table(sid).select(
            F.lit(sid).alias("summary_id"),
            "weighting_mode",
            "tour_purpose",
            F.concat_ws("/", *keys).alias("category"),
            F.col(measure).alias("value"),
        )
        for sid, (keys, measure) in TRIP_COUNTS.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def segment_counts_sql() -> str:
    """Trip counts of each segment: the run's trips cut to its households, or its tours' people."""
    parts = []
    for segment, condition in SIZE_CONDITIONS.items():
        own = f"(SELECT * FROM {{}} WHERE household_id IN (SELECT household_id FROM hh WHERE {condition}))"
        for mode in ("weighted", "unweighted"):
            table = "person_trips" if mode == "weighted" else "trips_unweighted"
            for sid, (keys, measure) in TRIP_COUNTS.items():
                body = SUMMARY_SQL[sid].replace("person_trips", own.format(table))
                names = ", ".join(f"CAST({k} AS VARCHAR)" for k in keys)
                parts.append(
                    f"SELECT '{segment}' AS segment_id, '{sid}' AS summary_id, '{mode}' AS "
                    f"weighting_mode, tour_purpose, CONCAT_WS('/', {names}) AS category, {measure} AS "
                    f"value FROM ({body})"
                )
    return " UNION ALL ".join(parts)


@query(
    "segments_trip_counts_of_one_scan",
    "segment_id string, summary_id string, weighting_mode string, tour_purpose string, "
    "category string, value double",
    segment_counts_sql(),
)
def segment_counts(ctx):
    """Five trip summaries in two modes for three overlapping segments from one aggregation."""
    found = summaries_by_segment(ctx.run, star.CONFIG, list(TRIP_COUNTS), SIZES)
    parts = [
        found[sid].select(
            "segment_id",
            F.lit(sid).alias("summary_id"),
            "weighting_mode",
            "tour_purpose",
            F.concat_ws("/", *keys).alias("category"),
            F.col(measure).alias("value"),
        )
        for sid, (keys, measure) in TRIP_COUNTS.items()
    ]
    return reduce(DataFrame.unionByName, parts)
