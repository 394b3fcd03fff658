"""Lookup sources and rule-driven lookups over the star-schema run."""

from __future__ import annotations

from pyspark.sql import functions as F

from oracle.raw_sql import RAW_CTES
from tripweave.operators import lookup
from tripweave.operators.lookup_rules import build_rules, rules_table
from tripweave.sources import lookups, star, star_raw
from workload.context import Context, Registry

SETTINGS = {
    "defaults": {"origin": "OTAZ", "destination": "DTAZ", "sentinel_values": [9999]},
    "dimensions": {
        "PERIOD": {
            "trip": "trip_period",
            "outbound": "start_period",
            "values": {"AM": "AM", "MD": "MD", "PM": "PM"},
        }
    },
    "ignore_modes": ["BIKE"],
    "modes": {
        "DRIVEALONE": {
            "output_prefix": "skim_auto_",
            "time": {"matrix": "TIME__{PERIOD}", "fallbacks": ["TIME__MD"]},
            "dist": "DIST",
        },
        "WALK": {
            "output_prefix": "skim_",
            "walk": {
                "matrix": "maz_walk__DISTWALK",
                "origin": "o_maz",
                "destination": "d_maz",
                "fallbacks": [{"matrix": "DIST", "origin": "OTAZ", "destination": "DTAZ"}],
            },
            "access": {
                "matrix": "stop_walk__walk",
                "lookup": "key",
                "key_column": "o_maz",
                "output": "skim_total",
                "combine": "sum",
            },
            "egress": {
                "matrix": "stop_walk__walk",
                "lookup": "key",
                "key_column": "d_maz",
                "output": "skim_total",
                "combine": "sum",
            },
        },
        "PNR_TRANSIT": {
            "segment_on": "outbound",
            "segments": {
                True: {"pnr": "DIST"},
                False: {"pnr": {"matrix": "DIST", "origin": "DTAZ", "destination": "OTAZ"}},
            },
        },
        "TNC_SINGLE": {"skip": True},
    },
}
RULES = build_rules(SETTINGS)

KEYED = {"zone": "s_suppkey % 20", "walk": "CASE WHEN s_suppkey % 7 <> 3 THEN "
         "CAST(s_suppkey AS DOUBLE) / 2 END", "_order": "s_suppkey"}
OD = {
    "OMAZ": "l_suppkey % 25",
    "DMAZ": "l_partkey % 25",
    "DISTWALK": "CASE WHEN (l_suppkey + l_partkey) % 25 < 5 OR l_linenumber = 7 THEN NULL WHEN "
    "l_suppkey % 25 = 7 THEN 9999 ELSE l_quantity END",
    "actual": "l_linenumber",
    "_order": star.LINE_ORDER,
}

CTES = {
    **RAW_CTES,
    "lk": "SELECT trip_id, trip_mode, outbound, trip_period, origin, destination, origin % 10 AS oz, "
    "destination % 10 AS dz, finalweight FROM trips",
    "maz": f"SELECT o, d, ARG_MAX(v, n) AS v FROM (SELECT {OD['OMAZ']} AS o, {OD['DMAZ']} AS d, "
    f"{OD['DISTWALK']} AS v, {OD['_order']} AS n FROM lineitem) WHERE v IS NOT NULL GROUP BY ALL",
    "stop": f"SELECT k, ARG_MAX(v, n) AS v FROM (SELECT {KEYED['zone']} AS k, {KEYED['walk']} AS v, "
    f"{KEYED['_order']} AS n FROM supplier) WHERE v IS NOT NULL GROUP BY 1",
    # One row per trip and rule step; a cell without a value is found but empty.
    "steps": "SELECT trip_id, 'DRIVEALONE.time' AS chain, 'DRIVEALONE.time' AS rule, 0 AS step, CASE "
    "WHEN trip_period IN ('AM', 'MD', 'PM') THEN 'TIME__' || trip_period END AS matrix, CASE "
    "trip_period WHEN 'AM' THEN a.v WHEN 'MD' THEN m.v END AS v, CASE WHEN trip_period IS NULL OR "
    "trip_period = 'EA' THEN 'missing_dimension_value:PERIOD' WHEN trip_period = 'PM' THEN "
    "'missing_matrix' WHEN trip_period = 'AM' AND a.v = 9999 THEN 'sentinel_value' END AS reason FROM "
    "lk JOIN am_cells a ON a.o = oz AND a.d = dz JOIN md_cells m ON m.o = oz AND m.d = dz WHERE "
    "trip_mode = 'DRIVEALONE' UNION ALL SELECT trip_id, 'DRIVEALONE.time', "
    "'DRIVEALONE.time.fallback_1', 1, 'TIME__MD', v, NULL FROM lk JOIN md_cells ON o = oz AND d = dz "
    "WHERE trip_mode = 'DRIVEALONE' UNION ALL SELECT trip_id, 'DRIVEALONE.dist', 'DRIVEALONE.dist', "
    "0, 'DIST', v, NULL FROM lk JOIN dist_cells ON o = oz AND d = dz WHERE trip_mode = 'DRIVEALONE' "
    "UNION ALL SELECT trip_id, 'WALK.walk', 'WALK.walk', 0, 'maz_walk__DISTWALK', v, CASE WHEN v IS "
    "NULL THEN 'missing_od' WHEN v = 9999 THEN 'sentinel_value' END FROM lk LEFT JOIN maz ON o = "
    "origin AND d = destination WHERE trip_mode = 'WALK' UNION ALL SELECT trip_id, 'WALK.walk', "
    "'WALK.walk.fallback_1', 1, 'DIST', v, NULL FROM lk JOIN dist_cells ON o = oz AND d = dz WHERE "
    "trip_mode = 'WALK' UNION ALL SELECT trip_id, 'WALK.access', 'WALK.access', 0, "
    "'stop_walk__walk', v, CASE WHEN v IS NULL THEN 'missing_od' END FROM lk LEFT JOIN stop ON k = "
    "origin WHERE trip_mode = 'WALK' UNION ALL SELECT trip_id, 'WALK.egress', 'WALK.egress', 0, "
    "'stop_walk__walk', v, CASE WHEN v IS NULL THEN 'missing_od' END FROM lk LEFT JOIN stop ON k = "
    "destination WHERE trip_mode = 'WALK' UNION ALL SELECT trip_id, 'PNR_TRANSIT.' || CASE WHEN "
    "outbound THEN 'True' ELSE 'False' END || '.pnr', 'PNR_TRANSIT.' || CASE WHEN outbound THEN "
    "'True' ELSE 'False' END || '.pnr', 0, 'DIST', v, NULL FROM lk JOIN dist_cells ON o = CASE WHEN "
    "outbound THEN oz ELSE dz END AND d = CASE WHEN outbound THEN dz ELSE oz END WHERE trip_mode = "
    "'PNR_TRANSIT'",
    "solved": "SELECT trip_id, chain, MIN(step) FILTER (reason IS NULL) AS solved FROM steps GROUP BY "
    "ALL",
    "chosen": "SELECT trip_id, chain, v FROM steps JOIN solved USING (trip_id, chain) WHERE step = "
    "solved",
    "failed": "SELECT trip_id, chain, rule, matrix, reason, step FROM steps JOIN solved USING "
    "(trip_id, chain) WHERE solved IS NULL",
}
registry = Registry(CTES)
query = registry.add
queries, oracle_sql = registry.queries, registry.oracle_sql


def sources(ctx: Context) -> lookups.LookupSources:
    matrices = star_raw.matrix_rows(ctx.tables)
    return lookups.LookupSources(
        ctx.spark,
        (
            lookups.TableSource("stop_walk.csv", star._select(ctx.tables["supplier"], KEYED)),
            lookups.TableSource("maz_walk.csv", star._select(ctx.tables["lineitem"], OD)),
        ),
        (
            lookups.MatrixSource(
                "los",
                matrices,
                tuple(star_raw.MATRICES),
                star_raw.COARSE_ZONES,
            ),
        ),
    )


def trips(ctx: Context):
    return ctx.run.trips.withColumns(
        {
            "OTAZ": F.col("origin") % 10,
            "DTAZ": F.col("destination") % 10,
            "o_maz": F.col("origin"),
            "d_maz": F.col("destination"),
        }
    )


def tours(ctx: Context):
    return ctx.run.tours.withColumns(
        {"OTAZ": F.col("origin") % 10, "DTAZ": F.col("destination") % 10}
    )


def annotated(ctx: Context) -> lookup.Annotated:
    return lookup.annotate_trips(trips(ctx), RULES, sources(ctx))


@query(
    "lookup_keyed_table",
    "key double, walk double",
    f"SELECT k AS key, walk FROM (SELECT {KEYED['zone']} AS k, ARG_MAX({KEYED['walk']}, s_suppkey) "
    f"FILTER ({KEYED['walk']} IS NOT NULL) AS walk FROM supplier GROUP BY 1)",
)
def keyed_table(ctx):
    return lookups.keyed_table(star._select(ctx.tables["supplier"], KEYED), "zone", ["walk"])


@query(
    "lookup_od_table_demanded",
    "o double, d double, DISTWALK double, actual double",
    f"SELECT o, d, ARG_MAX(v, n) FILTER (v IS NOT NULL) AS DISTWALK, ARG_MAX(a, n) AS actual FROM "
    f"(SELECT {OD['OMAZ']} AS o, {OD['DMAZ']} AS d, {OD['DISTWALK']} AS v, l_linenumber AS a, "
    f"{OD['_order']} AS n FROM lineitem) WHERE (o, d) IN (SELECT (home_zone_id, workplace_zone_id) "
    "FROM per) GROUP BY ALL",
)
def od_table(ctx):
    demand = (
        ctx.run.per.select(F.col("home_zone_id").alias("o"), F.col("workplace_zone_id").alias("d"))
        .filter("d IS NOT NULL")
        .distinct()
    )
    rows = star._select(ctx.tables["lineitem"], OD)
    return lookups.od_table(rows, "OMAZ", "DMAZ", ["DISTWALK", "actual"], demand)


CATALOGUE_VALUES = ", ".join(
    f"('{name}', '{source}', '{kind}', {size})"
    for file, names, kind, size in (
        ("stop_walk.csv", ("stop_walk__walk",), "keyed_column", 0),
        ("maz_walk.csv", ("maz_walk__DISTWALK", "maz_walk__actual"), "od_table", 0),
        ("los", ("DIST", "TIME__AM", "TIME__MD"), "od_matrix", 10),
    )
    for n in names
    for name, source in ((n, f"{file}::{n}"), (f"{file}::{n}", f"{file}::{n}"))
)


@query(
    "lookup_catalogue",
    "matrix_name string, source_id string, source_kind string, size int, cells bigint",
    "SELECT matrix_name, source_id, source_kind, size, COALESCE(cells, 0) AS cells FROM (VALUES "
    f"{CATALOGUE_VALUES}) AS c(matrix_name, source_id, source_kind, size) LEFT JOIN (SELECT "
    "'stop_walk.csv::stop_walk__walk' AS source_id, COUNT(*) AS cells FROM stop UNION ALL SELECT "
    "'maz_walk.csv::maz_walk__DISTWALK', COUNT(*) FROM maz UNION ALL SELECT "
    f"'maz_walk.csv::maz_walk__actual', COUNT(DISTINCT ({OD['OMAZ']}, {OD['DMAZ']})) FROM lineitem "
    "UNION ALL SELECT s, (SELECT COUNT(*) FROM dist_cells) FROM (VALUES ('los::DIST'), "
    "('los::TIME__AM'), ('los::TIME__MD')) m(s)) USING (source_id)",
)
def catalogue(ctx):
    found = sources(ctx)
    cells = found.values().groupBy("source_id").agg(F.count(F.lit(1)).alias("cells"))
    return (
        found.catalogue()
        .join(cells, "source_id", "left")
        .withColumn("cells", F.coalesce("cells", F.lit(0)))
    )


@query(
    "lookup_rules_used",
    "rule_name string, role string, n bigint",
    "SELECT rule AS rule_name, CASE WHEN step = 0 THEN 'primary' ELSE 'fallback' END AS role, "
    "COUNT(*) AS n FROM steps GROUP BY ALL",
)
def rules_used(ctx):
    """The rule table joined with the rows each rule plans."""
    steps = lookup.planned_steps(trips(ctx), RULES.trips, "trip_mode", "trip_id")
    planned = steps.join(lookup.rule_texts(steps, RULES.trips), "rule_index")
    table = rules_table(ctx.spark, RULES.trips)
    counts = planned.groupBy("rule_name").agg(F.sum("rows").alias("n"))
    return table.join(counts, "rule_name")


@query(
    "lookup_demanded_pairs",
    "o double, d double",
    "SELECT DISTINCT o, d FROM (SELECT oz AS o, dz AS d FROM lk UNION ALL SELECT dz, oz FROM lk "
    "UNION ALL SELECT origin, destination FROM lk)",
)
def demanded_pairs(ctx):
    return lookup.demanded_pairs([(trips(ctx), RULES.trips)])


@query(
    "lookup_annotated_trips",
    "trip_id bigint, skim_auto_time double, skim_auto_dist double, skim_walk double, "
    "skim_total double, skim_pnr double",
    "SELECT trip_id, MAX(v) FILTER (chain = 'DRIVEALONE.time') AS skim_auto_time, MAX(v) FILTER "
    "(chain = 'DRIVEALONE.dist') AS skim_auto_dist, MAX(v) FILTER (chain = 'WALK.walk') AS "
    "skim_walk, SUM(v) FILTER (chain IN ('WALK.access', 'WALK.egress')) AS skim_total, MAX(v) FILTER "
    "(chain LIKE 'PNR%') AS skim_pnr FROM lk LEFT JOIN chosen USING (trip_id) GROUP BY 1",
)
def annotated_trips(ctx):
    return annotated(ctx).table


@query(
    "lookup_annotated_tours",
    "tour_id bigint, skim_auto_dist_outbound double, skim_auto_dist_inbound double, "
    "skim_auto_time_outbound double, skim_pnr_inbound double",
    "SELECT tour_id, CASE WHEN tour_mode = 'DRIVEALONE' THEN a.v END AS skim_auto_dist_outbound, CASE "
    "WHEN tour_mode = 'DRIVEALONE' THEN b.v END AS skim_auto_dist_inbound, CASE WHEN tour_mode = "
    "'DRIVEALONE' THEN m.v END AS skim_auto_time_outbound, CASE WHEN tour_mode = 'PNR_TRANSIT' THEN "
    "a.v END AS skim_pnr_inbound FROM tours LEFT JOIN dist_cells a ON a.o = origin % 10 AND a.d = "
    "destination % 10 LEFT JOIN dist_cells b ON b.o = destination % 10 AND b.d = origin % 10 LEFT "
    "JOIN md_cells m ON m.o = origin % 10 AND m.d = destination % 10",
)
def annotated_tours(ctx):
    return lookup.annotate_tours(tours(ctx), RULES, sources(ctx)).table


@query(
    "lookup_summary",
    "rule_name string, matrix_name string, n_trips bigint, mean_value double, min_value double, "
    "max_value double, n_missing bigint",
    "SELECT rule AS rule_name, matrix AS matrix_name, COUNT(*) AS n_trips, AVG(v) FILTER (reason IS "
    "NULL) AS mean_value, MIN(v) FILTER (reason IS NULL) AS min_value, MAX(v) FILTER (reason IS "
    "NULL) AS max_value, COUNT(reason) AS n_missing FROM steps JOIN solved USING (trip_id, chain) "
    "WHERE (reason IS NULL OR reason IN ('missing_od', 'sentinel_value')) AND (solved IS NULL OR step "
    "<= solved) GROUP BY ALL",
)
def summary_of_lookups(ctx):
    return lookup.lookup_summary(annotated(ctx).demand_attempts)


@query(
    "lookup_missing_report",
    "rule_name string, trip_id bigint, matrix_name string, reason string",
    "SELECT rule AS rule_name, trip_id, matrix AS matrix_name, reason FROM failed QUALIFY "
    "ROW_NUMBER() OVER (PARTITION BY trip_id, chain ORDER BY step DESC) = 1",
)
def missing(ctx):
    found = annotated(ctx)
    return found.by_row(lookup.missing_report(found.demand_attempts), "trip_id")


@query(
    "lookup_skipped_rules",
    "rule_name string, reason string, count bigint",
    "SELECT rule AS rule_name, reason, COUNT(*) AS count FROM (SELECT * FROM failed QUALIFY "
    "ROW_NUMBER() OVER (PARTITION BY trip_id, chain ORDER BY step DESC) = 1) GROUP BY ALL",
)
def skipped(ctx):
    return lookup.skipped_rules(lookup.missing_report(annotated(ctx).demand_attempts))


@query(
    "lookup_fallback_report",
    "rule_name string, logical_id bigint, primary_matrix_name string, fallback_matrix_name string, "
    "fallback_step_index int, fallback_reason string, fallback_succeeded boolean",
    "SELECT s.rule AS rule_name, s.trip_id AS logical_id, p.matrix AS primary_matrix_name, s.matrix AS "
    "fallback_matrix_name, s.step AS fallback_step_index, p.reason AS fallback_reason, TRUE AS "
    "fallback_succeeded FROM steps s JOIN solved USING (trip_id, chain) JOIN steps p ON p.trip_id = "
    "s.trip_id AND p.chain = s.chain AND p.step = 0 WHERE s.step = solved AND solved > 0",
)
def fallbacks(ctx):
    found = annotated(ctx)
    report = lookup.fallback_report(found.demand_attempts, RULES.trips, "trips")
    return found.by_row(report, "logical_id")


@query(
    "lookup_hypothetical_trips",
    "observed_mode string, hypothetical_mode string, component string, n bigint, n_valid bigint, "
    "value double",
    "WITH t AS (SELECT lk.*, d.v AS dist, CASE WHEN trip_period = 'AM' AND a.v <> 9999 THEN a.v ELSE "
    "m.v END AS time, CASE WHEN maz.v <> 9999 THEN maz.v ELSE d.v END AS walk, CASE WHEN s.v IS NULL "
    "AND e.v IS NULL THEN NULL ELSE COALESCE(s.v, 0) + COALESCE(e.v, 0) END AS tot, CASE WHEN "
    "outbound THEN d.v ELSE r.v END AS pnr FROM lk JOIN dist_cells d ON d.o = oz AND d.d = dz JOIN "
    "dist_cells r ON r.o = dz AND r.d = oz JOIN am_cells a ON a.o = oz AND a.d = dz JOIN md_cells m "
    "ON m.o = oz AND m.d = dz LEFT JOIN maz ON maz.o = origin AND maz.d = destination LEFT JOIN stop "
    "s ON s.k = origin LEFT JOIN stop e ON e.k = destination), u AS (SELECT trip_mode, 'DRIVEALONE' "
    "AS h, 'skim_auto_time' AS c, time AS v FROM t UNION ALL SELECT trip_mode, 'DRIVEALONE', "
    "'skim_auto_dist', dist FROM t UNION ALL SELECT trip_mode, 'WALK', 'skim_walk', walk FROM t UNION "
    "ALL SELECT trip_mode, 'WALK', 'skim_total', tot FROM t UNION ALL SELECT trip_mode, "
    "'PNR_TRANSIT', 'skim_pnr', pnr FROM t) SELECT trip_mode AS observed_mode, h AS "
    "hypothetical_mode, c AS component, COUNT(*) AS n, COUNT(v) AS n_valid, SUM(v) AS value FROM u "
    "GROUP BY ALL",
)
def hypothetical_trips(ctx):
    found = lookup.trip_hypothetical_frequencies(trips(ctx), RULES, sources(ctx))
    return found.groupBy("observed_mode", "hypothetical_mode", "component").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)).alias("n_valid"),
        F.sum(F.col("value") * F.col("n")).alias("value"),
    )


@query(
    "lookup_hypothetical_tours",
    "observed_mode string, hypothetical_mode string, component string, direction string, n bigint, "
    "n_valid bigint, finalweight double, value double",
    "WITH t AS (SELECT tour_mode, finalweight, a.v AS ab, b.v AS ba, m.v AS mab, n.v AS mba, CASE WHEN "
    "w.v <> 9999 THEN w.v ELSE a.v END AS wab, CASE WHEN x.v <> 9999 THEN x.v ELSE b.v END AS wba, CASE "
    "WHEN s.v IS NULL AND e.v IS NULL THEN NULL ELSE COALESCE(s.v, 0) + COALESCE(e.v, 0) END AS tot FROM "
    "(SELECT *, origin % 10 AS oz, destination % 10 AS dz FROM tours) LEFT JOIN dist_cells a ON a.o = oz "
    "AND a.d = dz LEFT JOIN dist_cells b ON b.o = dz AND b.d = oz LEFT JOIN md_cells m ON m.o = oz AND "
    "m.d = dz LEFT JOIN md_cells n ON n.o = dz AND n.d = oz LEFT JOIN maz w ON w.o = oz AND w.d = dz "
    "LEFT JOIN maz x ON x.o = dz AND x.d = oz LEFT JOIN stop s ON s.k = oz LEFT JOIN stop e ON e.k = "
    "dz), u AS ("
    + " UNION ALL ".join(
        f"SELECT tour_mode, '{mode}' AS h, '{name}_{way}' AS c, '{way}' AS way, {value} AS v, finalweight "
        "AS w FROM t"
        for mode, name, way, value in (
            ("DRIVEALONE", "skim_auto_time", "outbound", "mab"),
            ("DRIVEALONE", "skim_auto_time", "inbound", "mba"),
            ("DRIVEALONE", "skim_auto_dist", "outbound", "ab"),
            ("DRIVEALONE", "skim_auto_dist", "inbound", "ba"),
            ("WALK", "skim_walk", "outbound", "wab"),
            ("WALK", "skim_walk", "inbound", "wba"),
            ("WALK", "skim_total", "outbound", "tot"),
            ("WALK", "skim_total", "inbound", "tot"),
            ("PNR_TRANSIT", "skim_pnr", "outbound", "ab"),
            ("PNR_TRANSIT", "skim_pnr", "inbound", "ab"),
        )
    )
    + ") SELECT tour_mode AS observed_mode, h AS hypothetical_mode, c AS component, way AS direction, "
    "COUNT(*) AS n, COUNT(v) AS n_valid, SUM(w) AS finalweight, SUM(v) AS value FROM u GROUP BY ALL",
)
def hypothetical_tours(ctx):
    """Both directions of every tour under every mode, from summed demand."""
    found = lookup.tour_hypothetical_frequencies(tours(ctx), RULES, sources(ctx))
    return found.groupBy("observed_mode", "hypothetical_mode", "component", "direction").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)).alias("n_valid"),
        F.sum("finalweight").alias("finalweight"),
        F.sum(F.col("value") * F.col("n")).alias("value"),
    )


@query(
    "lookup_mode_coverage",
    "mode string, records bigint",
    "SELECT trip_mode AS mode, COUNT(*) AS records FROM trips WHERE trip_mode NOT IN ('DRIVEALONE', "
    "'WALK', 'PNR_TRANSIT', 'BIKE') GROUP BY 1",
)
def mode_coverage(ctx):
    return lookup.uncovered_modes(
        ctx.run.trips, "trip_mode", RULES.trips, RULES.ignored_modes
    )


@query(
    "lookup_zone_bounds",
    "matrix_name string, lookups bigint, out_of_bounds bigint",
    "SELECT matrix AS matrix_name, COUNT(*) AS lookups, COUNT(*) FILTER (COALESCE(o < 1 OR o > 10 OR d "
    "< 1 OR d > 10, TRUE)) AS out_of_bounds FROM (SELECT matrix, CASE WHEN trip_id % 11 = 0 THEN 11 "
    "WHEN trip_id % 13 <> 0 THEN CASE WHEN chain LIKE 'PNR_TRANSIT.False%' THEN dz ELSE oz END END AS "
    "o, CASE WHEN chain LIKE 'PNR_TRANSIT.False%' THEN oz ELSE dz END AS d FROM steps JOIN lk USING "
    "(trip_id) WHERE matrix IN ('DIST', 'TIME__AM', 'TIME__MD')) GROUP BY 1",
)
def zone_bounds(ctx):
    """Zones are 0 to 9 and the size is 10: zone 0, some null and some size + 1 are outside."""
    steps = lookup.planned_steps(trips(ctx), RULES.trips, "trip_mode", "trip_id").withColumn(
        "origin",
        F.expr("CASE WHEN row_id % 11 = 0 THEN 11 WHEN row_id % 13 <> 0 THEN origin END"),
    )
    return lookup.zones_out_of_bounds(steps, sources(ctx))
