"""Preparation operators on the raw star-schema run."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oracle.raw_sql import RAW_CTES
from tripweave.functions.expressions import clock_to_period, summary_purpose
from tripweave.operators import columns as col_ops
from tripweave.operators import escort_events, persons, tours, trips, weights, zones
from tripweave.operators.travel_weights import (
    attach_person_travel_weight,
    with_household_tour_weight,
)
from tripweave.plans.prepare import split_vehicles
from tripweave.sources import star, star_raw
from tripweave.sources.periods import period_table
from workload.context import Context, Registry

registry = Registry(RAW_CTES)
query = registry.add
queries, oracle_sql = registry.queries, registry.oracle_sql

TAZ = f"CASE WHEN {{0}} BETWEEN 0 AND 24 THEN {{0}} % {star_raw.COARSE_ZONES} END"


def raw_tours(ctx: Context) -> DataFrame:
    return col_ops.canonicalize("tours", ctx.raw.tours, ctx.raw_config)


def raw_trips(ctx: Context) -> DataFrame:
    return col_ops.canonicalize("trips", ctx.raw.trips, ctx.raw_config)


def raw_per(ctx: Context) -> DataFrame:
    return col_ops.canonicalize("per", ctx.raw.per, ctx.raw_config)


# --- columns --------------------------------------------------------------------------------


@query(
    "prepare_canonical_tours",
    "tour_id bigint, tour_purpose string, start_hour int, end_hour int, origin bigint",
    "SELECT tour_id, primary_purpose AS tour_purpose, start AS start_hour, \"end\" AS end_hour, "
    "origin FROM raw_tours",
)
def canonical_tours(ctx):
    return raw_tours(ctx)


@query(
    "prepare_canonical_trips",
    "trip_id bigint, trip_purpose string, depart_hour int, trip_num int",
    "SELECT trip_id, purpose AS trip_purpose, depart AS depart_hour, trip_num FROM raw_trips",
)
def canonical_trips(ctx):
    return raw_trips(ctx)


MODE_GROUPS = {"WALK": "active", "BIKE": "active", "DRIVEALONE": "auto", "SHARED2": "auto"}
MAPPINGS = [
    col_ops.CategoryMapping("mode_group", "trip_mode", MODE_GROUPS),
    col_ops.CategoryMapping("mode_only", "trip_mode", MODE_GROUPS, preserve_unmapped=False),
    col_ops.CategoryMapping(
        "is_active", "trip_mode", {"WALK": True, "BIKE": True, "SHARED2": False}, boolean=True
    ),
]


@query(
    "prepare_category_recode",
    "mode_group string, mode_only string, is_active boolean, n bigint",
    "SELECT CASE WHEN trip_mode IN ('WALK', 'BIKE') THEN 'active' WHEN trip_mode IN ('DRIVEALONE', "
    "'SHARED2') THEN 'auto' ELSE trip_mode END AS mode_group, CASE WHEN trip_mode IN ('WALK', "
    "'BIKE') THEN 'active' WHEN trip_mode IN ('DRIVEALONE', 'SHARED2') THEN 'auto' END AS mode_only, "
    "CASE WHEN trip_mode IN ('WALK', 'BIKE') THEN TRUE WHEN trip_mode = 'SHARED2' THEN FALSE END AS "
    "is_active, COUNT(*) AS n FROM raw_trips GROUP BY ALL",
)
def category_recode(ctx):
    df = ctx.raw.trips
    for spec in MAPPINGS:
        df = col_ops.map_categories(df, spec)
    return df.groupBy("mode_group", "mode_only", "is_active").agg(F.count(F.lit(1)).alias("n"))


@query(
    "prepare_category_report",
    "target string, total bigint, unresolved bigint, unmatched string",
    "SELECT target, COUNT(*) AS total, COUNT(*) FILTER (NOT known) AS unresolved, STRING_AGG("
    "DISTINCT trip_mode, ',' ORDER BY trip_mode) FILTER (NOT known) AS unmatched FROM (SELECT "
    "trip_mode, 'mode_group' AS target, trip_mode IN ('WALK', 'BIKE', 'DRIVEALONE', 'SHARED2') AS "
    "known FROM raw_trips UNION ALL SELECT trip_mode, 'is_active', trip_mode IN ('WALK', 'BIKE', "
    "'SHARED2') FROM raw_trips) GROUP BY 1",
)
def category_report(ctx):
    report = col_ops.category_mapping_report(ctx.raw.trips, [MAPPINGS[0], MAPPINGS[2]])
    return report.withColumn("unmatched", F.array_join("unmatched_values", ","))


@query(
    "prepare_clock_periods",
    "period int, n bigint",
    "SELECT CASE WHEN tour_start_hour <= 23 THEN CAST(FLOOR(((tour_start_hour * 60 + "
    "tour_start_minute - 180 + 1440) % 1440) / 30) AS INTEGER) + 1 END AS period, COUNT(*) AS n FROM "
    "raw_tours GROUP BY 1",
)
def clock_periods(ctx):
    period = clock_to_period("tour_start_hour", "tour_start_minute")
    return ctx.raw.tours.groupBy(period.alias("period")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "prepare_external_worker_flag",
    "is_external_worker boolean, n bigint",
    "SELECT COALESCE(is_worker = 'Yes' AND work_from_home <> '1' AND "
    "external_worker_identification = 'TRUE', FALSE) AS is_external_worker, COUNT(*) AS n FROM "
    "raw_per GROUP BY 1",
)
def external_worker_flag(ctx):
    flagged = persons.add_external_worker_flag(ctx.raw.per)
    return flagged.groupBy("is_external_worker").agg(F.count(F.lit(1)).alias("n"))


@query(
    "prepare_escort_fields",
    "tour_id bigint, school_esc_outbound string, school_esc_inbound string, num_escortees bigint",
    "SELECT tour_id, CASE o WHEN '1' THEN 'pure_escort' WHEN 'Ride Share' THEN 'ride_share' WHEN "
    "'none' THEN 'not_escorted' ELSE o END AS school_esc_outbound, CASE i WHEN '1' THEN 'pure_escort' "
    "WHEN 'Ride Share' THEN 'ride_share' WHEN 'none' THEN 'not_escorted' ELSE i END AS "
    "school_esc_inbound, COALESCE(num_escorted, GREATEST(CASE tour_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 "
    "ELSE 0 END, CASE WHEN tour_id % 3 = 0 THEN 1 ELSE 0 END)) AS num_escortees FROM (SELECT *, "
    "COALESCE(NULLIF(TRIM(out_escort_type), ''), out_escorting_type) AS o, "
    "NULLIF(TRIM(inb_escort_type), '') AS i FROM raw_tours)",
)
def escort_fields(ctx):
    return tours.normalize_escort_fields(ctx.raw.tours, ctx.raw_config)


@query(
    "prepare_vehicle_type_split",
    "vehicle_id bigint, body_type string, vehicle_age bigint, fuel_type string",
    "SELECT vehicle_id, body_type, vehicle_age, fuel_type FROM vehicles",
)
def vehicle_type_split(ctx):
    return split_vehicles(ctx.raw.vehicles)


@query(
    "prepare_day_person_type",
    "day_id bigint, person_id bigint, person_type string",
    "SELECT day_id, d.person_id, CAST(ptype AS VARCHAR) AS person_type FROM raw_day d LEFT JOIN "
    "raw_per USING (person_id)",
)
def day_person_type(ctx):
    run = ctx.raw.with_tables(per=raw_per(ctx))
    return persons.add_day_person_type(run)


@query(
    "prepare_vot_bins",
    "vot_bin string, n bigint",
    "SELECT CASE vot_bin_raw WHEN 'low' THEN 'L' WHEN 'high' THEN 'H' ELSE 'M' END AS vot_bin, "
    "COUNT(*) AS n FROM raw_tours GROUP BY 1",
)
def vot_bins(ctx):
    df = tours.add_vot_bin(
        ctx.raw.tours, "vot_bin_raw", "vot_bin", {"low": "L", "high": "H"}, "M"
    )
    return df.groupBy("vot_bin").agg(F.count(F.lit(1)).alias("n"))


@query(
    "prepare_summary_purpose",
    "grouped string, separate string, plain string, n bigint",
    "SELECT CASE WHEN tour_category = 'joint' THEN 'joint' WHEN tour_category = 'atwork' THEN "
    "'atwork' WHEN tour_purpose = 'university' THEN 'school' ELSE tour_purpose END AS grouped, "
    "summary_tour_purpose AS separate, CASE WHEN tour_category = 'joint' THEN 'joint_' || "
    "tour_purpose ELSE tour_purpose END AS plain, COUNT(*) AS n FROM tours GROUP BY ALL",
)
def purposes(ctx):
    df = ctx.run.tours
    base = replace(star.CONFIG, group_joint_tour_purposes=True)
    plain = replace(
        star.CONFIG, group_school_tour_purposes=False, group_atwork_tour_purposes=False
    )
    return df.groupBy(
        summary_purpose(df.columns, base).alias("grouped"),
        F.col("summary_tour_purpose").alias("separate"),
        summary_purpose(df.columns, plain).alias("plain"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "prepare_households",
    "household_id bigint, HHSIZE int, HHVEH int, WORKERS int, ADULTS int, home_taz bigint, "
    "HGEO string, home_geo__county string, home_geo__district string",
    "SELECT household_id, LEAST(hhsize, 5) AS HHSIZE, LEAST(auto_ownership, 4) AS HHVEH, num_workers "
    "AS WORKERS, num_adults AS ADULTS, home_taz, CASE g.county WHEN 'ASIA' THEN 'Asia' WHEN 'EUROPE' "
    "THEN 'Europe' ELSE g.county END AS HGEO, c.county AS home_geo__county, d.district AS "
    f"home_geo__district FROM (SELECT *, {TAZ.format('home_zone_id')} AS home_taz FROM raw_hh) LEFT "
    "JOIN (SELECT TAZ, MIN(county) AS county FROM (SELECT TAZ, CASE county WHEN 'ASIA' THEN 'Asia' "
    "WHEN 'EUROPE' THEN 'Europe' ELSE county END AS county FROM raw_zones) GROUP BY 1) g ON g.TAZ = "
    "home_taz LEFT JOIN zones c ON c.zone = home_zone_id LEFT JOIN (SELECT * FROM zones WHERE zone < "
    "10) d ON d.zone = home_taz",
)
def households(ctx):
    return persons.enrich_households(ctx.raw, ctx.raw_config).hh


@query(
    "prepare_mandatory_frequency_code",
    "imf_choice int, n bigint",
    "SELECT CASE mandatory_tour_frequency WHEN 'work1' THEN 1 WHEN 'work2' THEN 2 WHEN 'school1' THEN "
    "3 WHEN 'school2' THEN 4 WHEN 'work_and_school' THEN 5 ELSE 0 END AS imf_choice, COUNT(*) AS n "
    "FROM raw_per GROUP BY 1",
)
def frequency_code(ctx):
    return ctx.raw.per.groupBy(persons.mandatory_frequency_code().alias("imf_choice")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "prepare_auto_sufficiency",
    "household_id bigint, LICENSEDDRIVERS int, AUTOSUFF int",
    "SELECT household_id, COALESCE(n, 0) AS LICENSEDDRIVERS, CASE WHEN v > 0 AND v < COALESCE(n, 0) "
    "THEN 1 WHEN v > 0 THEN 2 ELSE 0 END AS AUTOSUFF FROM (SELECT *, LEAST(auto_ownership, 4) AS v "
    "FROM raw_hh) LEFT JOIN (SELECT household_id, COUNT(*) FILTER (has_license = 'licensed') AS n "
    "FROM raw_per GROUP BY 1) USING (household_id)",
)
def sufficiency(ctx):
    run = persons.enrich_households(ctx.raw.with_tables(per=raw_per(ctx)), star_raw.CONFIG)
    return persons.auto_sufficiency(persons.add_household_counts(run), star_raw.CONFIG)


@query(
    "prepare_student_types",
    "person_type int, student_type string, n bigint",
    "SELECT ptype AS person_type, CASE WHEN ptype = 3 THEN 'University' WHEN ptype = 6 THEN 'High "
    "school' WHEN ptype >= 7 THEN 'Grade school' END AS student_type, COUNT(*) AS n FROM raw_per "
    "GROUP BY ALL",
)
def student_types(ctx):
    typed = persons.add_student_type(raw_per(ctx), star_raw.CONFIG.student_types)
    return typed.groupBy("person_type", "student_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "prepare_enrollment_overlay",
    "zone_id bigint, student_type string, enrollment_count double, employment_count double",
    "SELECT zone_id, NULL AS student_type, NULL AS enrollment_count, EMPLOY_TOT AS employment_count "
    "FROM raw_zones UNION ALL SELECT zone_id, s, e, NULL FROM (SELECT zone_id, 'University' AS s, "
    "college AS e FROM raw_zones UNION ALL SELECT zone_id, 'High school', high FROM raw_zones UNION "
    "ALL SELECT zone_id, 'Grade school', grade + nursery FROM raw_zones) WHERE e IS NOT NULL",
)
def overlay(ctx):
    run = col_ops.canonicalize_run(ctx.raw, star_raw.CONFIG)
    land_use = persons.add_student_enrollment(run, star_raw.CONFIG).land_use
    return land_use.withColumn("zone_id", F.coalesce("zone_id", "MAZ"))


@query(
    "prepare_column_types",
    "tour_id bigint, start_hour int, AUTOSUFF int, SKIMDIST double, NUMBER_HH int, tour_mode string",
    "SELECT tour_id, start_hour, AUTOSUFF, SKIMDIST, NUMBER_HH, tour_mode FROM tours",
)
def column_types(ctx):
    return col_ops.cast_prepared(ctx.run.with_tables()).tours


# --- zones and joins ----------------------------------------------------------------------------


@query(
    "prepare_person_zones",
    "person_id bigint, home_county string, home_taz bigint, work_taz bigint, school_taz bigint, "
    "WGEO string, work_geo__county string, school_geo__district string, num_joint_tours int",
    "SELECT person_id, COALESCE(p.home_county, h.home_county) AS home_county, "
    f"{TAZ.format('h.home_zone_id')} AS home_taz, {TAZ.format('workplace_zone_id')} AS work_taz, "
    f"{TAZ.format('school_zone_id')} AS school_taz, g.county AS WGEO, c.county AS work_geo__county, "
    "d.district AS school_geo__district, COALESCE(j.n, 0) AS num_joint_tours FROM raw_per p JOIN "
    "raw_hh h USING (household_id) LEFT JOIN (SELECT TAZ, MIN(county) AS county FROM (SELECT TAZ, "
    "CASE county WHEN 'ASIA' THEN 'Asia' WHEN 'EUROPE' THEN 'Europe' ELSE county END AS county FROM "
    "raw_zones) GROUP BY 1) g ON g.TAZ = workplace_zone_id % 10 LEFT JOIN zones c ON c.zone = "
    "workplace_zone_id LEFT JOIN zones d ON d.zone = school_zone_id % 10 LEFT JOIN (SELECT "
    "person_id, COUNT(DISTINCT tour_id) AS n FROM participants GROUP BY 1) j USING (person_id)",
)
def person_zones(ctx):
    return persons.enrich_persons(ctx.raw.with_tables(per=raw_per(ctx)), ctx.raw_config).per


@query(
    "prepare_unresolved_zones",
    "metric_id string, total bigint, unresolved bigint, unresolved_share double",
    "SELECT 'households.home_taz' AS metric_id, COUNT(*) AS total, COUNT(*) FILTER (home_zone_id = "
    "99) AS unresolved, COUNT(*) FILTER (home_zone_id = 99) / COUNT(*) AS unresolved_share FROM "
    "raw_hh",
)
def unresolved_zones(ctx):
    hh = zones.to_taz(
        ctx.raw.hh, "home_zone_id", "home_taz", ctx.raw.land_use, star_raw.CONFIG
    )
    return zones.unresolved_report(
        hh, {"households.home_taz": (("home_zone_id",), "home_taz")}
    )


@query(
    "prepare_matrix_long_form",
    "matrix string, o_idx int, d_idx int, value double",
    "SELECT 'DIST' AS matrix, o AS o_idx, d AS d_idx, v AS value FROM dist_cells UNION ALL SELECT "
    "'TIME__AM', o, d, v FROM am_cells UNION ALL SELECT 'TIME__MD', o, d, v FROM md_cells",
)
def matrix_long_form(ctx):
    return zones.explode_matrix(star_raw.matrix_rows(ctx.tables))


@query(
    "prepare_skim_distance_zero_based",
    "tour_id bigint, value double",
    "SELECT tour_id, v AS value FROM raw_tours LEFT JOIN dist_cells ON o = origin % 10 AND d = "
    "destination % 10",
)
def skim_zero_based(ctx):
    """All zones fit the matrix and a zone 0 occurs, so zone numbers are indices."""
    df = ctx.raw.tours.selectExpr("tour_id", "origin % 10 AS o", "destination % 10 AS d")
    return zones.add_skim_value(df, star_raw.skim(ctx.tables), "o", "d", "value")


@query(
    "prepare_skim_distance_one_based",
    "tour_id bigint, value double",
    "SELECT tour_id, v AS value FROM raw_tours LEFT JOIN dist_cells ON o = origin % 10 - 1 AND d = "
    "destination - 1",
)
def skim_one_based(ctx):
    """Destinations go beyond the matrix, so zone numbers count from 1."""
    df = ctx.raw.tours.selectExpr("tour_id", "origin % 10 AS o", "destination AS d")
    return zones.add_skim_value(df, star_raw.skim(ctx.tables), "o", "d", "value")


@query(
    "prepare_skim_distance_zone_map",
    "tour_id bigint, value double",
    "SELECT tour_id, v AS value FROM raw_tours LEFT JOIN dist_cells ON 9 - o = origin AND 9 - d = "
    "destination",
)
def skim_zone_map(ctx):
    skim = star_raw.skim(ctx.tables, mapped=True)
    return zones.add_skim_value(ctx.raw.tours, skim, "origin", "destination", "value")


@query(
    "prepare_geography_lookup",
    "zone bigint, label string",
    "SELECT DISTINCT CAST(c_nationkey AS BIGINT) AS zone, 'D' || (c_nationkey % 3) AS label FROM "
    "customer",
)
def geography_lookup(ctx):
    rows = ctx.tables["customer"].selectExpr(
        "c_nationkey AS z", "' D' || CAST(c_nationkey % 3 AS STRING) AS name"
    )
    return zones.checked_geography_lookup(rows, "z", "name")


@query(
    "prepare_geography_conflicts",
    "zone bigint, problem string",
    "SELECT CAST(c_nationkey AS BIGINT) AS zone, CASE WHEN c_nationkey % 5 = 0 THEN 'blank label' "
    "ELSE 'several labels' END AS problem FROM customer WHERE c_nationkey % 5 = 0 OR c_nationkey % 4 "
    "= 1 GROUP BY ALL HAVING COUNT(DISTINCT c_custkey % 2) > 1 OR c_nationkey % 5 = 0",
)
def geography_conflicts(ctx):
    rows = ctx.tables["customer"].selectExpr(
        "c_nationkey AS z",
        "CASE WHEN c_nationkey % 5 = 0 THEN ' ' WHEN c_nationkey % 4 = 1 THEN CAST(c_custkey % 2 AS "
        "STRING) ELSE 'one' END AS name",
    )
    return zones.geography_conflicts(zones.geography_lookup(rows, "z", "name"))


# --- tours ---------------------------------------------------------------------------------------


@query(
    "prepare_tour_origins",
    "tour_id bigint, origin bigint",
    "SELECT t.tour_id, CASE WHEN t.tour_category = ' AtWork ' THEN COALESCE(p.destination, t.origin) "
    "ELSE h.home_zone_id END AS origin FROM raw_tours t JOIN raw_hh h USING (household_id) LEFT JOIN "
    "raw_tours p ON p.tour_id = CAST(t.parent_tour_id AS BIGINT)",
)
def tour_origins(ctx):
    return tours.canonical_origins(ctx.raw.tours, ctx.raw.hh)


@query(
    "prepare_joint_composition",
    "tour_id bigint, composition string",
    "SELECT tour_id, CASE WHEN lo THEN 'adults' WHEN NOT hi THEN 'children' WHEN lo IS NOT NULL THEN "
    "'mixed' END AS composition FROM raw_tours LEFT JOIN (SELECT tour_id, BOOL_AND(ptype <= 5) AS lo, "
    "BOOL_OR(ptype <= 5) AS hi FROM participants JOIN raw_per USING (person_id) GROUP BY 1) USING "
    "(tour_id)",
)
def composition(ctx):
    return tours.joint_composition(ctx.raw.tours, ctx.raw.joint_participants, raw_per(ctx))


@query(
    "prepare_tours",
    "tour_id bigint, income_segment bigint, HHVEH int, AUTOSUFF int, num_ob_stops int, "
    "num_ib_stops int, num_tot_stops int, OTAZ bigint, DTAZ bigint, SKIMDIST double, "
    "NUMBER_HH bigint, tourdur int, first_inbound_trip_depart int, destination_geo__county string",
    "SELECT t.tour_id, h.income AS income_segment, LEAST(h.auto_ownership, 4) AS HHVEH, CASE WHEN "
    "h.auto_ownership = 0 THEN 0 WHEN LEAST(h.auto_ownership, 4) < COALESCE(l.n, 0) THEN 1 ELSE 2 END "
    "AS AUTOSUFF, t.tour_id % 5 AS num_ob_stops, (t.tour_id * 3) % 4 AS num_ib_stops, t.tour_id % 5 + "
    "(t.tour_id * 3) % 4 AS num_tot_stops, OTAZ, DTAZ, v AS SKIMDIST, COALESCE(j.n, "
    "t.number_of_participants, 1) AS NUMBER_HH, LEAST(GREATEST(t.\"end\" - t.start + 1, 1), 48) AS "
    "tourdur, f.depart AS first_inbound_trip_depart, z.county AS destination_geo__county FROM (SELECT "
    f"*, {TAZ.format('o')} AS OTAZ, destination % 10 AS DTAZ FROM (SELECT t.*, CASE WHEN "
    "t.tour_category = ' AtWork ' THEN COALESCE(p.destination, t.origin) ELSE hh.home_zone_id END AS "
    "o FROM raw_tours t JOIN raw_hh hh USING (household_id) LEFT JOIN raw_tours p ON p.tour_id = "
    "CAST(t.parent_tour_id AS BIGINT))) t JOIN raw_hh h USING (household_id) LEFT JOIN (SELECT "
    "household_id, COUNT(*) FILTER (has_license = 'licensed') AS n FROM raw_per GROUP BY 1) l USING "
    "(household_id) LEFT JOIN dist_cells c ON c.o = OTAZ AND c.d = DTAZ LEFT JOIN (SELECT tour_id, "
    "COUNT(*) AS n FROM participants GROUP BY 1) j ON j.tour_id = t.tour_id LEFT JOIN (SELECT "
    "tour_id, depart FROM raw_trips WHERE NOT outbound QUALIFY ROW_NUMBER() OVER (PARTITION BY "
    "tour_id ORDER BY trip_num, trip_id) = 1) f ON f.tour_id = t.tour_id LEFT JOIN zones z ON z.zone "
    "= t.destination",
)
def tour_enrichment(ctx):
    run = col_ops.canonicalize_run(ctx.raw, ctx.raw_config)
    run = persons.enrich_households(run, ctx.raw_config)
    run = run.with_tables(hh=persons.add_household_counts(run))
    skim = star_raw.skim(ctx.tables).for_zones(run.land_use, "TAZ")
    return tours.enrich_tours(run, ctx.raw_config, skim).tours


@query(
    "prepare_time_periods",
    "tour_id bigint, start_period string, end_period string, first_inbound_trip_period string",
    "SELECT t.tour_id, s.label AS start_period, e.label AS end_period, f.label AS "
    "first_inbound_trip_period FROM raw_tours t LEFT JOIN periods s ON s.period = start LEFT JOIN "
    "periods e ON e.period = \"end\" LEFT JOIN (SELECT tour_id, label FROM raw_trips JOIN periods ON "
    "period = depart WHERE NOT outbound QUALIFY ROW_NUMBER() OVER (PARTITION BY tour_id ORDER BY "
    "trip_num, trip_id) = 1) f ON f.tour_id = t.tour_id",
)
def time_periods(ctx):
    config = star_raw.CONFIG
    table = period_table(ctx.spark, config.period_breakpoints, config.period_labels)
    run = ctx.raw.with_tables(tours=raw_tours(ctx), trips=raw_trips(ctx))
    return tours.add_time_periods(run, table).tours


# --- trips ---------------------------------------------------------------------------------------

BOUNDED = (
    "(SELECT r.*, t.origin AS tour_origin, t.destination AS tour_destination, MIN(r.trip_num) OVER w "
    "AS first_num, MAX(r.trip_num) OVER w AS last_num FROM raw_trips r JOIN raw_tours t USING "
    "(tour_id) WINDOW w AS (PARTITION BY r.tour_id, r.outbound))"
)
REPAIRED = (
    "(SELECT *, CASE WHEN outbound AND trip_num = first_num THEN tour_origin ELSE origin END AS o2, "
    "CASE WHEN NOT outbound AND trip_num = last_num THEN tour_origin ELSE destination END AS d2 FROM "
    f"{BOUNDED})"
)


def trip_run(ctx: Context):
    """Raw trips and tours with canonical columns and coarse zones of the tours."""
    run = ctx.raw.with_tables(tours=raw_tours(ctx), trips=raw_trips(ctx))
    return run.with_tables(tours=tours.add_zone_columns(run.tours, run, ctx.raw_config))


@query(
    "prepare_trips",
    "trip_id bigint, origin bigint, destination bigint, max_trip_num int, stops int, inbound int, "
    "tour_purpose string, num_participants bigint, OTAZ bigint, DTAZ bigint, od_dist double, "
    "income_segment bigint",
    "SELECT r.trip_id, o2 AS origin, d2 AS destination, last_num AS max_trip_num, CASE WHEN trip_num < "
    "last_num THEN 1 ELSE 0 END AS stops, CASE WHEN outbound THEN 0 ELSE 1 END AS inbound, "
    "t.primary_purpose AS tour_purpose, CASE WHEN tour_id % 7 <> 0 THEN tour_id % 5 END AS "
    "num_participants, o2 % 10 AS OTAZ, "
    f"d2 % 10 AS DTAZ, v AS od_dist, h.income AS income_segment FROM {REPAIRED} r JOIN (SELECT "
    "tour_id, primary_purpose FROM raw_tours) t USING (tour_id) JOIN raw_hh h USING (household_id) "
    "LEFT JOIN dist_cells ON o = o2 % 10 AND d = d2 % 10",
)
def trip_enrichment(ctx):
    run = trip_run(ctx)
    sized = run.tours.withColumn("NUMBER_HH", F.expr("CASE WHEN tour_id % 7 <> 0 THEN tour_id % 5 END"))
    skim = star_raw.skim(ctx.tables).for_zones(ctx.raw.land_use, "TAZ")
    return trips.enrich_trips(run.with_tables(tours=sized), ctx.raw_config, skim).trips


@query(
    "prepare_out_of_direction",
    "trip_id bigint, out_dir_dist double",
    "SELECT trip_id, CASE WHEN f.v + g.v - c.v IS NOT NULL THEN GREATEST(f.v + g.v - c.v, 0) END AS "
    "out_dir_dist FROM (SELECT *, CASE WHEN outbound THEN tour_destination % 10 ELSE tour_origin % 10 "
    f"END AS final FROM {REPAIRED}) LEFT JOIN dist_cells c ON c.o = o2 % 10 AND c.d = d2 % 10 LEFT "
    "JOIN dist_cells f ON f.o = o2 % 10 AND f.d = final LEFT JOIN dist_cells g ON g.o = d2 % 10 AND "
    "g.d = final",
)
def out_of_direction(ctx):
    run = trip_run(ctx)
    skim = star_raw.skim(ctx.tables).for_zones(ctx.raw.land_use, "TAZ")
    return trips.enrich_trips(run, ctx.raw_config, skim).trips


def event_trips(ctx: Context):
    """Trips with the columns the escort events need."""
    run = ctx.run
    bounds = run.trips.groupBy("tour_id", "outbound").agg(
        F.max("trip_num").alias("max_trip_num")
    )
    kept = run.trips.drop(
        "escort_event_role", "escort_stops_before_event", "escort_stops_after_event"
    )
    return kept.join(bounds, ["tour_id", "outbound"])


@query(
    "prepare_escort_events_by_participants",
    "trip_id bigint, escort_event_role string, escort_event_trip_num int, "
    "escort_stops_before_event int, escort_stops_after_event int, escort_event_match_status string",
    "WITH t AS (SELECT r.*, p.person_type AS pt, MAX(trip_num) OVER (PARTITION BY tour_id, outbound) "
    "AS mx, CASE WHEN r.trip_id % 3 <> 0 THEN r.household_id || '_' || r.trip_purpose END AS who FROM "
    "trips r LEFT JOIN (SELECT person_id, person_type FROM per) p USING (person_id)), "
    "a AS (SELECT * FROM t WHERE who IS NOT NULL AND pt NOT IN (6, 7, 8) AND summary_tour_purpose = "
    "'escort'), n AS (SELECT who, outbound, COUNT(*) AS na FROM a GROUP BY ALL), "
    "k AS (SELECT who, outbound, COUNT(*) AS nk FROM t WHERE who IS NOT NULL AND pt IN (6, 7, 8) AND "
    "((outbound AND trip_purpose = 'school') OR (NOT outbound AND trip_purpose = 'home')) GROUP BY "
    "ALL), s AS (SELECT a.*, CASE WHEN na = 1 AND nk = 1 THEN 'matched' WHEN na > 1 OR nk > 1 THEN "
    "'ambiguous' ELSE 'unmatched' END AS status FROM a JOIN n USING (who, outbound) LEFT JOIN k USING "
    "(who, outbound)) SELECT t.trip_id, CASE WHEN status = 'matched' THEN CASE WHEN t.outbound THEN "
    "'dropoff' ELSE 'pickup' END END AS escort_event_role, CASE WHEN status = 'matched' THEN "
    "t.trip_num END AS escort_event_trip_num, CASE WHEN status = 'matched' THEN t.trip_num - 1 END AS "
    "escort_stops_before_event, CASE WHEN status = 'matched' THEN t.mx - t.trip_num END AS "
    "escort_stops_after_event, status AS escort_event_match_status FROM t LEFT JOIN s USING (trip_id)",
)
def escort_by_participants(ctx):
    named = event_trips(ctx).withColumn(
        "escort_participants",
        F.expr("CASE WHEN trip_id % 3 <> 0 THEN CAST(household_id AS STRING) || '_' || trip_purpose "
               "END"),
    )
    return escort_events.events_by_participants(ctx.run.with_tables(trips=named))


def _linked(leg, outbound, label, expected, place, link, purpose, free="TRUE"):
    return (
        f"{leg} AS (SELECT tour_id, trip_id FROM (SELECT tour_id, p, COUNT(*) AS n, MIN(trip_id) AS "
        f"trip_id FROM (SELECT r.tour_id, r.trip_id, CASE WHEN m AND r.trip_purpose = '{expected}' THEN "
        f"0 WHEN m THEN 1 WHEN r.trip_purpose = '{expected}' THEN 2 WHEN c = 1 THEN 3 END AS p FROM "
        f"(SELECT t.*, COUNT(*) OVER (PARTITION BY tour_id) AS c, EXISTS (SELECT 1 FROM trips k WHERE "
        f"k.tour_id = {link} AND k.outbound = {outbound} AND k.trip_purpose = '{purpose}' AND "
        f"k.{place} = t.{place}) AS m FROM trips t WHERE outbound = {outbound} AND tour_id IN (SELECT "
        f"tour_id FROM tours WHERE summary_tour_purpose = 'escort' AND {label} IS NOT NULL AND "
        f"TRIM({label}) NOT IN ('', 'not_escorted'))) r) WHERE p IS NOT NULL AND {free} GROUP BY tour_id, p QUALIFY "
        "ROW_NUMBER() OVER (PARTITION BY tour_id ORDER BY p) = 1) WHERE n = 1)"
    )


def _links_sql(free="TRUE"):
    return (
        "WITH "
        + _linked("a", "TRUE", "school_esc_outbound", "escort", "destination", "t.tour_id + 1",
                  "school", free)
        + ", "
        + _linked("b", "FALSE", "school_esc_inbound", "home", "origin", "t.tour_id + 2", "home", free)
        + " SELECT t.trip_id, role AS escort_event_role, CASE WHEN role IS NOT NULL THEN trip_num END "
        "AS escort_event_trip_num, CASE WHEN role IS NOT NULL THEN trip_num - 1 END AS "
        "escort_stops_before_event, CASE WHEN role IS NOT NULL THEN mx - trip_num END AS "
        "escort_stops_after_event, CASE WHEN role IS NOT NULL THEN 'matched' END AS "
        "escort_event_match_status FROM (SELECT *, MAX(trip_num) OVER (PARTITION BY tour_id, outbound) "
        "AS mx FROM trips) t LEFT JOIN (SELECT trip_id, 'dropoff' AS role FROM a UNION ALL SELECT "
        "trip_id, 'pickup' FROM b) USING (trip_id)"
    )


EVENT_SCHEMA = (
    "trip_id bigint, escort_event_role string, escort_event_trip_num int, "
    "escort_stops_before_event int, escort_stops_after_event int, escort_event_match_status string"
)
GIVEN = "CASE WHEN trip_id % 7 = 0 THEN 'pickup' END"


def linked_run(ctx: Context):
    linked = ctx.run.tours.withColumns(
        {
            "out_escorted_tour_ids": F.expr("CAST(tour_id + 1 AS STRING) || '_x'"),
            "inb_escorted_tour_ids": F.expr("CAST(tour_id + 2 AS STRING)"),
        }
    )
    return ctx.run.with_tables(tours=linked, trips=event_trips(ctx))


@query("prepare_escort_events_by_tour_links", EVENT_SCHEMA, _links_sql())
def escort_by_links(ctx):
    return escort_events.events_by_tour_links(linked_run(ctx))


@query("prepare_escort_events_given_and_linked", EVENT_SCHEMA, _links_sql("trip_id % 7 <> 0"))
def escort_given_and_linked(ctx):
    """Trips that came with an event are not picked; what links pick replaces all given events."""
    run = linked_run(ctx)
    given = run.trips.withColumn("escort_event_role", F.expr(GIVEN))
    return escort_events.events_by_tour_links(run.with_tables(trips=given))


@query(
    "prepare_escort_events_given_only",
    EVENT_SCHEMA,
    f"SELECT trip_id, {GIVEN} AS escort_event_role, trip_num AS escort_event_trip_num, NULL AS "
    "escort_stops_before_event, NULL AS escort_stops_after_event, NULL AS escort_event_match_status "
    "FROM trips",
)
def escort_given_only(ctx):
    """No tour escorts and nobody is named: given events stay."""
    run = linked_run(ctx)
    given = run.trips.withColumns(
        {
            "escort_event_role": F.expr(GIVEN),
            "escort_event_trip_num": F.col("trip_num"),
            "escort_participants": F.lit(None).cast("string"),
        }
    )
    tours_ = run.tours.withColumn("summary_tour_purpose", F.lit("work"))
    run = run.with_tables(trips=given, tours=tours_)
    run = run.with_tables(trips=escort_events.events_by_participants(run))
    return escort_events.events_by_tour_links(run)


@query(
    "prepare_walk_distance",
    "trip_id bigint, prepared_non_motorized_distance double",
    "SELECT trip_id, w AS prepared_non_motorized_distance FROM trips LEFT JOIN (SELECT l_suppkey % 25 "
    f"AS o, l_partkey % 25 AS d, ARG_MAX(l_quantity, {star.LINE_ORDER}) AS w FROM lineitem GROUP BY "
    "ALL) ON o = origin AND d = destination",
)
def walk_distance(ctx):
    """The lookup has several rows per zone pair; the last by source order counts."""
    lookup = ctx.tables["lineitem"].groupBy(
        F.expr("l_suppkey % 25").alias("o"), F.expr("l_partkey % 25").alias("d")
    ).agg(F.max_by("l_quantity", F.expr(star.LINE_ORDER)).alias("value"))
    zoned = ctx.run.trips.withColumns(
        {"o_maz": F.col("origin"), "d_maz": F.col("destination")}
    )
    return trips.add_walk_distance(zoned, lookup)


# --- weights -------------------------------------------------------------------------------------


@query(
    "weights_household",
    "source string, finalweight double, n bigint",
    "SELECT 'sample_rate' AS source, 1 / sample_rate AS finalweight, COUNT(*) AS n FROM raw_hh GROUP "
    "BY ALL UNION ALL SELECT 'column', hh_weight, COUNT(*) FROM raw_hh GROUP BY ALL UNION ALL SELECT "
    "'explicit', 1.0, COUNT(*) FROM raw_hh",
)
def household_weight(ctx):
    hh, config = ctx.raw.hh, star_raw.CONFIG
    variants = {
        "sample_rate": weights.household_weights(hh, config, None, False),
        "column": weights.household_weights(hh, config, "hh_weight", True),
        "explicit": weights.household_weights(hh, config, None, True),
    }
    parts = [
        df.groupBy("finalweight").agg(F.count(F.lit(1)).alias("n")).withColumn(
            "source", F.lit(name)
        )
        for name, df in variants.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


COLUMNS = weights.WeightColumns("hh_weight", None, "trip_weight", "day_weight")


def weighted_run(ctx: Context):
    run = ctx.raw.with_tables(
        day=col_ops.canonicalize("day", ctx.raw.day, star_raw.CONFIG)
    )
    return weights.compute_weights(run, star_raw.CONFIG, COLUMNS)


@query(
    "weights_inherited_by_persons",
    "person_id bigint, finalweight double",
    "SELECT person_id, COALESCE(hh_weight, 1) AS finalweight FROM raw_per LEFT JOIN raw_hh USING "
    "(household_id)",
)
def person_weight(ctx):
    return weighted_run(ctx).per


@query(
    "weights_of_days",
    "day_id bigint, person_id bigint, finalweight double",
    "SELECT day_id, d.person_id, COALESCE(day_weight, CASE WHEN p.person_id IS NOT NULL THEN "
    "h.hh_weight END, h.hh_weight, 1) AS finalweight FROM raw_day d LEFT JOIN raw_per p USING "
    "(person_id) LEFT JOIN raw_hh h ON h.household_id = hh_id",
)
def day_weight(ctx):
    return weighted_run(ctx).day


@query(
    "weights_of_tours_from_trips",
    "tour_id bigint, finalweight double",
    "SELECT tour_id, COALESCE(w, 1) AS finalweight FROM raw_tours LEFT JOIN (SELECT tour_id, "
    "AVG(trip_weight) AS w FROM raw_trips GROUP BY 1) USING (tour_id)",
)
def tour_weight(ctx):
    return weighted_run(ctx).tours


@query(
    "weights_full_pass",
    "table_name string, n bigint, total double",
    "SELECT 'hh' AS table_name, COUNT(*) AS n, SUM(hh_weight) AS total FROM raw_hh UNION ALL SELECT "
    "'per', COUNT(*), SUM(hh_weight) FROM raw_per JOIN raw_hh USING (household_id) UNION ALL SELECT "
    "'trips', COUNT(*), SUM(trip_weight) FROM raw_trips UNION ALL SELECT 'vehicles', COUNT(*), "
    "SUM(hh_weight) FROM vehicles JOIN raw_hh USING (household_id)",
)
def full_pass(ctx):
    run = weighted_run(ctx)
    parts = [
        run.tables[t].agg(
            F.count(F.lit(1)).alias("n"), F.sum("finalweight").alias("total")
        ).withColumn("table_name", F.lit(t))
        for t in ("hh", "per", "trips", "vehicles")
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


@query(
    "weights_person_travel",
    "tour_id bigint, w double",
    "SELECT tour_id, ptw AS w FROM person_tours",
)
def person_travel(ctx):
    return attach_person_travel_weight(ctx.run, ctx.run.tours, "NUMBER_HH", "w")


@query(
    "weights_household_tour",
    "tour_id bigint, w double",
    "SELECT tour_id, htw AS w FROM hh_tours",
)
def household_tour(ctx):
    return with_household_tour_weight(ctx.run.tours, "w")


@query(
    "weights_unweighted_mode",
    "tour_category string, n double",
    "SELECT tour_category, CAST(COUNT(*) AS DOUBLE) AS n FROM tours GROUP BY 1",
)
def unweighted_mode(ctx):
    run = weights.unweighted(ctx.run)
    return run.tours.groupBy("tour_category").agg(F.sum("finalweight").alias("n"))


@query(
    "weights_column_mode",
    "tour_id bigint, finalweight double",
    "SELECT tour_id, COALESCE(w, t.finalweight) AS finalweight FROM tours t LEFT JOIN (SELECT tour_id, "
    "AVG(od_dist) AS w FROM trips GROUP BY 1) USING (tour_id)",
)
def column_mode(ctx):
    return weights.column_weights(ctx.run, {"trips": "od_dist"}).tours
