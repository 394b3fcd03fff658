"""Comparison of two runs (the star-schema run and its unweighted form) on their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oracle.summaries_sql import SUMMARY_SQL, VALIDATION_SQL
from tripweave.operators import compare, quality
from tripweave.operators.weights import unweighted
from tripweave.plans.registry import get_summary
from tripweave.sources import star
from workload.context import Context, Registry

def pair(ctx: Context, summary_id: str, extra: bool = False) -> DataFrame:
    """One summary of both runs with a ``run`` column."""
    run = ctx.run
    if extra:
        run = star.add_validation_tables(run, ctx.tables)
    definition = get_summary(summary_id)
    return compare.stack_runs(
        {
            "base": definition.build(run, star.CONFIG),
            "unit": definition.build(unweighted(run), star.CONFIG),
        }
    )


registry = Registry()
query = registry.add
queries, oracle_sql = registry.queries, registry.oracle_sql


def both(summary_id: str) -> str:
    """Base rows of a summary, as SQL text, labelled as the base run."""
    body = {**SUMMARY_SQL, **VALIDATION_SQL}[summary_id]
    return f"(SELECT *, 'base' AS run FROM ({body}))"


def base(ctx: Context, summary_id: str, extra: bool = False) -> DataFrame:
    """One summary of the base run with a ``run`` column."""
    run = star.add_validation_tables(ctx.run, ctx.tables) if extra else ctx.run
    return compare.stack_runs({"base": get_summary(summary_id).build(run, star.CONFIG)})


# Person counts by type in both runs: the second has weight 1 throughout.
PERSONS = (
    "(SELECT 'base' AS run, CAST(person_type AS VARCHAR) AS person_type, SUM(finalweight) AS n FROM "
    "per GROUP BY ALL UNION ALL SELECT 'unit', CAST(person_type AS VARCHAR), CAST(COUNT(*) AS DOUBLE) "
    "FROM per GROUP BY ALL)"
)


@query("compare_percent_of_total", "run string, person_type string, share double",
       f"SELECT run, person_type, n / SUM(n) OVER (PARTITION BY run) * 100 AS share FROM {PERSONS}")
def percent_of_total(ctx):
    df = pair(ctx, "person_type_distribution")
    return compare.add_percent_of_total(df, "person_count", "share")


@query("compare_to_base_run",
       "run string, person_type string, person_count double, base_value double, "
       "difference double, percent_difference string",
       f"SELECT run, person_type, n AS person_count, b AS base_value, ABS(n - b) AS difference, "
       f"printf('%.2f%%', (n - b) / b * 100) AS percent_difference FROM {PERSONS} JOIN (SELECT "
       f"person_type, n AS b FROM {PERSONS} WHERE run = 'base') USING (person_type)")
def to_base(ctx):
    df = pair(ctx, "person_type_distribution")
    return compare.compare_to_base(df, "base", ["person_type"], "person_count")


@query("compare_percent_difference_wide", "person_type string, base string, unit string",
       f"SELECT u.person_type, '0.00%' AS base, printf('%.2f%%', (u.n - b.n) / b.n * 100) AS unit FROM "
       f"(SELECT * FROM {PERSONS} WHERE run = 'unit') u JOIN (SELECT * FROM {PERSONS} WHERE run = "
       "'base') b USING (person_type)")
def difference_wide(ctx):
    df = pair(ctx, "person_type_distribution")
    return compare.percent_difference_wide(
        df, "base", ["base", "unit"], ["person_type"], "person_count"
    )


@query("compare_complete_categories", "run string, person_type string, person_count double",
       f"SELECT r.run, t AS person_type, COALESCE(n, 0) AS person_count FROM (SELECT DISTINCT run FROM "
       f"{PERSONS}) r CROSS JOIN (SELECT UNNEST(['1', '5', '8', '9']) AS t) LEFT JOIN {PERSONS} p ON "
       "p.run = r.run AND p.person_type = t")
def complete(ctx):
    df = pair(ctx, "person_type_distribution")
    return compare.complete_categories(df, "person_type", ["1", "5", "8", "9"], ["person_count"])


AGES = (
    "(SELECT 'base' AS run, CAST(person_type AS VARCHAR) AS person_type, SUM(finalweight) AS n FROM "
    "per WHERE person_type < 6 GROUP BY ALL UNION ALL SELECT 'unit', CAST(person_type AS VARCHAR), "
    "CAST(COUNT(*) AS DOUBLE) FROM per WHERE person_type > 2 GROUP BY ALL)"
)


def uneven(ctx):
    df = pair(ctx, "person_type_distribution")
    code = F.col("person_type").cast("int")
    return df.filter(((F.col("run") == "base") & (code < 6)) | ((F.col("run") == "unit") & (code > 2)))


@query("compare_aligned_keys", "run string, person_type string, person_count double",
       f"SELECT r.run, k.person_type, COALESCE(n, 0) AS person_count FROM (SELECT DISTINCT run FROM "
       f"{AGES}) r CROSS JOIN (SELECT DISTINCT person_type FROM {AGES}) k LEFT JOIN {AGES} USING (run, "
       "person_type)")
def aligned(ctx):
    return compare.align_keys(uneven(ctx), ["person_type"], ["person_count"])


@query("compare_value_presence", "value string, runs bigint, in_all_runs boolean",
       f"SELECT person_type AS value, COUNT(DISTINCT run) AS runs, COUNT(DISTINCT run) = 2 AS in_all_runs "
       f"FROM {AGES} GROUP BY 1")
def presence(ctx):
    return compare.value_presence(uneven(ctx), "person_type")


@query("compare_labels", "person_type string, label string, label_order int",
       "SELECT CAST(t AS VARCHAR) AS person_type, CASE t WHEN 1 THEN 'Full-time worker' WHEN 2 THEN "
       "'Part-time worker' WHEN 3 THEN 'University student' ELSE CAST(t AS VARCHAR) END AS label, "
       "LEAST(t, 4) - 1 AS label_order FROM (SELECT DISTINCT person_type AS t FROM per)")
def labels(ctx):
    df = base(ctx, "person_type_distribution")
    return compare.label_categories(df, "person_type", "person_type", star.CONFIG, "label")


def add(name, schema, sql, build):
    query(name, schema, sql)(build)


def source(summary_id):
    return both(summary_id)


NUMBER = "TRY_CAST(REPLACE(CAST({0} AS VARCHAR), '+', '') AS DOUBLE)"


def cap(column, n):
    number = NUMBER.format(column)
    return (
        f"CASE WHEN CAST({column} AS VARCHAR) = '>0-<1' THEN '>0-<1' WHEN {number} >= {n} THEN '{n}+' "
        f"ELSE CAST(CAST({number} AS BIGINT) AS VARCHAR) END"
    )


add("compare_weighted_average", "run string, mandatory_tour_purpose string, "
    "average_tour_distance double",
    "SELECT run, mandatory_tour_purpose, SUM(average_tour_distance * person_count) / "
    "SUM(person_count) AS average_tour_distance FROM "
    f"{source('average_mandatory_tour_distance_by_purpose_and_geography')} WHERE geography_type = "
    "'district' GROUP BY ALL",
    lambda ctx: compare.weighted_average(
        compare.filter_geography_level(
            base(ctx, "average_mandatory_tour_distance_by_purpose_and_geography"), "district"),
        "mandatory_tour_purpose", "average_tour_distance", "person_count"))

add("compare_average_distance", "run string, nonmandatory_tour_purpose string, "
    "average_tour_distance double, base_value double, difference double",
    "SELECT run, nonmandatory_tour_purpose, average_tour_distance, average_tour_distance AS "
    "base_value, 0.0 AS difference FROM "
    f"{source('average_nonmandatory_tour_distance_by_purpose_and_geography')} WHERE geography_id = 'D1'",
    lambda ctx: compare.distance_comparison(
        base(ctx, "average_nonmandatory_tour_distance_by_purpose_and_geography"),
        "nonmandatory_tour_purpose", "tour_count", "base", "district", "D1"))

add("compare_geography_filter", "run string, geography_id string, worker_count double",
    f"SELECT run, geography_id, worker_count FROM {source('work_from_home_rate_by_geography')} WHERE "
    "geography_type = 'all_geographies'",
    lambda ctx: compare.filter_geography(
        compare.filter_geography_level(
            base(ctx, "work_from_home_rate_by_geography"), "All Geographies"), "All Geographies"))

add("compare_total_rates", "run string, tour_purpose string, tour_rate double",
    "SELECT 'base' AS run, tour_purpose, SUM(tour_rate * n) / (SELECT SUM(finalweight) FROM per) AS "
    f"tour_rate FROM {source('tour_rates_by_person_type_and_tour_purpose')} JOIN (SELECT person_type, "
    f"n FROM {PERSONS} WHERE run = 'base') USING (person_type) GROUP BY 2",
    lambda ctx: compare.total_rates(
        base(ctx, "tour_rates_by_person_type_and_tour_purpose"), "tour_purpose", "tour_rate",
        base(ctx, "person_type_distribution")))

add("compare_person_type_filter", "run string, tour_purpose string, tour_rate double",
    f"SELECT run, tour_purpose, tour_rate FROM {source('tour_rates_by_person_type_and_tour_purpose')} "
    "WHERE person_type = '4'",
    lambda ctx: compare.filter_person_type(
        base(ctx, "tour_rates_by_person_type_and_tour_purpose"), "4"))

add("compare_student_type_rollup", "run string, geography_type string, geography_id string, "
    "target_count double, modeled_count double, percent_error double",
    "SELECT run, geography_type, geography_id, SUM(target_count) AS target_count, SUM(modeled_count) "
    "AS modeled_count, CASE WHEN SUM(target_count) <> 0 THEN SUM(residual_count) / SUM(target_count) * "
    f"100 END AS percent_error FROM {source('school_shadow_pricing_residuals')} GROUP BY ALL",
    lambda ctx: compare.student_type_rollup(base(ctx, "school_shadow_pricing_residuals")))

add("compare_external_worker_share", "run string, external_worker_percent double",
    "SELECT run, external_worker_count / all_worker_count * 100 AS external_worker_percent FROM "
    f"{source('external_worker_workplace_locations')} WHERE geography_type = 'all_geographies'",
    lambda ctx: compare.external_worker_share(base(ctx, "external_worker_workplace_locations")))

add("compare_work_from_home_share", "run string, geography_label string, "
    "work_from_home_percent double",
    "SELECT run, geography_id AS geography_label, work_from_home_worker_count / worker_count * 100 AS "
    f"work_from_home_percent FROM {source('work_from_home_rate_by_geography')} WHERE geography_type = "
    "'home_county'",
    lambda ctx: compare.work_from_home_share(
        base(ctx, "work_from_home_rate_by_geography"), "home_county"))

add("compare_distance_distribution", "run string, distance_bin string, person_count double",
    f"SELECT run, {cap('distance_bin', 40)} AS distance_bin, SUM(person_count) AS person_count FROM "
    f"{source('work_location_distance_distribution_by_geography')} WHERE geography_type = 'district' "
    "GROUP BY ALL",
    lambda ctx: compare.distance_distribution(compare.filter_geography_level(
        base(ctx, "work_location_distance_distribution_by_geography"), "district")))

add("compare_vehicle_ownership", "run string, household_vehicle_count string, "
    "household_count double",
    f"SELECT run, {cap('household_vehicle_count', 4)} AS household_vehicle_count, "
    f"SUM(household_count) AS household_count FROM {source('auto_ownership_distribution')} WHERE "
    "household_size = '3' GROUP BY ALL",
    lambda ctx: compare.vehicle_ownership(base(ctx, "auto_ownership_distribution"), "3"))

add("compare_joint_party_size", "run string, party_size string, joint_tour_count double",
    f"SELECT run, {cap('party_size', 5)} AS party_size, SUM(joint_tour_count) AS joint_tour_count FROM "
    f"{source('joint_tour_party_size_distribution')} GROUP BY ALL",
    lambda ctx: compare.joint_party_sizes(base(ctx, "joint_tour_party_size_distribution")))

add("compare_joint_composition", "run string, tour_composition string, joint_tour_count double, "
    "position int",
    "SELECT run, tour_composition, SUM(joint_tour_count) AS joint_tour_count, CASE tour_composition "
    "WHEN 'adults' THEN 0 WHEN 'mixed' THEN 1 ELSE 2 END AS position FROM "
    f"{source('joint_tour_composition_by_party_size')} WHERE party_size = 3 GROUP BY ALL",
    lambda ctx: compare.joint_composition(base(ctx, "joint_tour_composition_by_party_size"), "3"))

add("compare_household_participation", "run string, jtf string, household_percent double",
    "SELECT run, jtf, AVG(household_percent) AS household_percent FROM "
    f"{source('household_jtp_by_household_size_and_jtf')} GROUP BY ALL",
    lambda ctx: compare.household_participation(
        base(ctx, "household_jtp_by_household_size_and_jtf")))

add("compare_person_participation", "run string, household_size string, person_percent double",
    f"SELECT run, {cap('household_size', 5)} AS household_size, SUM(joint_tour_person_count) / "
    f"SUM(total_person_count) * 100 AS person_percent FROM {source('person_jtp_by_household_size')} "
    "GROUP BY ALL",
    lambda ctx: compare.person_participation(base(ctx, "person_jtp_by_household_size")))

add("compare_joint_frequency_share", "run string, jtf_label string, household_count_percent double",
    "SELECT * FROM (SELECT run, jtf_label, household_count / SUM(household_count) OVER () * 100 AS "
    f"household_count_percent FROM {source('jtf_distribution')}) WHERE jtf_label <> 'No Joint Tours'",
    lambda ctx: compare.joint_frequency_share(base(ctx, "jtf_distribution"), hide_none=True))

add("compare_escort_event_stops", "run string, stop_count string, tour_count double",
    f"SELECT run, {cap('stop_count', 3)} AS stop_count, SUM(tour_count) AS tour_count FROM "
    f"{source('adult_escort_event_stop_distribution')} WHERE segment = 'outbound_before_dropoff' GROUP "
    "BY ALL",
    lambda ctx: compare.escort_event_stops(
        base(ctx, "adult_escort_event_stop_distribution"), "outbound_before_dropoff"))

def unit_weight(summary_id):
    """Rows of a summary of weight sums, as SQL text, in the run whose weights are all 1."""
    body = {**SUMMARY_SQL, **VALIDATION_SQL}[summary_id]
    counted = body.replace("SUM(finalweight)", "CAST(COUNT(*) AS DOUBLE)")
    return f"(SELECT *, 'unit' AS run FROM ({counted}))"


def of_both_runs(summary_id):
    return f"(FROM {both(summary_id)} UNION ALL BY NAME FROM {unit_weight(summary_id)})"


add("compare_escort_person_types", "run string, person_type string, tour_count double",
    "SELECT run, person_type, tour_count FROM "
    f"{of_both_runs('adult_escorted_tours_by_person_type_and_direction')} WHERE direction = 'inbound'",
    lambda ctx: compare.escort_person_types(
        pair(ctx, "adult_escorted_tours_by_person_type_and_direction"), "inbound"))

add("compare_student_escort_status", "run string, escort_type string, tour_count double",
    "SELECT run, escort_type, tour_count FROM "
    f"{of_both_runs('student_school_escort_status_by_direction')} WHERE direction = 'outbound'",
    lambda ctx: compare.student_escort_status(
        pair(ctx, "student_school_escort_status_by_direction"), "outbound"))

# The last value occurs in no run.
FREQUENCIES = ["never", "1_day", "every_day"]
add("compare_telecommute_distribution", "run string, telecommute_frequency string, "
    "person_count double",
    f"WITH f AS (SELECT UNNEST({FREQUENCIES}) AS telecommute_frequency), r AS (SELECT * FROM "
    f"{of_both_runs('telecommute_frequency_distribution')} WHERE geography_type = 'all_geographies') "
    "SELECT run, telecommute_frequency, COALESCE(person_count, 0) AS person_count FROM (SELECT * FROM "
    "f, (SELECT DISTINCT run FROM r)) LEFT JOIN r USING (run, telecommute_frequency)",
    lambda ctx: compare.telecommute_distribution(
        pair(ctx, "telecommute_frequency_distribution"), FREQUENCIES, star.CONFIG))

add("compare_escort_distances", "run string, distance_bin string, tour_count double",
    "SELECT 'base' AS run, distance_bin, COALESCE(tour_count, 0) AS tour_count FROM (SELECT CAST(x AS "
    "VARCHAR) AS distance_bin FROM generate_series(0, 39) g(x) UNION ALL SELECT '>0-<1' UNION ALL "
    "SELECT '40+') LEFT JOIN (SELECT * FROM "
    f"{source('adult_escorted_tour_distance_distribution_by_direction')} WHERE direction = 'both') "
    "USING (distance_bin)",
    lambda ctx: compare.escort_distances(
        base(ctx, "adult_escorted_tour_distance_distribution_by_direction"), "both", "tour_count"))

add("compare_escort_household_share", "run string, student_count string, percent double",
    "SELECT 'base' AS run, CAST(student_count AS VARCHAR) AS student_count, e.household_count / "
    "h.household_count * 100 AS percent FROM "
    f"{source('student_households_by_student_count')} h JOIN (SELECT * FROM "
    f"{source('households_with_school_escorting_by_student_count_and_direction')} WHERE direction = "
    "'both') e USING (student_count)",
    lambda ctx: compare.escort_household_share(
        base(ctx, "households_with_school_escorting_by_student_count_and_direction"),
        base(ctx, "student_households_by_student_count"), "both"))

add("compare_children_per_tour", "run string, student_count string, "
    "avg_schoolkids_per_tour double",
    "SELECT run, CAST(student_count AS VARCHAR) AS student_count, avg_schoolkids_per_tour FROM "
    f"{source('schoolkids_per_escorted_tour_by_student_count_and_direction')} WHERE direction = "
    "'inbound'",
    lambda ctx: compare.children_per_tour(
        base(ctx, "schoolkids_per_escorted_tour_by_student_count_and_direction"), "inbound"))

add("compare_tour_mode_share", "run string, tour_mode string, tour_count_percent double",
    "SELECT * FROM (SELECT run, tour_mode, tour_count_auto_deficient / SUM(tour_count_auto_deficient) "
    "OVER () * 100 AS tour_count_percent FROM "
    f"{source('tour_mode_by_tour_purpose_and_auto_sufficiency')} WHERE tour_purpose = "
    "'all_tour_purposes') WHERE tour_mode <> 'WALK'",
    lambda ctx: compare.tour_mode_share(
        base(ctx, "tour_mode_by_tour_purpose_and_auto_sufficiency"), "all_tour_purposes",
        "Auto Deficient", ["WALK"]))

add("compare_vehicle_attributes", "run string, fuel_type string, vehicle_count double",
    "SELECT run, fuel_type, SUM(vehicle_count) AS vehicle_count FROM "
    f"{source('allocated_vehicle_fuel_type_by_occupancy')} GROUP BY ALL",
    lambda ctx: compare.vehicle_attributes(
        base(ctx, "allocated_vehicle_fuel_type_by_occupancy"), "fuel_type"))

add("compare_stop_frequency", "run string, stop_frequency string, tour_count double",
    f"SELECT run, {cap('total_stop_count', 6)} AS stop_frequency, SUM(tour_count) AS tour_count FROM "
    f"{source('tour_stop_frequency_by_tour_purpose')} GROUP BY ALL",
    lambda ctx: compare.stop_frequency(base(ctx, "tour_stop_frequency_by_tour_purpose"), "Both"))

add("compare_time_profile", "run string, time_bin int, departure_tour_count double, "
    "clock_time string, duration_hours double",
    "SELECT run, time_bin, departure_tour_count, printf('%02d:%02d', m // 60, m % 60) AS clock_time, "
    "time_bin * 0.5 AS duration_hours FROM (SELECT *, CAST(((time_bin - 1) * 30 + 180 + 1440) % 1440 "
    f"AS BIGINT) AS m FROM {source('tour_time_of_day_by_tour_purpose')} WHERE tour_purpose = 'school')",
    lambda ctx: compare.time_profile(base(ctx, "tour_time_of_day_by_tour_purpose"), "school"))

MODES = ["BIKE", "DRIVEALONE", "FERRY", "SHARED2", "SHARED3", "WALK"]
add("compare_trip_mode_share", "run string, trip_mode string, trip_count_percent double",
    "SELECT * FROM (SELECT 'base' AS run, trip_mode, COALESCE(n, 0) / SUM(n) OVER () * 100 AS "
    f"trip_count_percent FROM (SELECT UNNEST({MODES}) AS trip_mode) LEFT JOIN (SELECT trip_mode, "
    "SUM(trip_count) AS n FROM "
    f"{source('trip_mode_by_tour_purpose_and_tour_mode')} WHERE tour_purpose = 'school' AND tour_mode "
    "= 'all_tour_modes' GROUP BY 1) USING (trip_mode)) WHERE trip_mode <> 'BIKE'",
    lambda ctx: compare.trip_mode_share(
        base(ctx, "trip_mode_by_tour_purpose_and_tour_mode").filter(
            "tour_purpose = 'school' AND tour_mode = 'all_tour_modes'"), MODES, ["BIKE"]))

add("compare_trip_distances", "run string, distance_bin string, trip_count double",
    f"SELECT run, {cap('distance_bin', 20)} AS distance_bin, SUM(trip_count) AS trip_count FROM "
    f"{source('trip_distance_by_purpose')} WHERE tour_purpose = 'escort' GROUP BY ALL",
    lambda ctx: compare.distances_of_purpose(
        base(ctx, "trip_distance_by_purpose"), "escort", "trip_count", 20))

add("compare_stop_purposes", "run string, stop_destination_purpose string, stop_count double",
    "SELECT run, stop_destination_purpose, SUM(stop_count) AS stop_count FROM "
    f"{source('stop_destination_purpose_by_tour_purpose')} GROUP BY ALL",
    lambda ctx: compare.purposes_of(
        base(ctx, "stop_destination_purpose_by_tour_purpose"), "stop_destination_purpose",
        "stop_count", None))

add("compare_parking_demand", "run string, geography_id string, parking_capacity double, "
    "trip_count double",
    "SELECT 'base' AS run, CAST(MAZ AS VARCHAR) AS geography_id, PNR_SPACES AS parking_capacity, "
    "COALESCE(trip_count, 0) AS trip_count FROM (SELECT MAZ, PNR_SPACES FROM land_use WHERE PNR_SPACES "
    f"IS NOT NULL) LEFT JOIN {source('parking_locations')} ON geography_id = CAST(MAZ AS VARCHAR)",
    lambda ctx: compare.parking_demand(
        base(ctx, "parking_locations"), compare.stack_runs({"base": ctx.run.land_use}),
        "PNR_SPACES"))

add("compare_mode_distribution", "run string, trip_mode string, freq double",
    "SELECT 'base' AS run, trip_mode, SUM(finalweight) AS freq FROM trips GROUP BY 2 UNION ALL SELECT "
    "'unit', trip_mode, COUNT(*) FROM trips GROUP BY 2",
    lambda ctx: compare.mode_distribution(compare.stack_runs(
        {"base": ctx.run.trips, "unit": unweighted(ctx.run).trips})))

add("compare_component_family", "run string, trip_mode string, skim_name string, mean double",
    "SELECT run, trip_mode, component AS skim_name, mean FROM "
    f"{source('skimjoin_trip_component_stats')} WHERE (trip_mode = 'WALK' AND component = "
    "'skim_walk_distance') OR (trip_mode = 'SHARED2' AND component = 'skim_auto_distance')",
    lambda ctx: compare.family_statistics(
        base(ctx, "skimjoin_trip_component_stats"), "trip_mode",
        {"WALK": ["skim_walk_distance"], "SHARED2": ["skim_auto_distance"]}))

add("compare_component_histogram", "run string, bin_mid double, freq double",
    "WITH r AS (SELECT 'base' AS run, skim_auto_distance AS v, finalweight AS w FROM trips UNION ALL "
    "SELECT 'unit', skim_auto_distance, 1.0 FROM trips), e AS (SELECT MIN(v) AS lo, MAX(v) AS hi FROM "
    "r), b AS (SELECT i, lo + i * ((hi - lo) / 500) AS a, CASE WHEN i = 499 THEN hi ELSE lo + (i + 1) "
    "* ((hi - lo) / 500) END AS z FROM e, generate_series(0, 499) g(i)) SELECT k.run, (a + z) / 2 AS "
    "bin_mid, COALESCE(SUM(w), 0) AS freq FROM b CROSS JOIN (SELECT DISTINCT run FROM r) k LEFT JOIN r "
    "ON r.run = k.run AND v >= a AND (v < z OR (i = 499 AND v <= z)) GROUP BY k.run, a, z",
    lambda ctx: compare.component_histogram(compare.stack_runs(
        {"base": ctx.run.trips, "unit": unweighted(ctx.run).trips}), "skim_auto_distance"))

SCREEN = source("screenline_flow_comparisons")
FIT = (
    "SELECT run, COUNT(*) AS n, MIN(x) AS lo, MAX(x) AS hi, REGR_SXY(y, x) / REGR_SXX(y, x) AS s, "
    "AVG(y) - REGR_SXY(y, x) / REGR_SXX(y, x) * AVG(x) AS c FROM (SELECT run, observed_volume AS x, "
    f"modeled_volume AS y FROM {SCREEN} WHERE count_period = 'AM') GROUP BY 1"
)
add("compare_screenline_scatter", "run string, screenline_id string, direction string, "
    "observed_volume double, modeled_volume double",
    f"SELECT run, screenline_id, direction, observed_volume, modeled_volume FROM {SCREEN} WHERE "
    "count_period = 'MD' AND facility_type = '2'",
    lambda ctx: compare.scatter_of(
        base(ctx, "screenline_flow_comparisons", True), "count_period", "MD", "2"))

add("compare_fit_lines", "run string, point int, observed_volume double, modeled_volume double",
    f"SELECT run, i AS point, lo + i * (hi - lo) / 100 AS observed_volume, s * (lo + i * (hi - lo) / "
    f"100) + c AS modeled_volume FROM ({FIT}), generate_series(0, 100) g(i)",
    lambda ctx: compare.fit_lines(compare.scatter_of(
        base(ctx, "screenline_flow_comparisons", True), "count_period", "AM")))


def counts(ctx):
    observed, modeled = star.count_tables(ctx.tables)
    return compare.stack_runs({"base": observed}), compare.stack_runs({"base": modeled})


PAIRS = (
    "(SELECT id, CAST(c.FACTYPE AS VARCHAR) AS facility_type, c.am_vol AS x, v.am_vol AS y FROM counts "
    "c JOIN volumes v USING (id) WHERE c.FACTYPE = v.FACTYPE)"
)
add("compare_facilities", "run string, facility_type string, n bigint, total_observed double, "
    "total_modeled double, percent_difference string, rmse double, rmspe string, r_squared double",
    "SELECT 'base' AS run, facility_type, COUNT(DISTINCT id) AS n, SUM(x) AS total_observed, SUM(y) AS "
    "total_modeled, CASE WHEN SUM(x) <> 0 THEN printf('%.2f%%', (SUM(y) - SUM(x)) / SUM(x) * 100) ELSE "
    "'' END AS percent_difference, SQRT(AVG(POW(y - x, 2))) AS rmse, CASE WHEN COUNT(*) FILTER (x = 0) "
    "= 0 THEN printf('%.2f%%', SQRT(AVG(POW((y - x) / x, 2)) FILTER (x <> 0)) * 100) ELSE '' END AS "
    "rmspe, CASE WHEN COUNT(*) >= 2 AND MIN(x) < MAX(x) THEN GREATEST(0, LEAST(1, "
    "POW(REGR_SXY(y, x), 2) / (REGR_SXX(y, x) * REGR_SYY(y, x)))) END AS r_squared FROM "
    f"{PAIRS} GROUP BY 2",
    lambda ctx: compare.facility_comparison(compare.scatter_of(compare.stack_runs(
        {"base": quality.count_scatter(*star.count_tables(ctx.tables))}), "period", "AM")))

add("compare_link_volumes", "run string, FACTYPE string, volume double",
    "SELECT 'base' AS run, CAST(FACTYPE AS VARCHAR) AS FACTYPE, SUM(day_vol) AS volume FROM counts "
    "GROUP BY 2",
    lambda ctx: compare.link_volumes(counts(ctx)[0], "day_vol"))

add("compare_top_links", "run string, id bigint, observed double, modeled double, "
    "difference double, percent_difference string, position int",
    "SELECT 'base' AS run, id, x AS observed, y AS modeled, y - x AS difference, CASE WHEN x <> 0 THEN "
    "printf('%.2f%%', (y - x) / x * 100) ELSE '' END AS percent_difference, ROW_NUMBER() OVER (ORDER "
    f"BY y DESC, id) AS position FROM {PAIRS} QUALIFY position <= 15",
    lambda ctx: compare.top_links(*counts(ctx), "am_vol", 15))

FLOWS = source("commuting_flows")
MODELED = (
    "SELECT 'base' AS run, COALESCE(o, 'Total') AS \"Origin\", COALESCE(d, 'Total') AS \"Destination\", "
    "SUM(n) AS modeled FROM (SELECT origin_geography_id AS o, destination_geography_id AS d, "
    f"commuter_count AS n FROM {FLOWS} WHERE origin_geography_type = 'district') GROUP BY CUBE(o, d)"
)
add("compare_modeled_flows", "run string, Origin string, Destination string, modeled double",
    MODELED,
    lambda ctx: compare.modeled_flows(base(ctx, "commuting_flows"), "district", totals=True))


def observed_matrix(ctx):
    """A wide observed matrix by district, with a total column and a place of its own."""
    homes = ctx.run.hh.groupBy(F.col("home_geo__district").alias("place"))
    wide = homes.agg(
        F.count_if(F.col("HHSIZE") == 1).cast("double").alias("D0"),
        F.count_if(F.col("HHSIZE") == 2).cast("double").alias("D2"),
        F.count_if(F.col("HHSIZE") == 9).cast("double").alias("D9"),
        F.count(F.lit(1)).cast("double").alias("Total"),
    )
    return compare.stack_runs({"base": wide})


OBSERVED = (
    "SELECT home_geo__district AS o, UNNEST(['D0', 'D2', 'D9']) AS d, UNNEST([COUNT(*) FILTER (HHSIZE "
    "= 1), COUNT(*) FILTER (HHSIZE = 2), COUNT(*) FILTER (HHSIZE = 9)]) AS x FROM hh GROUP BY 1"
)
add("compare_flow_matrix_long", "run string, Origin string, Destination string, observed double",
    f"SELECT 'base' AS run, o AS \"Origin\", d AS \"Destination\", x AS observed FROM ({OBSERVED})",
    lambda ctx: compare.flow_matrix_long(observed_matrix(ctx), "place", "observed"))

add("compare_flows", "run string, Origin string, Destination string, observed double, "
    "modeled double, difference double, percent_difference double",
    "SELECT 'base' AS run, a.o AS \"Origin\", b.d AS \"Destination\", COALESCE(x, 0) AS observed, "
    "COALESCE(m, 0) AS modeled, COALESCE(m, 0) - COALESCE(x, 0) AS difference, CASE WHEN x <> 0 THEN "
    "(COALESCE(m, 0) - x) / x * 100 END AS percent_difference FROM (SELECT o FROM o UNION SELECT o FROM "
    "m) a CROSS JOIN (SELECT d FROM o UNION SELECT d FROM m) b LEFT JOIN o USING (o, d) LEFT JOIN m "
    "USING (o, d)",
    lambda ctx: compare.flow_comparison(
        compare.flow_matrix_long(observed_matrix(ctx), "place", "observed"),
        compare.modeled_flows(base(ctx, "commuting_flows"), "district")))
_flows = registry.items["compare_flows"]
registry.items["compare_flows"] = type(_flows)(
    _flows.name, _flows.schema, _flows.build,
    f"WITH o AS ({OBSERVED}), m AS (SELECT origin_geography_id AS o, destination_geography_id AS d, "
    f"SUM(commuter_count) AS m FROM {FLOWS} WHERE origin_geography_type = 'district' GROUP BY ALL) "
    + _flows.sql,
)

add("compare_transit_by_operator", "run string, operator string, boardings double",
    "SELECT run, operator, SUM(boardings) AS boardings FROM "
    f"{source('transit_boardings_by_operator_and_technology')} WHERE technology = 'bus' GROUP BY ALL",
    lambda ctx: compare.transit_by_operator(
        base(ctx, "transit_boardings_by_operator_and_technology", True), "bus"))

VMT = "auto_vmt_by_home_geography_income_hhsize_time_period"
ACTIVE = "non_motorized_vmt_by_home_geography_income_hhsize_time_period"
add("compare_miles_by_period", "run string, category string, auto_vmt double, "
    "auto_vmt_percent double",
    "SELECT run, category, auto_vmt, auto_vmt / MAX(auto_vmt) FILTER (category = 'Daily') OVER () * 100 "
    "AS auto_vmt_percent FROM (SELECT run, time_period AS category, SUM(auto_vmt) AS auto_vmt FROM "
    f"{source(VMT)} WHERE geography_type = 'all_geographies' AND mode = 'SHARED2' GROUP BY ALL)",
    lambda ctx: compare.miles_by(base(ctx, VMT), "time_period", filters={
        "geography_type": "all_geographies", "mode": "SHARED2", "income_segment": "All"}))

add("compare_miles_top_geographies", "run string, category string, auto_vmt double, "
    "trip_count double",
    "SELECT run, geography_id AS category, SUM(auto_vmt) AS auto_vmt, SUM(trip_count) AS trip_count "
    f"FROM {source(VMT)} WHERE geography_type = 'home_taz' AND time_period = 'Daily' GROUP BY ALL "
    "ORDER BY auto_vmt DESC, category LIMIT 10",
    lambda ctx: compare.miles_by(base(ctx, VMT), "geography_id", filters={
        "geography_type": "home_taz"}, top=10))


def commercial(ctx):
    """Truck miles by period in wide form: one column per truck type."""
    table = star.add_validation_tables(ctx.run, ctx.tables).commercial_vehicle_trips
    wide = table.groupBy(F.col("trip_class").alias("tod")).agg(
        *[
            F.sum(F.when(F.col("truck_type") == flag, F.col("miles"))).alias(name)
            for flag, name in (("A", "car"), ("N", "mu"), ("R", "su"))
        ]
    )
    return compare.stack_runs({"base": wide})


TRUCK = "car mu su".split()
add("compare_commercial_by_period", "run string, category string, value double, "
    "value_percent double",
    "SELECT 'base' AS run, c AS category, v AS value, v / t * 100 AS value_percent FROM (SELECT "
    "trip_class AS c, SUM(miles) AS v, SUM(SUM(miles)) OVER () AS t FROM commercial_vehicle_trips "
    "GROUP BY 1 UNION ALL SELECT 'Daily', SUM(miles), SUM(miles) FROM commercial_vehicle_trips)",
    lambda ctx: compare.wide_by_period(commercial(ctx), TRUCK, "period"))

add("compare_commercial_by_type", "run string, category string, value double",
    "SELECT 'base' AS run, CASE truck_type WHEN 'A' THEN 'car' WHEN 'N' THEN 'mu' ELSE 'su' END AS "
    "category, SUM(miles) AS value FROM commercial_vehicle_trips GROUP BY 2",
    lambda ctx: compare.wide_by_period(commercial(ctx), TRUCK, "type"))

add("compare_miles_overview", "run string, category string, vmt double, percent_of_total double",
    "SELECT 'base' AS run, c AS category, v AS vmt, v / SUM(v) OVER () * 100 AS percent_of_total FROM "
    f"(SELECT 'Personal Auto' AS c, SUM(auto_vmt) AS v FROM {source(VMT)} WHERE geography_type = "
    "'all_geographies' AND time_period = 'Daily' UNION ALL SELECT 'Non-Motorized', "
    f"SUM(non_motorized_vmt) FROM {source(ACTIVE)} WHERE geography_type = 'all_geographies' AND "
    "time_period = 'Daily' UNION ALL SELECT 'External', SUM(miles) FROM commercial_vehicle_trips WHERE "
    "trip_class IN ('External', 'ee') UNION ALL SELECT 'Commercial', SUM(miles) FROM "
    "commercial_vehicle_trips WHERE trip_class = 'internal')",
    lambda ctx: compare.miles_overview({
        "Personal Auto": compare.total_miles(base(ctx, VMT), "auto_vmt"),
        "Non-Motorized": compare.total_miles(base(ctx, ACTIVE), "non_motorized_vmt"),
        "External": compare.total_wide_miles(commercial(ctx).filter("tod <> 'internal'"), TRUCK),
        "Commercial": compare.total_wide_miles(commercial(ctx).filter("tod = 'internal'"), TRUCK)}))
