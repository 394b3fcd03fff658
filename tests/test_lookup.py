"""Lookup sources and rules on small tables."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tripweave.operators import lookup
from tripweave.operators.lookup_rules import build_rules, rule_problems
from tripweave.sources import lookups


@pytest.fixture
def trips(frame):
    return frame(
        "trip_id bigint, trip_mode string, OTAZ int, DTAZ int, o_maz int, d_maz int, "
        "period string, outbound boolean, finalweight double",
        (1, "CAR", 1, 2, 101, 102, "AM", True, 1.0),
        (2, "CAR", 2, 1, 102, 101, "PM", False, 1.0),
        (3, "CAR", 2, 9, 102, 109, "AM", True, 2.0),
        (4, "BUS", 1, 2, 101, 103, "AM", False, 1.0),
        (5, "FERRY", 1, 1, 101, 101, "AM", True, 1.0),
    )


@pytest.fixture
def sources(spark, frame):
    walk = frame("maz int, bus double, _order int",
                 (101, 1.0, 1), (101, 2.0, 2), (101, None, 3), (102, 9999.05, 1), (103, 4.0, 1))
    pairs = frame("OMAZ int, DMAZ int, DIST double, note string, _order int",
                  (101, 102, 7.0, "a", 1), (101, 102, 8.0, "b", 2), (102, 101, 5.0, "c", 3))
    cells = frame("matrix string, o_idx int, values array<double>",
                  *[("AM", i, [10.0 * i + j for j in range(2)]) for i in range(2)])
    return lookups.LookupSources(
        spark,
        (lookups.TableSource("stop.csv", walk), lookups.TableSource("pairs.csv", pairs)),
        (lookups.MatrixSource("los", cells, ("AM",), 2),),
    )


SETTINGS = {
    "defaults": {"sentinel_values": [9999]},
    "dimensions": {"P": {"trip": "period", "values": {"AM": "AM", "PM": "PM"}}},
    "modes": {
        "CAR": {
            "time": {"matrix": "{P}", "fallbacks": [
                {"matrix": "pairs__DIST", "origin": "o_maz", "destination": "d_maz"}]},
        },
        "BUS": {
            "a": {"matrix": "stop__bus", "lookup": "key", "key_column": "o_maz",
                  "output": "skim_walk", "combine": "sum"},
            "b": {"matrix": "stop__bus", "lookup": "key", "key_column": "d_maz",
                  "output": "skim_walk", "combine": "sum"},
        },
    },
}


def test_sources_are_classified_and_keep_the_last_value(sources):
    names = {r.matrix_name: r.source_kind for r in sources.catalogue().collect()}
    assert names["stop__bus"] == "keyed_column"
    assert names["pairs__DIST"] == names["pairs.csv::pairs__DIST"] == "od_table"
    assert names["AM"] == "od_matrix" and "pairs__note" not in names
    stop = sources.tables[0].long(["bus"])
    assert rows(stop, "o", "value") == [(101.0, 2.0), (102.0, 9999.05), (103.0, 4.0)]
    demand = sources.spark.createDataFrame([(101.0, 102.0)], "o double, d double")
    assert rows(sources.tables[1].long(["DIST"], demand), "o", "d", "value") == [
        (101.0, 102.0, 8.0)
    ]


def test_steps_fall_back_until_one_is_valid(trips, sources):
    rules = build_rules(SETTINGS)
    result = lookup.annotate_trips(trips, rules, sources)
    got = {r.trip_id: (r.skim_time, r.skim_walk) for r in result.table.collect()}
    # No zone 0 occurs, so zones count from 1: (1, 2) is cell (0, 1).
    assert got[1] == (1.0, None)
    assert got[2] == (5.0, None)  # no PM matrix: the zone-pair table answers
    assert got[3] == (None, None)
    assert got[4] == (None, 6.0)  # both ends are added
    assert got[5] == (None, None)
    missing = rows(lookup.missing_report(result.attempts), "trip_id", "rule_name", "reason")
    assert missing == [(3, "CAR.time.fallback_1", "missing_od")]
    report = {r.logical_id: r for r in
              lookup.fallback_report(result.attempts, rules.trips, "trips").collect()}
    assert set(report) == {2, 3}
    assert (report[2].fallback_reason, report[2].primary_matrix_name) == ("missing_matrix", "PM")
    assert report[2].fallback_succeeded and report[3].fallback_exhausted
    stats = {r.rule_name: (r.n_trips, r.n_missing) for r in
             lookup.lookup_summary(result.attempts).collect()}
    assert stats["CAR.time"] == (2, 1)
    assert stats["CAR.time.fallback_1"] == (2, 1)


def test_sentinels_are_relative_and_absolute(trips, sources):
    bus = trips.filter("trip_id = 4").withColumn("o_maz", F.lit(102))
    result = lookup.annotate_trips(bus, build_rules(SETTINGS), sources)
    assert rows(result.table, "skim_walk") == [(4.0,)]  # 9999.05 is within 1e-5 of 9999
    assert rows(lookup.missing_report(result.attempts), "reason") == [("sentinel_value",)]


def test_zero_based_matrix_when_a_zone_zero_occurs(trips, sources):
    shifted = trips.filter("trip_id <= 2").withColumns(
        {"OTAZ": F.col("OTAZ") - 1, "DTAZ": F.col("DTAZ") - 1, "period": F.lit("AM")}
    )
    table = lookup.annotate_trips(shifted, build_rules(SETTINGS), sources).table
    assert rows(table, "trip_id", "skim_time") == [(1, 1.0), (2, 10.0)]


def test_missing_column_and_dimension_value(trips, sources):
    rules = build_rules(SETTINGS)
    no_period = trips.drop("period").filter("trip_id = 3")
    attempts = lookup.annotate_trips(no_period, rules, sources).attempts
    reasons = dict(rows(attempts.filter("step = 0"),
                        "rule_name", "reason"))
    assert reasons == {"CAR.time": "missing_trip_column:period"}
    unknown = trips.filter("trip_id = 3").withColumn("period", F.lit("XX"))
    attempts = lookup.annotate_trips(unknown, rules, sources).attempts
    assert dict(rows(attempts.filter("step = 0"), "rule_name", "reason")) == {
        "CAR.time": "missing_dimension_value:P"
    }


def test_ambiguous_names_need_their_file(trips, sources, spark):
    twice = lookups.LookupSources(
        spark, sources.tables, (*sources.matrices,
                                lookups.MatrixSource("other", sources.matrices[0].rows, ("AM",), 2))
    )
    fixed = {"modes": {"CAR": {"time": "AM"}}}
    with pytest.raises(lookup.AmbiguousSourceError, match="los::AM, other::AM"):
        lookup.annotate_trips(trips, build_rules(fixed), twice)
    named = {"modes": {"CAR": {"time": "los::AM"}}}
    table = lookup.annotate_trips(trips, build_rules(named), twice).table
    assert (1, 1.0) in rows(table, "trip_id", "skim_time")


def test_tour_directions_swap_the_ends(trips, sources):
    tours = trips.filter("trip_id = 1").withColumnsRenamed(
        {"trip_id": "tour_id", "trip_mode": "tour_mode"}
    )
    rules = build_rules({"modes": {"CAR": {"time": "AM", "only": {"matrix": "AM",
                                                                  "apply_to": "trips"}}}})
    table = lookup.annotate_tours(tours, rules, sources).table
    assert rows(table, "skim_time_outbound", "skim_time_inbound") == [(1.0, 10.0)]
    assert {r.output for r in rules.trips} == {"skim_time", "skim_only"}


def test_hypothetical_modes_cover_every_row(trips, sources):
    long = lookup.trip_hypotheticals(trips, build_rules(SETTINGS), sources)
    assert long.count() == 10  # five trips under two modes with one output each
    got = {(r.trip_id, r.hypothetical_mode): r.value for r in long.collect()}
    assert got[5, "CAR"] == 0.0 and got[4, "CAR"] == 1.0
    assert got[1, "BUS"] == 2.0  # the destination's value is a sentinel


def test_rule_checks(trips):
    rules = build_rules({
        "ignore_modes": ["FERRY"],
        "modes": {
            "CAR": {"x": {"matrix": "A", "output": "o"}, "y": {"matrix": "B", "output": "o"}},
            "BUS": {"segment_on": "outbound", "segments": {True: {"z": "A"}}},
        },
    })
    assert any("without sum" in p for p in rule_problems(rules.trips))
    assert lookup.uncovered_modes(trips, "trip_mode", rules.trips, rules.ignored_modes).isEmpty()
    assert rows(lookup.uncovered_segments(trips, "trip_mode", rules)) == [("BUS", "false", 1)]
    with pytest.raises(lookup.LookupPolicyError):
        lookup.apply_policy(trips.limit(1), "error", "check")
    assert lookup.apply_policy(trips, "warn", "check") is trips


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_a_fallback_step_sees_unresolved_demand_only(trips, sources):
    twice = trips.unionByName(trips.withColumn("trip_id", F.col("trip_id") + 10))
    found = lookup.annotate_trips(twice, build_rules(SETTINGS), sources)
    steps = rows(found.demand_attempts.filter("mode = 'CAR'"), "step", "valid", "origin", "rows")
    # The first CAR demand is answered by its matrix and asks no zone-pair table.
    assert steps == [
        (0, False, 2.0, 2), (0, False, 2.0, 2), (0, True, 1.0, 2), (1, False, 102.0, 2), (1, True, 102.0, 2)
    ]
    assert found.table.count() == 10
    per_row = found.attempts.filter("step = 1 and mode = 'CAR'")
    assert [r[0] for r in rows(per_row, "row_id")] == [12, 13, 2, 3]
    stats = {r.rule_name: r.n_trips for r in lookup.lookup_summary(found.demand_attempts).collect()}
    assert stats["CAR.time"] == 4 and stats["BUS.a"] == 2
    assert rows(lookup.lookup_summary(found.demand_attempts)) == rows(lookup.lookup_summary(found.attempts))


def test_null_zones_and_extra_columns_stay_out_of_lookups(trips, sources):
    odd = trips.withColumns(
        {
            "OTAZ": F.expr("CASE WHEN trip_id <> 1 THEN OTAZ END"),
            "value": F.lit("own"), "rows": F.lit(5), "row_id": F.lit("r"), "source_id": F.lit("s"),
        }
    )
    found = lookup.annotate_trips(odd, build_rules(SETTINGS), sources)
    assert found.table.columns == [*odd.columns, "skim_time", "skim_walk"]
    got = {r.trip_id: (r.skim_time, r.skim_walk, r.rows) for r in found.table.collect()}
    assert got[1] == (8.0, None, 5)  # no zone for the matrix: the zone-pair table answers
    assert got[4] == (None, 6.0, 5)
    assert dict(rows(found.demand_attempts.filter("origin is null"), "rule_name", "reason")) == {
        "CAR.time": "missing_od"
    }
    assert lookup.annotate_trips(odd.limit(0), build_rules(SETTINGS), sources).table.count() == 0


def test_only_demanded_cells_leave_a_matrix_row(spark, frame):
    size = 50
    matrix = frame(
        "matrix string, o_idx int, values array<double>",
        *[(m, i, [100.0 * i + j if j != 3 else None for j in range(size)]) for m in ("AM", "MD") for i in range(size)],
    )
    demand = frame(
        "source_id string, o double, d double",
        ("los::AM", 2.0, 7.0), ("los::AM", 2.0, 3.0), ("los::AM", 60.0, 1.0), ("los::AM", 1.0, 50.0),
        ("los::AM", 1.0, -1.0), ("los::AM", 1.5, 1.0), ("los::AM", 1.0, 1.5), ("x::AM", 1.0, 1.0),
    )
    source = lookups.MatrixSource("los", matrix, ("AM",), size)
    found = source.answers(demand)
    assert rows(found, "o", "d", "value")[0] == (2.0, 3.0, pytest.approx(float("nan"), nan_ok=True))
    assert rows(found, "o", "d", "value")[1:] == [(2.0, 7.0, 207.0)]
    plan = plan_of(found)
    assert "posexplode" not in plan and plan.count("Generate explode") == 1 and "_asked" in plan
    zones = frame("zone int, idx int", (500, 2), (501, 7))
    mapped = lookups.MatrixSource("los", matrix, ("AM",), size, zones)
    asked = frame("source_id string, o double, d double", ("los::AM", 500.0, 501.0), ("los::AM", 2.0, 7.0))
    assert rows(mapped.answers(asked), "o", "d", "value") == [(500.0, 501.0, 207.0)]
    assert mapped.all_cells().count() == 4


def test_rows_are_read_twice_whatever_the_number_of_steps(spark, trips, sources, tmp_path):
    trips.write.parquet(f"{tmp_path}/trips")
    stored = spark.read.parquet(f"{tmp_path}/trips")
    rules = build_rules(SETTINGS)
    for depth in (1, 3):
        steps = [{"matrix": "pairs__DIST", "origin": "o_maz", "destination": "d_maz"}] * depth
        settings = {**SETTINGS, "modes": {"CAR": {"time": {"matrix": "{P}", "fallbacks": steps}}}}
        table = lookup.annotate_trips(stored, build_rules(settings), sources).table
        assert table._jdf.queryExecution().optimizedPlan().toString().count("parquet") <= 2
    frequencies = lookup.trip_hypothetical_frequencies(stored, rules, sources)
    assert frequencies._jdf.queryExecution().optimizedPlan().toString().count("parquet") <= 2


def test_hypothetical_frequencies_equal_the_rows(trips, sources):
    rules = build_rules(SETTINGS)
    more = trips.unionByName(trips.withColumn("trip_id", F.col("trip_id") + 10))
    keys = ("observed_mode", "hypothetical_mode", "component", "value")
    long = lookup.trip_hypotheticals(more, rules, sources).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum("finalweight").alias("finalweight")
    )
    assert rows(lookup.trip_hypothetical_frequencies(more, rules, sources)) == rows(long)
