"""Vehicle miles, relationship checks, count fits, comparison of runs."""

import pytest

from tests.conftest import rows
from tripweave.model import Config, Run
from tripweave.operators import compare
from tripweave.operators.quality import count_fit, count_scatter, duplicate_keys, relationship_report
from tripweave.plans.registry import get_summary

CONFIG = Config(use_maz=False)
AUTO = "auto_vmt_by_home_geography_income_hhsize_time_period"


@pytest.fixture
def run(frame):
    trips = frame(
        "household_id bigint, trip_mode string, skim_auto_distance double, od_dist double, "
        "trip_period string, num_participants int, finalweight double",
        (1, "SOV", 10.0, 1.0, "AM", 1, 2.0), (1, "HOV2", 8.0, 1.0, "PM", 2, 1.0),
        (2, "PNR_TRANSIT", 4.0, 1.0, None, 1, 1.0), (2, "WALK", None, 2.0, "AM", 1, 1.0),
        (3, "HOV3", None, 6.66, "AM", 3, 1.0))
    hh = frame("household_id bigint, income_segment int, HHSIZE int, home_taz bigint, "
               "home_county string", (1, 4, 2, 7, "A"), (2, None, 1, 8, None))
    return Run("r", {"trips": trips, "hh": hh})


def build(sid, run):
    return get_summary(sid).build(run, CONFIG)


def test_auto_miles_by_segment(run):
    got = {
        (r.geography_type, r.geography_id, r.income_segment, r.time_period, r["mode"]): r.auto_vmt
        for r in build(AUTO, run).collect()
    }
    assert got["home_county", "A", "4", "AM", "SOV"] == 20.0
    assert got["home_county", "A", "4", "Daily", "HOV2"] == 4.0
    assert got["all_geographies", "all_geographies", "all_income_segments", "Daily",
               "PNR_TRANSIT"] == 4.0
    assert not any(k[0] == "home_county" and k[1] is None for k in got)
    assert rows(build("auto_vmt_totals", run)) == [(28.0,)]


def test_prepared_distance_is_the_fallback(run):
    without = run.with_tables(trips=run.trips.drop("skim_auto_distance"))
    # Park-and-ride is left out with the prepared distance.
    total = build("auto_vmt_totals", without).first()[0]
    assert total == pytest.approx(2.0 + 0.5 + 6.66 / 3.33)
    assert {r.distance_source for r in build(AUTO, without).collect()} == {"od_dist"}
    assert rows(build("auto_vmt_totals", without.with_tables(
        trips=without.trips.drop("od_dist")))) == [(0.0,)]


def test_joint_records_and_escort_events_count_once(frame):
    trips = frame(
        "trip_mode string, od_dist double, tour_category string, joint_trip_id bigint, "
        "escort_event_role string, finalweight double",
        ("HOV2", 10.0, "joint", None, None, 1.0),       # household record
        ("HOV2", 10.0, "joint", 5, None, 1.0), ("HOV2", 10.0, "joint", 5, None, 1.0),
        ("HOV2", 10.0, "joint", 6, None, 1.0),          # the only record of its trip
        ("HOV2", 10.0, "other", None, "dropoff", 1.0), ("HOV2", 10.0, "other", None, None, 1.0))
    assert rows(build("auto_vmt_totals", Run("r", {"trips": trips}))) == [(45.0,)]


def test_relationships(frame):
    run = Run("r", {
        "hh": frame("household_id bigint", (1,)),
        "per": frame("person_id bigint, household_id bigint", (1, 1), (2, 5), (3, 5), (4, None)),
        "tours": frame("tour_id bigint", (1,)),
        "trips": None,
    }, states={"vehicles": ("failed", "x")})
    got = {(r.source_table, r.key): (r.state, r.orphan_count) for r in
           relationship_report(run).collect()}
    assert len(got) == 11
    assert got["per", "household_id"] == ("failed", 2)
    assert got["tours", "household_id"][0] == got["vehicles", "household_id"][0] == "skipped"
    assert rows(duplicate_keys(run.per, "household_id")) == [(5, 2)]


def test_count_scatter_and_fit(frame):
    schema = "id bigint, FACTYPE int, am_vol double, md_vol double, pm_vol double, day_vol double"
    counts = frame(schema, *[(i, i % 2, i * 1.0, i * 2.0, 5.0, i * 4.0) for i in (1, 2, 3)])
    volumes = frame(schema, *[(i, i % 2, i * 2.0 + 1, i * 2.0, 7.0, 0.0) for i in (1, 2, 3, 4)])
    scatter = count_scatter(counts, volumes)
    assert scatter.count() == 12
    fit = {(r.facility_type, r.period): r for r in count_fit(scatter).collect()}
    am = fit["All", "AM"]
    assert (am.slope, am.intercept, am.r_squared) == pytest.approx((2.0, 1.0, 1.0))
    assert (am.equation_label, am.r_squared_label) == ("y = 2.00x + 1.00", "R² = 1.00")
    assert fit["All", "PM"].slope is None and fit["All", "PM"].equation_label == ""
    assert fit["0", "AM"].n_locations == 1


def test_comparison_with_a_base_run(frame):
    df = compare.stack_runs({
        "a": frame("k string, v double", ("x", 10.0), ("y", 0.0)),
        "b": frame("k string, v double", ("x", 15.0), ("y", 3.0), ("z", 1.0)),
    })
    got = {(r.run, r.k): (r.difference, r.percent_difference) for r in
           compare.compare_to_base(df, "a", ["k"], "v").collect()}
    assert got["b", "x"] == (5.0, "50.00%")
    assert got["b", "y"] == (3.0, "") and got["b", "z"] == (None, "")
    shares = compare.add_percent_of_total(df, "v", "p").groupBy("run").sum("p")
    assert [r[1] for r in rows(shares)] == pytest.approx([100.0, 100.0])
    aligned = compare.align_keys(df, ["k"], ["v"])
    assert ("a", "z", 0.0) in rows(aligned, "run", "k", "v") and aligned.count() == 6
    assert rows(compare.value_presence(df, "k").filter("in_all_runs"), "value") == [("x",), ("y",)]


def test_caps_and_clock_labels(frame):
    df = frame("run string, d string, v double", ("a", "39", 1.0), ("a", "40+", 2.0),
               ("a", "51+", 4.0), ("a", ">0-<1", 8.0))
    assert rows(compare.cap_categories(df, "d", 40, ["v"]), "d", "v") == [
        ("39", 1.0), ("40+", 6.0), (">0-<1", 8.0)
    ]
    bins = frame("run string, tour_purpose string, time_bin int", ("a", "w", 1), ("a", "w", 48))
    got = rows(compare.time_profile(bins, "w"), "time_bin", "clock_time", "duration_hours")
    assert got == [(1, "03:00", 0.5), (48, "02:30", 24.0)]


def test_wide_period_tables_with_and_without_daily(frame):
    wide = frame("run string, tod string, car double, mu double", ("a", "AM", 1.0, 2.0),
                 ("a", "PM", 3.0, 4.0), ("b", "AM", 1.0, 1.0), ("b", "Daily", 9.0, 1.0))
    by_type = rows(compare.wide_by_period(wide, ["car", "mu", "su"], "type"))
    assert by_type == [("a", "car", 4.0), ("a", "mu", 6.0), ("b", "car", 9.0), ("b", "mu", 1.0)]
    by_period = rows(compare.wide_by_period(wide, ["car", "mu"], "period"), "run", "category",
                     "value", "value_percent")
    assert ("a", "Daily", 10.0, 100.0) in by_period and ("b", "AM", 2.0, 20.0) in by_period


def test_runs_without_observed_flows_take_the_first_runs(frame):
    cells = "run string, Origin string, Destination string, "
    observed = frame(cells + "observed double", ("a", "x", "y", 5.0), ("z", "x", "y", 9.0))
    modeled = frame(cells + "modeled double", ("a", "x", "y", 4.0), ("b", "x", "y", 6.0))
    got = rows(compare.flow_comparison(observed, modeled), "run", "observed", "modeled")
    assert got == [("a", 5.0, 4.0), ("b", 5.0, 6.0)]


def test_total_rows_are_not_flows(frame):
    schema = ("run string, origin_geography_type string, destination_geography_type string, "
              "origin_geography_id string, destination_geography_id string, commuter_count double")
    flows = frame(schema, ("a", "d", "d", "x", "y", 2.0), ("a", "d", "d", "Total", "y", 2.0))
    got = compare.modeled_flows(flows, "d", totals=True)
    assert rows(got.filter("Origin = 'Total' AND Destination = 'Total'"), "modeled") == [(2.0,)]


def test_every_relation_is_counted_in_one_pass_over_each_table(frame, spark, tmp_path):
    """Orphans in all relations, keys of other types, null keys, and one shuffle by key."""
    tables = {
        "hh": frame("household_id bigint", (1,), (2,)),
        "per": frame("person_id int, household_id bigint", (10, 1), (11, 7), (12, None)),
        "day": frame("day_id int, person_id double, household_id string", (1, 10.0, "1"), (2, 99.0, "x"), (3, None, "2.0")),
        "tours": frame("tour_id bigint, person_id bigint, household_id bigint", (5, 10, 1), (6, 98, 8)),
        "trips": frame(
            "trip_id bigint, tour_id bigint, person_id bigint, household_id bigint",
            (1, 5, 10, 1), (2, 50, 10, 1), (3, 50, 97, 9), (4, None, None, 9),
        ),
        "vehicles": frame("vehicle_id int, household_id bigint", (1, 2), (2, 3), (3, 3)),
        "joint_participants": frame("tour_id bigint, person_id bigint", (5, 10), (60, 96), (60, 10)),
    }
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}")
    run = Run("r", {name: spark.read.parquet(f"{tmp_path}/{name}") for name in tables})
    report = relationship_report(run)
    got = {(r.source_table, r.key): r.orphan_count for r in report.collect()}
    assert got == {
        ("per", "household_id"): 1, ("day", "household_id"): 1, ("day", "person_id"): 1,
        ("tours", "household_id"): 1, ("tours", "person_id"): 1, ("trips", "household_id"): 2,
        ("trips", "person_id"): 1, ("trips", "tour_id"): 2, ("vehicles", "household_id"): 2,
        ("joint_participants", "person_id"): 1, ("joint_participants", "tour_id"): 2,
    }
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == len(tables) and "Join" not in plan


def test_keys_are_dealt_before_they_are_counted(spark, frame):
    """No task that reads a table holds its keys: their number may be far above its file's size."""
    tables = {
        "hh": frame("household_id int", (1,), (1,), (2,), (None,)),
        "per": frame("person_id bigint, household_id bigint", (1, 1), (2, 2), (2, 9), (None, 9), (3, None)),
        "day": frame("person_id bigint, household_id bigint", (2, 1), (4, 9), (4, 2), (None, None)),
    }
    got = {
        (r.source_table, r.key): r.orphan_count
        for r in relationship_report(Run("r", tables)).collect() if r.state != "skipped"
    }
    whole = {("per", "household_id"): 2, ("day", "household_id"): 1, ("day", "person_id"): 2}
    assert got == whole
    tables["day"] = tables["day"].withColumns({c: tables["day"][c].cast("string") for c in tables["day"].columns})
    report = relationship_report(Run("r", tables))
    got = {(r.source_table, r.key): r.orphan_count for r in report.collect() if r.state != "skipped"}
    assert got == whole
    many = spark.range(20_000).selectExpr("id AS person_id", "id AS household_id").coalesce(1)
    read = relationship_report(Run("r", {"hh": many, "per": many}))
    plan = read._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("REPARTITION_BY_COL") :]  # what runs before keys are dealt
    assert "Aggregate" not in below and "Range" in below


def test_telecommute_and_escort_comparisons(frame):
    table = frame(
        "run string, geography_type string, geography_id string, telecommute_frequency string, "
        "person_count double",
        ("a", "all_geographies", "all_geographies", "1", 4.0), ("a", "taz", "7", "2", 3.0),
        ("b", "all_geographies", "all_geographies", "2", 1.0), ("b", "taz", "7", "2", 2.0),
        ("b", "taz", "8", "2", 5.0),
    )
    config = Config(labels={"telecommute_frequency": {"2": "Two days", "1": "One day"}})
    got = compare.telecommute_distribution(table, ["1", "2"], config)
    label = "telecommute_frequency_label"
    assert rows(got, "run", "telecommute_frequency", "person_count", label, f"{label}_order") == [
        ("a", "1", 4.0, "One day", 1), ("a", "2", 0.0, "Two days", 0),
        ("b", "1", 0.0, "One day", 1), ("b", "2", 1.0, "Two days", 0),
    ]
    got = compare.telecommute_distribution(table, ["2", "9"], Config(), "taz", "7")
    assert rows(got, "run", "telecommute_frequency", "person_count", label) == [
        ("a", "2", 3.0, "2"), ("a", "9", 0.0, "9"), ("b", "2", 2.0, "2"), ("b", "9", 0.0, "9"),
    ]
    tours = frame("run string, direction string, person_type int, escort_type string, tour_count double",
                  ("a", "both", 1, "x", 1.0), ("a", "inbound", 2, "y", 2.0))
    assert rows(compare.escort_person_types(tours, "inbound")) == [("a", "2", 2.0)]
    assert rows(compare.student_escort_status(tours, "both")) == [("a", "x", 1.0)]
