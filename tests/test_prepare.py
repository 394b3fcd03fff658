"""Preparation of small raw runs."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALLEST, rows
from tripweave.model import Config, GeographyAggregation, Run, StudentType
from tripweave.operators import columns, escort_events, persons, tours, trips, weights, zones
from tripweave.plans.prepare import prepare
from tripweave.sources import star, star_raw
from tripweave.sources.periods import period_table


def test_aliases_and_numeric_placeholders(frame):
    df = frame("tour_purpose int, primary_purpose string, start int, tid bigint", (3, "work", 7, 1))
    config = Config(aliases={"tour_id": ("tid",)})
    got = columns.canonicalize("tours", df, config)
    assert rows(got, "tour_purpose", "start_hour", "tour_id") == [("work", 7, 1)]
    kept = frame("tour_purpose string, primary_purpose string", ("shop", "work"))
    assert rows(columns.canonicalize("tours", kept, config), "tour_purpose") == [("shop",)]
    people = frame("ptype int, person_type int", (4, 9))
    assert rows(columns.canonicalize("per", people, config), "person_type") == [(4,)]


def test_clock_surveys_get_periods(frame):
    run = Run("survey", {
        "hh": frame("household_id bigint, num_people int, num_vehicles int", (1, 3, 2)),
        "per": frame("person_id bigint, can_drive int, person_type int", (1, 1, 1)),
        "tours": frame(
            "tour_id bigint, tour_start_hour int, tour_start_minute int, tour_end_hour int, "
            "tour_end_minute int, tour_mode string, tour_purpose string, duration_minutes int, "
            "distance_miles double", (1, 3, 0, 2, 45, "a", "b", 5, 4.5)),
        "trips": frame("trip_id bigint, linked_trip_mode string, d_purpose_category string, "
                       "depart_hour int, depart_minute int, distance_miles double",
                       (1, "a", "b", 4, 0, 1.5)),
    })
    got = columns.raw_survey_periods(run)
    assert rows(got.tours, "start_hour", "end_hour", "SKIMDIST") == [(1, 48, 4.5)]
    assert rows(got.trips, "depart", "od_dist") == [(3, 1.5)]
    assert rows(got.hh, "hhsize", "auto_ownership") == [(3, 2)]
    unchanged = run.with_tables(hh=run.hh.drop("num_people"))
    assert columns.raw_survey_periods(unchanged) is unchanged


def test_strict_final_types(frame):
    run = Run("r", {"tours": frame("tour_id string, AUTOSUFF bigint, x_geo__y int", ("7", 1, 5))})
    got = columns.cast_prepared(run).tours
    assert got.dtypes == [("tour_id", "bigint"), ("AUTOSUFF", "int"), ("x_geo__y", "string")]
    bad = Run("r", {"tours": frame("tour_id string", ("x",))})
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        columns.cast_prepared(bad).tours.collect()


def test_weights_follow_relations(frame):
    run = Run("r", {
        "hh": frame("household_id bigint, sample_rate double, hw double", (1, 0.25, 3.0)),
        "per": frame("person_id bigint, household_id bigint", (1, 1), (2, 9)),
        "day": frame("person_id bigint, household_id bigint, day_weight double",
                     (1, 1, 0.5), (1, 1, None), (7, 1, None), (7, 7, None)),
        "tours": frame("tour_id bigint, person_id bigint", (1, 1), (2, 2), (3, 8)),
        "trips": frame("trip_id bigint, tour_id bigint, person_id bigint, tw double",
                       (1, 1, 1, 2.0), (2, 1, 1, 4.0)),
        "vehicles": frame("vehicle_id bigint, household_id bigint", (1, 1), (2, 5)),
    })
    by_rate = weights.compute_weights(run, Config())
    assert rows(by_rate.hh, "finalweight") == [(4.0,)]
    assert rows(by_rate.per, "finalweight") == [(1.0,), (4.0,)]
    assert rows(by_rate.tours, "tour_id", "finalweight") == [(1, 4.0), (2, 1.0), (3, 1.0)]
    assert rows(by_rate.vehicles, "finalweight") == [(1.0,), (4.0,)]
    own = weights.compute_weights(run, Config(), weights.WeightColumns("hw", trip="tw"))
    assert rows(own.day, "finalweight") == [(0.5,), (1.0,), (3.0,), (3.0,)]
    assert rows(own.tours, "tour_id", "finalweight") == [(1, 3.0), (2, 1.0), (3, 1.0)]
    explicit = weights.compute_weights(run, Config(), weights.WeightColumns(trip="tw"))
    assert rows(explicit.hh, "finalweight") == [(1.0,)]  # no sample-rate expansion


def test_stop_counts_parties_and_durations(frame):
    df = frame("tour_id bigint, stop_frequency string, number_of_participants int",
               (1, "2out_1in", 4), (2, "0out_0in", None), (3, None, None))
    got = tours.add_party_size(tours.add_stop_counts(df), frame("tour_id bigint", (1,), (1,), (3,)))
    assert rows(got, "tour_id", "num_ob_stops", "num_ib_stops", "num_tot_stops", "NUMBER_HH") == [
        (1, 2, 1, 3, 2), (2, 0, 0, 0, 1), (3, None, None, None, 1),
    ]


def test_subtours_start_at_their_parent(frame):
    df = frame(
        "tour_id bigint, household_id bigint, tour_category string, origin bigint, "
        "destination bigint, parent_tour_id double",
        (1, 1, "mandatory", 5, 50, None), (2, 1, "At_Work", 6, 60, 1.0),
        (3, 1, "atwork", 7, 70, 99.0), (4, 9, "joint", 8, 80, None),
    )
    hh = frame("household_id bigint, home_zone_id bigint", (1, 10))
    got = tours.canonical_origins(df, hh)
    assert rows(got, "tour_id", "origin") == [(1, 10), (2, 50), (3, 7), (4, 8)]
    assert set(got.columns) == set(df.columns)


def test_composition_from_person_type_or_age(frame):
    df = frame("tour_id bigint, composition string", (1, None), (2, "given"), (3, None), (4, None))
    people = frame("person_id bigint, person_type int, age int", (1, 1, 40), (2, 7, 9), (3, None, 30),
                   (4, None, 995))
    parts = frame("tour_id bigint, person_id bigint", (1, 1), (1, 2), (2, 2), (3, 1), (3, 3), (4, 4))
    assert rows(tours.joint_composition(df, parts, people), "tour_id", "composition") == [
        (1, "mixed"), (2, "given"), (3, "adults"), (4, None),
    ]


def test_escort_fields_use_the_first_stated_label(frame):
    df = frame(
        "tour_id bigint, school_esc_outbound string, out_escort_type string, "
        "out_escorted_tour_ids string, inb_escorted_tour_ids bigint, num_escorted int",
        (1, " ", "pure", "3_4", 9, None), (2, "x", "pure", "", None, None), (3, None, None, None, 1, 5),
    )
    got = tours.normalize_escort_fields(df, Config(escort_labels={"pure": "pure_escort"}))
    assert rows(got, "tour_id", "school_esc_outbound", "num_escortees") == [
        (1, "pure_escort", 2), (2, "x", 0), (3, None, 5),
    ]


def test_trip_endpoints_and_stops(frame):
    run = Run("r", {
        "hh": frame("household_id bigint, income int", (1, 2)),
        "tours": frame("tour_id bigint, tour_purpose string, NUMBER_HH int, origin bigint",
                       (1, "work", 3, 100)),
        "trips": frame(
            "trip_id bigint, tour_id bigint, household_id bigint, outbound boolean, trip_num int, "
            "origin bigint, destination bigint, tour_purpose string",
            (1, 1, 1, True, 1, 5, 6, "old"), (2, 1, 1, True, 2, 6, 7, None),
            (3, 1, 1, False, 1, 7, 8, None), (4, 9, 1, False, 1, 1, 2, "own")),
        "land_use": frame("TAZ int", (1,)),
    })
    got = trips.enrich_trips(run, Config(use_maz=False)).trips
    assert rows(got, "trip_id", "origin", "destination", "stops", "inbound", "num_participants",
                "tour_purpose", "income_segment") == [
        (1, 100, 6, 1, 0, 3, "work", 2), (2, 6, 7, 0, 0, 3, "work", 2),
        (3, 7, 100, 0, 1, 3, "work", 2), (4, 1, 2, 0, 1, None, "own", 2),
    ]


def event_run(frame, names):
    """One adult escort tour 1 (two outbound trips) and a child's school tour 2."""
    per = frame("person_id bigint, person_type int", (1, 1), (2, 7), (3, 1))
    data = [
        (11, 1, 1, True, 1, 0, 30, "escort", "escort", 2),
        (12, 1, 1, True, 2, 30, 40, "work", "escort", 2),
        (21, 2, 2, True, 1, 0, 30, "school", "school", 1),
        (31, 3, 3, True, 1, 0, 9, "escort", "escort", 1),
    ]
    schema = ("trip_id bigint, tour_id bigint, person_id bigint, outbound boolean, trip_num int, "
              "origin bigint, destination bigint, trip_purpose string, "
              "summary_tour_purpose string, max_trip_num int, escort_participants string")
    trips_table = frame(schema, *[(*r, names.get(r[0])) for r in data])
    tours_table = frame(
        "tour_id bigint, summary_tour_purpose string, school_esc_outbound string, "
        "school_esc_inbound string, out_escorted_tour_ids string",
        (1, "escort", "pure_escort", None, "2"), (2, "school", "pure_escort", None, None),
        (3, "escort", "not_escorted", None, None))
    return Run("r", {"per": per, "trips": trips_table, "tours": tours_table})


@pytest.mark.parametrize(
    "names, status",
    [
        ({11: "a", 21: "a"}, {11: "matched", 12: None, 31: None}),
        ({11: "a", 12: "a", 21: "a"}, {11: "ambiguous", 12: "ambiguous", 31: None}),
        ({11: "b", 21: "a", 31: "c"}, {11: "unmatched", 12: None, 31: "unmatched"}),
    ],
)
def test_escort_events_by_participants(frame, names, status):
    got = escort_events.events_by_participants(event_run(frame, names))
    assert got.count() == 4
    found = dict(rows(got, "trip_id", "escort_event_match_status"))
    assert {k: found[k] for k in status} == status and found[21] is None
    if status[11] == "matched":
        position = rows(got.filter("trip_id = 11"), "escort_event_role", "escort_event_trip_num",
                        "escort_stops_before_event", "escort_stops_after_event")
        assert position == [("dropoff", 1, 0, 1)]


def test_escort_events_by_links(frame):
    run = event_run(frame, {})
    got = escort_events.events_by_tour_links(run)
    assert rows(got.filter("escort_event_role IS NOT NULL"), "trip_id", "escort_event_role",
                "escort_stops_after_event") == [(11, "dropoff", 1)]
    # Two equally good trips leave no event.
    tie = run.with_tables(trips=run.trips.withColumn("destination", F.lit(30)).withColumn(
        "trip_purpose", F.when(F.col("tour_id") == 1, "escort").otherwise(F.col("trip_purpose"))))
    assert escort_events.events_by_tour_links(tie).filter("escort_event_role IS NOT NULL").isEmpty()
    # Named participants take precedence over links.
    named = event_run(frame, {11: "a"})
    skipped = escort_events.events_by_tour_links(named)
    assert skipped.filter("escort_event_role IS NOT NULL").isEmpty()


def test_given_escort_events_survive_where_nothing_is_picked(frame):
    run = event_run(frame, {})
    given = run.trips.withColumns({
        "escort_event_role": F.when(F.col("trip_id") == 31, "dropoff"),
        "escort_event_trip_num": F.when(F.col("trip_id") == 31, F.lit(1)),
    })
    unlinked = run.with_tables(trips=given, tours=run.tours.withColumn("summary_tour_purpose", F.lit("work")))
    found = escort_events.events_by_tour_links(unlinked)
    assert rows(found.filter("escort_event_role IS NOT NULL"), "trip_id", "escort_event_trip_num") == [(31, 1)]
    # No adult escort trip names participants.
    found = escort_events.events_by_participants(run.with_tables(trips=given))
    assert rows(found.filter("escort_event_role IS NOT NULL"), "trip_id", "escort_event_trip_num") == [(31, 1)]
    # Events that links pick replace all given ones.
    found = escort_events.events_by_tour_links(run.with_tables(trips=given))
    assert rows(found.filter("escort_event_role IS NOT NULL"), "trip_id") == [(11,)]


def test_one_join_adds_events_to_the_trips(frame):
    run = event_run(frame, {})
    plan = escort_events.events_by_tour_links(run)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1


def test_zone_lookups(frame):
    land_use = frame("MAZ bigint, TAZ bigint, county string", (1, 10, "a"), (1, 11, "a"), (2, 20, "b"))
    df = frame("z bigint", (1,), (2,), (3,), (None,))
    got = zones.to_taz(df, "z", "taz", land_use, Config())
    assert rows(got) == [(1, 10), (2, 20), (3, None), (None, None)]
    report = zones.unresolved_report(got, {"m": (("z",), "taz")}).first()
    assert (report.total, report.unresolved) == (3, 1)
    assert rows(zones.to_taz(df, "z", "taz", land_use, Config(use_maz=False)), "taz")[0] == (1,)
    with pytest.raises(zones.GeographyLookupError, match="several labels"):
        zones.checked_geography_lookup(frame("z int, n string", (1, "a"), (1, "b")), "z", "n")
    lookup = zones.checked_geography_lookup(frame("z string, n string", ("1", " a "), ("1", "a")), "z", "n")
    config = Config(geographies=(GeographyAggregation("g", "maz", lookup),))
    labelled = zones.add_configured_geographies(df, "home", "z", "t", config)
    assert rows(labelled, "z", "home_geo__g")[0] == (1, "a")


def test_student_types_first_match_wins(frame):
    per = frame("person_id bigint, student string, major_uni string, SCHG string",
                (1, "yes", "1", "2"), (2, "yes", "0", "2"), (3, "no", "0", None))
    config = Config()
    df = columns.canonicalize("per", per, config)
    types = (StudentType("U", ("COLLEGE",)), StudentType("K", ("grade",), SCHG=("2",)))
    assert rows(persons.add_student_type(df, types), "person_id", "student_type") == [
        (1, "U"), (2, "K"), (3, None),
    ]


def test_whole_preparation(spark):
    tables = star.load(spark, SMALLEST)
    config = star_raw.config(tables)
    raw = star_raw.raw_run(tables)
    periods = period_table(spark, config.period_breakpoints, config.period_labels)
    run = prepare(raw, config, star_raw.skim(tables), periods=periods)
    for name in ("hh", "per", "day", "tours", "trips", "vehicles"):
        assert run.tables[name].count() == raw.tables[name].count(), name
    assert {"SKIMDIST", "summary_tour_purpose", "start_period", "AUTOSUFF", "NUMBER_HH"} <= set(
        run.tours.columns
    )
    assert {"od_dist", "stops", "escort_event_role", "trip_period"} <= set(run.trips.columns)
    assert run.trips.filter("od_dist IS NOT NULL").count() > 0
    assert run.tours.schema["OTAZ"].dataType.simpleString() == "int"
