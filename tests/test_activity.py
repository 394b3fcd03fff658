"""Daily patterns, frequencies and rates on hand-made runs."""

import pytest

from tests.conftest import rows
from tripweave.model import ALL_PERSON_TYPES as ALL
from tripweave.model import Config, Run
from tripweave.plans.registry import get_summary

CONFIG = Config(use_maz=False)


def build(summary_id, run):
    return get_summary(summary_id).build(run, CONFIG)


@pytest.fixture
def run(frame):
    per = frame(
        "person_id bigint, person_type int, cdap_activity string, imf_choice int, "
        "finalweight double",
        (1, 1, "M", 3, 2.0), (2, 1, None, None, 4.0), (3, 2, None, None, 8.0),
    )
    day = frame(
        "person_id bigint, day_id bigint, cdap_activity string, finalweight double",
        (1, 1, "H", 9.0), (2, 1, "N", 0.5), (2, 2, "M", 0.25), (3, 1, None, None), (9, 1, "M", 1.0),
    )
    tours = frame(
        "person_id bigint, day_id bigint, tour_id bigint, tour_category string, "
        "tour_purpose string, finalweight double",
        (2, 1, 1, "mandatory", "Work", 1.0), (2, 1, 2, "mandatory", "work", 1.0),
        (2, 2, 3, "mandatory", "school", 1.0), (3, 1, 4, "non_mandatory", "shopping", 1.0),
    )
    parts = frame("person_id bigint, tour_id bigint", (2, 4))
    return Run("r", {"per": per, "day": day, "tours": tours, "joint_participants": parts})


def test_person_choice_comes_before_days(run):
    got = rows(build("daily_activity_pattern_by_person_type", run))
    assert got == [("1", "M", 2.25), ("1", "N", 0.5), (ALL, "M", 2.25), (ALL, "N", 0.5)]


def test_mandatory_frequency_from_choice_then_tours(run):
    got = rows(build("mandatory_tour_frequency_by_person_type", run))
    assert got == [("1", 2, 0.5), ("1", 3, 2.25), (ALL, 2, 0.5), (ALL, 3, 2.25)]


def test_nonmandatory_frequency_by_person_day(run):
    got = rows(build("nonmandatory_tour_frequency_by_person_type", run))
    assert ("2", "1", 8.0) in got  # day without weight takes the person's
    assert ("1", "1", 0.5) in got  # joint tour 4 falls on day 1 of person 2
    assert (ALL, "0", 9.25) in got


def test_nonmandatory_frequency_falls_back_to_persons(run, frame):
    stray = run.with_tables(joint_participants=frame("person_id bigint, tour_id bigint", (2, 99)))
    got = rows(build("nonmandatory_tour_frequency_by_person_type", stray))
    assert got == [("1", "0", 2.0), ("1", "1", 4.0), ("2", "1", 8.0),
                   (ALL, "0", 2.0), (ALL, "1", 12.0)]


def test_rates_divide_by_person_days(run):
    got = rows(build("tour_rates_by_person_type_and_tour_purpose", run))
    days = {"1": 9.0 + 0.75, "2": 8.0}
    assert ("2", "shopping", 1.0 / days["2"]) in got
    assert (ALL, "shopping", 1.0 / (days["1"] + days["2"])) in got


def test_missing_columns_give_a_typed_empty_table(run):
    df = build("trip_rates_by_person_type_and_trip_purpose", run)
    assert df.columns == ["person_type", "trip_purpose", "trip_rate"] and df.isEmpty()
    definition = get_summary("trip_rates_by_person_type_and_trip_purpose")
    assert definition.missing_inputs(run) == {"trips": "required table is unavailable"}


def test_weight_one_equals_unweighted(spark):
    from tests.conftest import SMALLEST
    from tripweave.operators.weights import unweighted
    from tripweave.sources import star

    base = star.star_run(spark, SMALLEST)
    ones = unweighted(base)
    df = get_summary("household_size_distribution").build(ones, star.CONFIG)
    assert df.agg({"household_count": "sum"}).first()[0] == base.hh.count()
