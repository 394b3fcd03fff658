"""Joint tours: frequency codes, party and household weights, participation."""

import pytest

from tests.conftest import rows
from tripweave.model import Config, Run
from tripweave.operators.travel_weights import (
    attach_person_travel_weight,
    with_household_tour_weight,
)
from tripweave.plans.registry import get_summary
from tripweave.plans.summaries.joint import JOINT_ALTERNATIVES

CONFIG = Config(use_maz=False)


def build(summary_id, run):
    return get_summary(summary_id).build(run, CONFIG)


def test_alternatives_in_code_order():
    labels = [label for label, _ in JOINT_ALTERNATIVES]
    assert len(labels) == 21
    assert labels[0] == "No Joint Tours"
    assert labels[6:8] == ["2 Shopping", "1 Shopping / 1 Maintenance"]
    assert labels[20] == "2 Other Discretionary"


@pytest.fixture
def households(frame):
    hh = frame("household_id bigint, finalweight double", *[(i, float(i)) for i in range(1, 8)])
    tours = frame(
        "household_id bigint, tour_id bigint, tour_category string, tour_purpose string",
        (2, 21, "Joint", " Shop "),
        (3, 31, "joint", "maintenance"),
        (4, 41, "joint", "OTHMAINT"), (4, 42, "joint", "maint"),
        (5, 51, "joint", "shopping"), (5, 52, "joint", "othmaint"),
        (6, 61, "joint", "eatout"), (6, 62, "joint", "visiting"),
        (7, 71, "joint", "othdiscr"), (7, 72, "joint", "discretionary"), (7, 73, "joint", "shop"),
        (1, 11, "non_mandatory", "shopping"),
    )
    return Run("r", {"hh": hh, "tours": tours})


def test_frequency_codes_with_later_alternatives_first(households):
    got = {code: n for code, _, n in rows(build("jtf_distribution", households))}
    assert len(got) == 21
    expected = {1: 1.0, 2: 2.0, 3: 3.0, 12: 4.0, 8: 5.0, 17: 6.0, 21: 7.0}
    assert {c: n for c, n in got.items() if n} == expected


def test_frequency_counts_household_days(frame, households):
    day = frame("household_id bigint, person_id bigint, day_num int",
                (2, 1, 1), (2, 1, 2), (2, 2, 1), (3, 3, 1))
    tours = frame(
        "household_id bigint, day_num int, tour_id bigint, joint_tour_id bigint, "
        "tour_category string, tour_purpose string",
        (2, 1, 1, 7, "joint", "shopping"), (2, 1, 2, 7, "joint", "shopping"),
        (2, 2, 3, 995, "joint", "shopping"), (2, 2, 4, 995, "joint", "shopping"),
    )
    run = households.with_tables(day=day, tours=tours)
    got = {code: n for code, _, n in rows(build("jtf_distribution", run)) if n}
    # Household 3 has no joint tour; household 2 has one on day 1 (two rows of one tour) and,
    # with the not-applicable id, two on day 2.
    assert got == {1: 3.0, 2: 2.0, 7: 2.0}


def travel(frame, per_participant):
    per = frame("person_id bigint, finalweight double", (1, 2.0), (2, 3.0), (3, 4.0))
    people = (1, 2, 3) if per_participant else (1,)
    tour_rows = [(10 + p if per_participant else 10, p, "joint", 1 if per_participant else 3,
                  97.0) for p in people]
    tours = frame("tour_id bigint, person_id bigint, tour_category string, NUMBER_HH int, "
                  "finalweight double", *tour_rows)
    parts = frame("tour_id bigint, person_id bigint",
                  *[(10 + p if per_participant else 10, p) for p in (1, 2, 3)])
    return Run("r", {"per": per, "tours": tours, "joint_participants": parts})


@pytest.mark.parametrize("per_participant", [True, False])
def test_joint_travel_has_its_participants_weight(frame, per_participant):
    run = travel(frame, per_participant)
    df = attach_person_travel_weight(run, run.tours, "NUMBER_HH", "w")
    assert df.agg({"w": "sum"}).first()[0] == 9.0
    without = run.with_tables(joint_participants=None)
    stated = attach_person_travel_weight(without, run.tours, "NUMBER_HH", "w")
    assert stated.agg({"w": "sum"}).first()[0] == 97.0 * 3


def test_household_weight_of_complete_and_incomplete_groups(frame):
    tours = frame(
        "tour_id bigint, joint_tour_id bigint, tour_category string, NUMBER_HH int, "
        "finalweight double",
        (1, 5, "joint", 2, 8.0), (2, 5, "joint", 2, 8.0),      # complete: shared
        (3, 6, "joint", 3, 8.0), (4, 6, "joint", 3, 8.0),      # one row missing
        (5, 995, "joint", 2, 8.0), (6, 995, "joint", 2, 8.0),  # not a joint id
        (7, None, "joint", 2, 8.0),
        (8, 9, "joint", 2, 8.0), (9, 9, "joint", 3, 8.0),      # sizes differ
        (10, None, "mandatory", 1, 8.0),
    )
    got = dict(rows(with_household_tour_weight(tours, "w"), "tour_id", "w"))
    assert got[1] == got[2] == 4.0
    assert {got[i] for i in range(3, 11)} == {8.0}


def test_party_sizes_cap_at_five_and_ignore_not_applicable(frame):
    tours = frame("tour_category string, NUMBER_HH int, finalweight double", ("joint", 2, 1.0),
                  ("joint", 995, 1.0), ("joint", 1, 1.0), ("work", 3, 1.0))
    run = Run("r", {"tours": tours})
    assert rows(build("joint_tour_party_size_distribution", run)) == [(2, 1.0), (5, 0.0)]
    larger = run.with_tables(tours=tours.replace(995, 7, subset=["NUMBER_HH"]))
    assert rows(build("joint_tour_party_size_distribution", larger)) == [(2, 1.0), (5, 1.0)]


def test_person_participation_without_days(frame):
    run = Run("r", {
        "hh": frame("household_id bigint, HHSIZE int", (1, 2), (2, 1)),
        "per": frame("household_id bigint, person_id bigint, finalweight double",
                     (1, 11, 2.0), (1, 12, 3.0), (2, 21, 5.0)),
        "joint_participants": frame("person_id bigint, tour_id bigint", (12, 1), (12, 2)),
    })
    assert rows(build("person_jtp_by_household_size", run)) == [(1, 0.0, 5.0), (2, 3.0, 5.0)]
    counted = run.with_tables(per=run.per.selectExpr("*", "person_id - 11 AS num_joint_tours"))
    assert rows(build("person_jtp_by_household_size", counted)) == [(1, 5.0, 5.0), (2, 3.0, 5.0)]
