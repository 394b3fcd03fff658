import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tripweave.functions import expressions as E
from tripweave.model import Config


def test_distance_bins_keep_exact_zero_and_refuse_unusable(frame):
    df = frame("d double", (0.0,), (0.2,), (1.0,), (39.9,), (40.0,), (-1.0,),
               (float("nan"),), (float("inf"),), (None,))
    got = [r[0] for r in df.select(E.distance_bin("d")).collect()]
    assert got == ["0", ">0-<1", "1", "39", "40+", None, None, None, None]
    order = frame("distance_bin string", *[(b,) for b in E.distance_bin_labels(3)])
    keyed = order.withColumn("k", E.distance_bin_order()).orderBy("k")
    assert [r[0] for r in keyed.collect()] == ["0", ">0-<1", "1", "2", "3+"]


def test_clock_periods_start_at_three(frame):
    df = frame("h int, m int", (3, 0), (2, 59), (3, 30), (0, 0), (24, 0), (5, 60), (None, 0))
    got = [r[0] for r in df.select(E.clock_to_period("h", "m")).collect()]
    assert got == [1, 48, 2, 43, None, None, None]


def test_escort_labels(frame):
    df = frame("e string", ("Pure Escort",), ("ride_share",), ("1",), ("No Escort",), ("",),
               ("taxi",), (None,))
    got = df.select(E.escort_type("e"), E.escort_present("e"), E.escort_explicit("e")).collect()
    assert [tuple(r) for r in got] == [
        ("pure_escort", True, True),
        ("ride_share", True, True),
        ("pure_escort", True, True),
        ("not_escorted", False, False),
        ("not_escorted", False, False),
        ("ride_share", True, False),
        ("not_escorted", False, False),
    ]


@pytest.mark.parametrize(
    "flags, expected",
    [
        ((True, True, True), ["school", "atwork", "joint", "all_tour_purposes", None]),
        ((True, True, False), ["school", "atwork", "joint_shop", "all_tour_purposes", None]),
        ((False, False, False), ["univ", "eat", "joint_shop", "all_tour_purposes", None]),
    ],
)
def test_summary_purpose_flags(frame, flags, expected):
    df = frame("tour_purpose string, tour_category string", ("univ", "mandatory"),
               ("eat", " AtWork "), ("shop", "Joint"), ("all_tour_purposes", "joint"),
               (None, "mandatory"))
    config = Config(
        group_school_tour_purposes=flags[0],
        group_atwork_tour_purposes=flags[1],
        group_joint_tour_purposes=flags[2],
    )
    got = [r[0] for r in df.select(E.summary_purpose(df.columns, config)).collect()]
    assert got == expected


def test_atwork_purpose_without_category(frame):
    df = frame("tour_purpose string, atwork_subtour_frequency string", ("work", "eat"),
               ("work", "no_subtours"), ("work", None), ("maint", None))
    got = [r[0] for r in df.select(E.summary_purpose(df.columns, Config())).collect()]
    assert got == ["atwork", "work", "work", "atwork"]


def test_identifiers_and_party_sizes(frame):
    df = frame("id string, number_of_participants int, NUMBER_HH int", ("12", 995, 3), ("995", 1, 1),
               (" ", 2, 9), ("x", None, None), ("-1", 4, 4))
    got = df.select(E.valid_identifier("id"), E.joint_party_size(df.columns)).collect()
    assert [tuple(r) for r in got] == [
        (True, 3.0), (False, None), (False, 2.0), (True, None), (False, 4.0),
    ]


def test_auto_modes_and_occupancy(frame):
    df = frame("trip_mode string, num_participants int", ("SHARED2", 9), ("HOV3", 9), ("taxi", 9),
               ("PNR_TRANSIT", 9), ("AUTO_X", 4), ("AUTO_X", 995), ("WALK", 1))
    got = df.select(
        E.auto_mode(Config(), True), E.auto_mode(Config(), False), E.stated_occupancy(df.columns)
    ).collect()
    assert [tuple(r) for r in got] == [
        (True, True, 2.0), (True, True, 3.33), (True, True, 1.0), (True, False, 1.0),
        (True, True, 4.0), (True, True, 1.0), (False, False, 1.0),
    ]
    configured = Config(mode_groups={"Auto": ("walk",)})
    only = df.filter(E.auto_mode(configured, False)).select("trip_mode")
    assert rows(only) == [("WALK",)]


def test_total_of_nothing_is_zero(frame):
    df = frame("k int, v double", (1, None), (2, 1.5))
    assert rows(df.groupBy("k").agg(E.total("v"))) == [(1, 0.0), (2, 1.5)]
    assert df.filter("k > 9").agg(E.total(F.col("v"))).first()[0] == 0.0
