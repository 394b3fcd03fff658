import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tripweave.model import Run
from tripweave.operators.segments import (
    SEGMENT,
    SegmentError,
    Segmentation,
    analysis_units,
    segments_together,
    slice_run,
)


@pytest.fixture
def run(frame):
    return Run("r", {
        "hh": frame("household_id bigint, market string, home_zone_id bigint, finalweight double",
                    (1, "n", 10, 1.0), (2, "s", 20, 1.0), (3, "s", 20, 1.0)),
        "per": frame("person_id bigint, household_id bigint", (11, 1), (21, 2), (22, 2), (31, 3)),
        "day": frame("day_id bigint, person_id bigint, household_id bigint, season string",
                     (1, 11, 1, "x"), (2, 21, 2, "y"), (3, 21, 2, "y")),
        "tours": frame("tour_id bigint, person_id bigint, household_id bigint, purpose string",
                       (100, 11, 1, "a"), (200, 21, 2, "b"), (201, 21, 2, "b"), (300, 31, 3, "c")),
        "trips": frame("trip_id bigint, tour_id bigint, person_id bigint, household_id bigint",
                       (1000, 100, 11, 1), (2000, 200, 21, 2), (2001, 200, 21, 2)),
        "vehicles": frame("vehicle_id bigint, household_id bigint, fuel string", (7, 1, "g"),
                          (8, 2, "e"), (9, 2, "g")),
        "joint_participants": frame("tour_id bigint, person_id bigint, role string",
                                    (200, 21, "d"), (200, 22, "p"), (100, 11, "d")),
        "land_use": frame("MAZ bigint, TAZ bigint, county string", (10, 1, "A"), (20, 2, "B"),
                          (20, 2, "B")),
        "trip_hypothetical_skims": frame("trip_id bigint, value double", (1000, 1.0), (2000, 2.0)),
    })


def ids(run):
    keys = {"hh": "household_id", "per": "person_id", "tours": "tour_id", "trips": "trip_id",
            "vehicles": "vehicle_id", "day": "day_id"}
    return {t: [r[0] for r in rows(run.tables[t], k)] for t, k in keys.items()}


CASES = {
    "hh": ("market", ("s",), dict(hh=[2, 3], per=[21, 22, 31], tours=[200, 201, 300],
                                  trips=[2000, 2001], vehicles=[8, 9], day=[2, 3])),
    "per": ("person_id", (22,), dict(hh=[2], per=[22], tours=[], trips=[], vehicles=[8, 9],
                                     day=[])),
    # Person 21 has two matching tours and household 2 comes once all the same.
    "tours": ("purpose", ("b",), dict(hh=[2], per=[21], tours=[200, 201], trips=[2000, 2001],
                                      vehicles=[8, 9], day=[2, 3])),
    "trips": ("trip_id", (2000, 2001), dict(hh=[2], per=[21], tours=[200], trips=[2000, 2001],
                                            vehicles=[8, 9], day=[2, 3])),
    "vehicles": ("fuel", ("g",), dict(hh=[1, 2], per=[11, 21, 22], tours=[100, 200, 201],
                                      trips=[1000, 2000, 2001], vehicles=[7, 9], day=[1, 2, 3])),
    "day": ("season", ("y",), dict(hh=[2], per=[21], tours=[200, 201], trips=[2000, 2001],
                                   vehicles=[8, 9], day=[2, 3])),
    "joint_participants": ("role", ("p",), dict(hh=[2], per=[21, 22], tours=[200],
                                                trips=[2000, 2001], vehicles=[8, 9], day=[2, 3])),
    # The repeated zone row does not repeat its households.
    "land_use": ("county", ("B",), dict(hh=[2, 3], per=[21, 22, 31], tours=[200, 201, 300],
                                        trips=[2000, 2001], vehicles=[8, 9], day=[2, 3])),
}


@pytest.mark.parametrize("table", CASES)
def test_every_anchor_table(run, table):
    column, values, expected = CASES[table]
    spec = Segmentation("s", {"part": values}, column=column, table=table)
    full, part = analysis_units(run, spec)
    assert full.is_full and not part.is_full
    assert ids(part.run) == expected
    kept = {r[0] for r in rows(part.run.trip_hypothetical_skims, "trip_id")}
    assert kept == set(expected["trips"]) & {1000, 2000}


def test_segments_that_partition_a_run_add_up(run):
    spec = Segmentation("s", {"n": ("n",), "s": ("s",)}, column="market")
    full, *parts = analysis_units(run, spec)
    for table in ("hh", "per", "tours", "trips", "vehicles", "joint_participants"):
        counts = [unit.run.tables[table].count() for unit in parts]
        assert sum(counts) == full.run.tables[table].count()


def test_lookup_segments(run, frame):
    rows_ok = frame("key string, value string", ("10", "in"), ("20", "out"))
    spec = Segmentation("s", {"in": ("in",)}, table="hh", lookup=rows_ok, key="home_zone_id")
    assert ids(analysis_units(run, spec)[1].run)["hh"] == [1]
    twice = frame("key string, value string", ("10", "in"), ("10", "out"))
    bad = Segmentation("s", {"in": ("in",)}, table="hh", lookup=twice, key="home_zone_id")
    with pytest.raises(SegmentError, match="several rows"):
        analysis_units(run, bad)


def test_unclear_or_missing_columns_are_refused(run):
    with pytest.raises(SegmentError, match="name the table"):
        analysis_units(run, Segmentation("s", {"x": (1,)}, column="household_id"))
    with pytest.raises(SegmentError, match="no table"):
        analysis_units(run, Segmentation("s", {"x": (1,)}, column="nothing"))
    with pytest.raises(SegmentError, match="not in table"):
        analysis_units(run, Segmentation("s", {"x": (1,)}, column="market", table="per"))
    with pytest.raises(SegmentError):
        slice_run(run, "other", run.hh)


def test_empty_segment_policies(run):
    def spec(policy):
        return Segmentation("s", {"none": ("zz",)}, column="market", on_empty=policy)

    assert [u.segment_id for u in analysis_units(run, spec("keep"))] == ["full", "none"]
    assert [u.segment_id for u in analysis_units(run, spec("skip"))] == ["full"]
    with pytest.raises(SegmentError, match="empty"):
        analysis_units(run, spec("error"))


@pytest.mark.parametrize("table", CASES)
def test_all_segments_together_equal_their_slices(run, table):
    """With a segment that overlaps another one, one of all rows and one of none."""
    column, values, _ = CASES[table]
    everything = {r[0] for r in rows(run.tables[table], column)}
    spec = Segmentation("s", {"part": values, "all": tuple(everything), "none": ("zz",)},
                        column=column, table=table)
    together, units = segments_together(run, spec), analysis_units(run, spec)[1:]
    for name, got in together.tables.items():
        if SEGMENT not in got.columns:
            assert name == "land_use" != table
            continue
        slices = [u.run.tables[name].withColumn(SEGMENT, F.lit(u.segment_id)) for u in units]
        want = slices[0].unionByName(slices[1]).unionByName(slices[2])
        assert rows(got.select(want.columns)) == rows(want), name


def test_rows_without_key_or_value_are_in_no_segment(frame):
    run = Run("r", {
        "hh": frame("household_id bigint, market string", (1, "n"), (None, "n"), (2, None)),
        "trips": frame("trip_id bigint, tour_id bigint, person_id bigint, household_id bigint",
                       (10, 1, 1, 1), (11, 1, 1, None), (12, 1, 1, 2)),
    })
    spec = Segmentation("s", {"n": ("n",), "again": ("n", "s")}, column="market")
    got = segments_together(run, spec)
    assert rows(got.trips, "trip_id", SEGMENT) == [(10, "again"), (10, "n")]
    assert rows(got.hh, "household_id", SEGMENT) == [(1, "again"), (1, "n")]
    none = segments_together(run.with_tables(hh=run.hh.limit(0)), spec)
    assert rows(none.trips) == []
