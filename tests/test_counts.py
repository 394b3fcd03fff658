"""Summaries of one source and several weighting modes from one aggregation."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALLEST, rows
from tripweave.model import Config, Run
from tripweave.operators.segments import SEGMENT, Segmentation, analysis_units
from tripweave.operators.weights import side_by_side, unweighted
from tripweave.plans import build
from tripweave.plans.build import store_summaries, stored_run
from tripweave.plans.counts import COUNTS
from tripweave.plans.registry import get_summary, summary_ids
from tripweave.plans.weighting import (
    WeightingMode,
    counted_together,
    default_modes,
    summaries_by_mode,
    summaries_by_segment,
)
from tripweave.sources import star, tables

assert summary_ids()  # fills the registry
MODES = ["weighted", "unweighted", "size"]
TRIPS = [sid for sid, declared in COUNTS.items() if declared.source.table == "trips"]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    return stored_run(star.star_run(spark, SMALLEST), str(tmp_path_factory.mktemp("run")))


@pytest.fixture
def modes():
    known = default_modes()
    known.register_columns("size", "Size", {"households": "HHSIZE"})
    return known


def rounded(df):
    return rows(df.select(*[
        F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in sorted(df.dtypes)
    ]))


def scans(df, table):
    paths = [
        leaf.relation().location().rootPaths().mkString()
        for leaf in leaves_of(df)
        if "FileScan" in leaf.toString()
    ]
    return sum(path.endswith(f"/{table}.parquet") for path in paths)


def leaves_of(df):
    leaves = df._jdf.queryExecution().sparkPlan().collectLeaves()
    return [leaves.apply(i) for i in range(leaves.size())]


@pytest.mark.parametrize("sid", sorted(COUNTS))
def test_modes_together_equal_modes_one_by_one(stored, modes, sid):
    got = rounded(summaries_by_mode(stored, star.CONFIG, sid, MODES, modes))
    single = [
        get_summary(sid).build(modes.get(m).apply(stored, star.CONFIG), star.CONFIG).withColumn(
            "weighting_mode", F.lit(m)
        )
        for m in MODES
    ]
    assert got == rounded(single[0].unionByName(single[1]).unionByName(single[2]))


def test_all_trip_counts_of_all_modes_scan_as_often_as_one_of_one_mode(stored, modes):
    assert len(TRIPS) == 5
    one = get_summary(TRIPS[0]).build(stored, star.CONFIG)
    (together,) = counted_together(stored, star.CONFIG, TRIPS, MODES, modes)
    assert scans(together.grouped, "trips") == scans(one, "trips") > 0
    apart = summaries_by_mode(stored, star.CONFIG, "parking_locations", MODES, modes)
    assert scans(apart, "trips") == 3  # not declared as a count: one scan a mode
    together = summaries_by_mode(stored, star.CONFIG, "tour_category_distribution", MODES, modes)
    one = get_summary("tour_category_distribution").build(stored, star.CONFIG)
    assert scans(together, "tours") == scans(one, "tours")


def test_modes_that_change_more_than_weights_are_built_one_by_one(stored, modes):
    modes.register(WeightingMode(
        "adults", "Adults", lambda run, config: run.with_tables(trips=run.trips.filter("stops = 1"))
    ))
    assert counted_together(stored, star.CONFIG, TRIPS, ["weighted", "adults"], modes) == []
    got = summaries_by_mode(
        stored, star.CONFIG, "trip_purpose_distribution", ["weighted", "adults"], modes
    )
    sums = dict(rows(got.groupBy("weighting_mode").agg(F.sum("trip_count"))))
    assert 0 < sums["adults"] < sums["weighted"]


def test_rows_without_weight_or_keys(frame):
    trips = frame(
        "trip_id bigint, tour_purpose string, trip_purpose string, stops int, finalweight double",
        (1, "work", "shop", 1, 2.0), (2, "work", "shop", 0, None), (3, None, "shop", 1, 5.0),
        (4, "work", None, 1, 7.0), (5, "eat", "home", None, 0.0),
    )
    ids = ["trip_purpose_distribution", "stop_destination_purpose_by_tour_purpose"]
    for source in (trips, trips.limit(0)):
        run = Run("r", {"trips": source})
        (together,) = counted_together(
            run, Config(), ids, ["weighted", "unweighted"], default_modes()
        )
        for sid in ids:
            want = [
                (*r, mode)
                for mode, changed in (("weighted", run), ("unweighted", unweighted(run)))
                for r in rows(get_summary(sid).build(changed, Config()))
            ]
            assert sorted(rows(together.table(sid)), key=str) == sorted(want, key=str)
    assert counted_together(
        Run("r", {"trips": trips.drop("finalweight")}), Config(), ids, ["weighted"], default_modes()
    ) == []


def test_weights_side_by_side_leave_the_run_as_it_is(frame):
    run = Run("r", {
        "hh": frame("household_id bigint, finalweight double, w double", (1, 2.0, 3.0)),
        "trips": frame("trip_id bigint", (1,)),
    })
    moved = side_by_side(run, {
        "a": lambda r: r, "b": unweighted,
        "c": lambda r: r.with_tables(trips=r.trips.withColumn("finalweight", F.lit(9.0))),
    })
    assert rows(moved.hh, "household_id", "finalweight", "w", "a", "b", "c") == [
        (1, 2.0, 3.0, 2.0, 1.0, 2.0)
    ]
    assert moved.hh.columns == ["household_id", "finalweight", "w", "a", "b", "c"]
    assert moved.trips.columns == ["trip_id", "c"] and rows(moved.trips, "c") == [(9.0,)]


def test_stored_counts_equal_those_built_one_by_one(spark, stored, tmp_path, monkeypatch):
    shared, apart = str(tmp_path / "shared"), str(tmp_path / "apart")
    ids = [*TRIPS, "tour_category_distribution", "parking_locations"]
    first = store_summaries(stored, star.CONFIG, shared, ids)
    monkeypatch.setattr(build, "counted_together", lambda *_: [])
    second = store_summaries(stored, star.CONFIG, apart, ids)
    assert rows(first, "id", "state") == rows(second, "id", "state")
    for sid in ids:
        one, other = (tables.read_summary(spark, folder, sid) for folder in (shared, apart))
        assert one.columns == other.columns and rounded(one) == rounded(other)


SEGMENTATIONS = {
    "hh": Segmentation("s", {"one": (1,), "some": (1, 2, 3), "none": (99,)}, "HHSIZE", "hh"),
    # Joint tours lose the participants that are not in the segment.
    "per": Segmentation("s", {"some": (1, 2, 4), "more": (2, 3, 4, 5)}, "person_type", "per"),
    "tours": Segmentation("s", {"a": ("WALK",), "b": ("WALK", "BIKE")}, "tour_mode", "tours"),
}


@pytest.mark.parametrize("anchor", SEGMENTATIONS)
def test_segments_together_equal_segments_one_by_one(stored, modes, anchor):
    """One summary of each kind of weight: of trips, of joint tours, of tour participants."""
    spec, chosen = SEGMENTATIONS[anchor], ["size"]
    ids = [
        "trip_purpose_distribution",
        "tour_category_distribution",
        "tour_mode_by_tour_purpose_and_auto_sufficiency",
    ]
    found = summaries_by_segment(stored, star.CONFIG, ids, spec, chosen, modes)
    assert sorted(found) == sorted(ids)
    units = {unit.segment_id: unit.run for unit in analysis_units(stored, spec)[1:]}
    for sid in ids:
        got = rounded(found[sid])
        want = []
        for segment, cut in units.items():
            for m in chosen:
                built = get_summary(sid).build(modes.get(m).apply(cut, star.CONFIG), star.CONFIG)
                want += rounded(built.withColumns({
                    "segment_id": F.lit(segment), "weighting_mode": F.lit(m)
                }))
        assert sorted(got, key=str) == sorted(want, key=str), sid


def test_scans_do_not_depend_on_the_number_of_segments(stored, modes):
    def trip_scans(segments):
        spec = Segmentation("s", segments, "HHSIZE", "hh")
        (together,) = counted_together(stored, star.CONFIG, TRIPS, ["weighted"], modes, spec)
        assert together.by == [SEGMENT]
        return scans(together.grouped, "trips")

    one = get_summary(TRIPS[0]).build(stored, star.CONFIG)
    many = {f"s{k}": tuple(range(1, k + 1)) for k in range(1, 8)}
    assert trip_scans(many) == trip_scans({"s1": (1,)}) == scans(one, "trips") > 0


def test_modes_from_trip_weights_are_not_shared_by_segments_of_trips(stored, modes):
    modes.register_columns("trip", "Trip", {"trips": "od_dist"})
    spec = Segmentation("s", {"walk": ("WALK",)}, "trip_mode", "trips")
    for mode, shared in (("trip", 0), ("weighted", 1)):
        assert len(counted_together(stored, star.CONFIG, TRIPS, [mode], modes, spec)) == shared
    found = summaries_by_segment(stored, star.CONFIG, TRIPS[:1], spec, ["trip"], modes)
    assert {r[0] for r in rows(found[TRIPS[0]], "segment_id")} == {"walk"}


def test_stored_segments_equal_those_built_one_by_one(spark, stored, tmp_path, monkeypatch):
    shared, apart = str(tmp_path / "shared"), str(tmp_path / "apart")
    ids, spec = [*TRIPS[:2], "household_size_distribution"], SEGMENTATIONS["hh"]
    first = store_summaries(stored, star.CONFIG, shared, ids, spec)
    monkeypatch.setattr(build, "counted_together", lambda *_: [])
    second = store_summaries(stored, star.CONFIG, apart, ids, spec)
    assert rows(first, "id", "state") == rows(second, "id", "state")
    for sid in ids:
        for segment in spec.segments:
            one, other = (
                spark.read.parquet(
                    tables.summary_path(folder, sid, stored.label, "weighted", "s", segment)
                )
                for folder in (shared, apart)
            )
            assert one.columns == other.columns and rounded(one) == rounded(other)
