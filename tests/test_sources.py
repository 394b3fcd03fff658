"""Reading, writing, external tables, weighting modes, stored summaries."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALLEST, rows
from tripweave.model import Config, Run
from tripweave.plans.build import store_summaries
from tripweave.plans.registry import SummaryContractError, get_summary, summary_ids
from tripweave.plans.weighting import WeightingError, default_modes
from tripweave.sources import star, tables
from tripweave.sources.lookups import TableSource, read_ordered_csv
from tripweave.sources.periods import period_table


def write(path, text):
    path.write_text(text)


def test_run_tables_parquet_first_then_csv_then_fallback(spark, frame, tmp_path):
    frame("household_id bigint", (1,), (2,)).write.parquet(str(tmp_path / "final_households.parquet"))
    write(tmp_path / "final_households.csv", "household_id\n9\n")
    write(tmp_path / "final_persons.csv", "person_id,name\n1,a\n2,7\n")
    write(tmp_path / "other.csv", "tour_id\n5\n")
    run = tables.read_run(spark, str(tmp_path), "r", fallbacks={"tours": str(tmp_path / "other.csv")})
    assert rows(run.hh) == [(1,), (2,)]
    assert run.per.schema.simpleString() == "struct<person_id:int,name:string>"
    assert rows(run.tours) == [(5,)]
    assert run.trips is None and run.states["trips"][0] == tables.UNAVAILABLE
    assert run.states["hh"] == (tables.AVAILABLE, "")


def test_prepared_tables_and_their_states(spark, tmp_path):
    write(tmp_path / "hh.csv", "household_id\n1\n")
    run = tables.read_prepared(
        spark, {"hh": str(tmp_path / "hh.csv"), "trips": str(tmp_path / "no.parquet")}, "r"
    )
    states = {name: state for name, (state, _) in run.states.items()}
    assert states["hh"] == tables.AVAILABLE and states["trips"] == tables.FAILED
    assert states["per"] == tables.EMPTY and states["day"] == tables.UNAVAILABLE


def test_external_tables_are_forced_to_their_contract(frame):
    sid = "household_size_distribution"
    table = frame("household_count int, household_size string", (5, "2"))
    df = tables.external_summary(table, sid)
    assert df.schema == get_summary(sid).schema and rows(df) == [(2, 5.0)]
    with pytest.raises(SummaryContractError, match="unexpected columns: z"):
        tables.external_summary(table.selectExpr("*", "1 AS z"), sid)
    with pytest.raises(SummaryContractError, match="missing columns"):
        tables.external_summary(table.drop("household_size"), sid)


def test_external_tables_are_the_same_in_every_mode(spark, tmp_path):
    write(tmp_path / "t.csv", "household_size,household_count\n1,2.5\n")
    loaded = tables.load_external_summaries(
        spark, {"household_size_distribution": str(tmp_path / "t.csv")}, ["weighted", "unweighted"]
    )
    assert len(loaded) == 2 and all(rows(df) == [(1, 2.5)] for df in loaded.values())


def test_written_tables_come_back(spark, frame, tmp_path):
    run = Run("r", {"hh": frame("household_id bigint, w double", (1, 0.5)), "per": None})
    for kind in ("parquet", "csv"):
        folder = str(tmp_path / kind)
        assert tables.write_tables(run, folder, kind) == [f"{folder}/hh.{kind}"]
        assert rows(tables.read_table(spark, f"{folder}/hh.{kind}")) == [(1, 0.5)]


def test_summaries_are_stored_by_run_segment_and_mode(spark, tmp_path):
    run = star.star_run(spark, SMALLEST).with_tables(vehicles=None)
    folder = str(tmp_path / "out")
    ids = ["household_size_distribution", "vehicle_age_distribution"]
    report = store_summaries(run, star.CONFIG, folder, ids)
    stored = tables.read_summary(spark, folder, "household_size_distribution")
    assert {r.weighting_mode for r in stored.collect()} == {"weighted", "unweighted"}
    total = stored.filter("weighting_mode = 'unweighted'").agg({"household_count": "sum"})
    assert total.first()[0] == run.hh.count()
    states = {r.id: r.state for r in report.collect()}
    assert states["full/full/weighted/household_size_distribution"] == "available"
    assert states["full/full/weighted/vehicle_age_distribution"] == "unavailable"


def test_catalogue_of_summaries():
    assert len(summary_ids()) == 100
    assert len(summary_ids(default_only=True)) == 85


def test_weighting_modes(spark, frame):
    modes = default_modes()
    assert modes.ids() == ["weighted", "unweighted"]
    modes.register_columns("survey", "Survey", {"households": "hw"})
    with pytest.raises(WeightingError, match="twice"):
        modes.register_columns("survey", "Other", {"households": "hw"})
    with pytest.raises(WeightingError, match="label"):
        modes.register_columns("other", "SURVEY", {"households": "hw"})
    with pytest.raises(WeightingError, match="unknown tables"):
        modes.register_columns("x", "X", {"cars": "w"})
    with pytest.raises(WeightingError, match="unknown mode"):
        modes.get("nothing")
    run = Run("r", {
        "hh": frame("household_id bigint, finalweight double, hw double", (1, 1.0, 3.0)),
        "per": frame("person_id bigint, household_id bigint, finalweight double",
                     (1, 1, 1.0), (2, 9, 7.0)),
        "trips": frame("trip_id bigint, person_id bigint, finalweight double", (1, 1, 1.0)),
    })
    weighted = modes.get("Survey ").apply(run, Config())
    assert rows(weighted.per, "person_id", "finalweight") == [(1, 3.0), (2, 7.0)]
    assert rows(weighted.trips, "finalweight") == [(3.0,)]
    with pytest.raises(WeightingError, match="needs columns"):
        modes.get("survey").apply(run.with_tables(hh=run.hh.drop("hw")), Config())


def test_csv_lines_keep_their_order(spark, tmp_path):
    lines = ["zone,walk"] + [f"{i % 3},{i}" for i in range(50)] + ["0,"]
    write(tmp_path / "walk.csv", "\n".join(lines) + "\n")
    source = TableSource("walk.csv", read_ordered_csv(spark, str(tmp_path / "walk.csv")))
    assert rows(source.long(["walk"]), "o", "value") == [(0.0, 48.0), (1.0, 49.0), (2.0, 47.0)]


def test_period_table(spark):
    table = period_table(spark, (0, 2, 3), ("A", "B"))
    assert rows(table) == [(1, "A"), (2, "A"), (3, "B")]
    with pytest.raises(ValueError):
        period_table(spark, (0, 2), ("A", "B"))
    with pytest.raises(ValueError):
        period_table(spark, (0,), ())


def test_a_write_counts_its_rows_and_is_published_whole(frame, spark, tmp_path):
    folder = f"{tmp_path}/out"
    path = tables.summary_path(folder, "s", "r", "weighted")
    first = frame("k int, v double", *[(k, 1.0) for k in range(7)])
    assert tables.store_summary(first, path) == 7
    assert tables.store_summary(first.limit(3), path) == 3  # a repeated write replaces all of it
    assert tables.read_summary(spark, folder, "s").count() == 3
    broken = first.withColumn("v", F.raise_error(F.lit("stop")).cast("double"))
    with pytest.raises(Exception, match="stop"):
        tables.store_summary(broken, path)
    assert tables.read_summary(spark, folder, "s").count() == 3
    assert [p.name for p in tmp_path.glob("out/s/run=r/*/*/*")] == ["weighting_mode=weighted"]
    assert tables.store_summary(first.limit(0), path) == 0
    assert tables.summary_state(0, {}) == ("empty", "") and tables.summary_state(2, {}) == ("available", "")
