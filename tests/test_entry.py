"""Registered queries: names, SQL for each, and results against another engine."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from check import canonical, same
from tests.conftest import SMALLEST

SAMPLE = [
    "summary_trip_mode_by_tour_purpose_and_tour_mode",
    "summary_population_totals",
    "summary_jtf_distribution",
    "summary_tour_time_of_day_by_tour_purpose",
    "summary_school_shadow_pricing_residual_histogram",
    "summary_skimjoin_trip_component_stats",
    "summary_auto_vmt_by_home_geography_income_hhsize_time_period",
    "lookup_annotated_trips",
    "lookup_fallback_report",
    "prepare_tour_origins",
    "prepare_out_of_direction",
    "quality_relationships",
    "segments_by_tour_mode",
    "compare_component_histogram",
]


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for path in glob.glob(f"{SMALLEST}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def test_every_query_has_sql():
    named = {name for module in entry.library_modules() for name in module.queries()}
    assert named <= set(entry.queries())
    assert named == {name for module in entry.library_modules() for name in module.oracle_sql()}
    assert len(named) > 200


def test_flagship_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["tour_purpose", "tour_mode", "trip_mode", "trip_count"]
    assert df.count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, database, name):
    ours = entry.queries()[name](spark, SMALLEST).toPandas()
    theirs = database.sql(entry.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert same(canonical(ours), canonical(theirs))


def test_rows_do_not_depend_on_partitions(spark):
    query = entry.queries()["summary_trip_rates_by_person_type_and_trip_purpose"]
    before = canonical(query(spark, SMALLEST).toPandas())
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert same(before, canonical(query(spark, SMALLEST).toPandas()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
