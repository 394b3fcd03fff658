"""Weighted statistics, distributions and histograms against NumPy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tripweave.model import Config, Run
from tripweave.operators.aggregate import (
    add_totals,
    densify,
    least_squares,
    residual_histogram,
    with_daily_rows,
)
from tripweave.operators.weighted_stats import weighted_ecdf, weighted_quantile
from tripweave.plans.registry import get_summary

CONFIG = Config(use_maz=False)


def quantile(pairs, p):
    pairs = sorted(pairs)
    threshold = sum(w for _, w in pairs) * p
    cumulative = 0.0
    for value, weight in pairs:
        cumulative += weight
        if cumulative >= threshold:
            return value
    return pairs[-1][0]


@pytest.fixture
def trips(spark):
    rng = np.random.default_rng(7)
    data = []
    for i in range(600):
        mode = "ABCD"[i % 4]
        value = None if mode == "D" or i % 11 == 0 else float(rng.integers(0, 40)) / 4
        data.append((i, mode, value, 1.0 + (i % 8) / 8))
    data.append((600, None, 3.0, 1.0))
    return spark.createDataFrame(
        data, "trip_id bigint, trip_mode string, skim_x double, finalweight double"
    )


def records(trips, modes):
    return [(r.skim_x, r.finalweight) for r in trips.collect()
            if r.trip_mode and r.trip_mode in modes]


def test_statistics_match_direct_calculation(trips, frame):
    sidecar = frame(
        "trip_id bigint, observed_mode string, hypothetical_mode string, component string, "
        "value double, finalweight double",
        (1, "A", "Z", "skim_x", 2.0, 1.0), (2, "A", "Z", "skim_x", 6.0, 3.0),
        (3, "B", "Z", "skim_x", None, 4.0),
    )
    run = Run("r", {"trips": trips, "trip_hypothetical_skims": sidecar})
    df = get_summary("skimjoin_trip_component_stats").build(run, CONFIG)
    got = {(r.skim_scenario, r.trip_mode): r for r in df.collect()}
    assert set(got) == {("chosen_mode", m) for m in ("A", "B", "C", "D", "All Modes")} | {
        ("all_records", "Z")
    }
    for label, modes in {"A": "A", "B": "B", "All Modes": "ABC"}.items():
        everything = records(trips, modes)
        valid = [(v, w) for v, w in everything if v is not None]
        r = got["chosen_mode", label]
        n_total, n_valid = sum(w for _, w in everything), sum(w for _, w in valid)
        mean = sum(v * w for v, w in valid) / n_valid
        nonzero = [(v, w) for v, w in valid if v]
        weights = {}
        for v, w in valid:
            weights[v] = weights.get(v, 0.0) + w
        heaviest = min(v for v, w in weights.items() if w == max(weights.values()))
        assert (r.n_total, r.n_valid) == (n_total, n_valid)
        assert r.mean == pytest.approx(mean)
        assert r.std == pytest.approx(
            math.sqrt(sum(w * (v - mean) ** 2 for v, w in valid) / n_valid)
        )
        assert r.mean_nonzero == pytest.approx(
            sum(v * w for v, w in nonzero) / sum(w for _, w in nonzero)
        )
        assert (r.median, r["mode"]) == (quantile(valid, 0.5), heaviest)
        assert r.zero_share == pytest.approx(sum(w for v, w in valid if v == 0) / n_valid)
        assert r.missing_share == pytest.approx((n_total - n_valid) / n_total)
    idle = got["chosen_mode", "D"]
    assert (idle.n_valid, idle.mean, idle.missing_share) == (0.0, None, 1.0)
    side = got["all_records", "Z"]
    assert (side.n_total, side.n_valid, side.mean, side.median) == (8.0, 4.0, 5.0, 6.0)


def test_distribution_has_101_points(trips):
    run = Run("r", {"trips": trips})
    df = get_summary("skimjoin_trip_component_ecdf").build(run, CONFIG)
    got = {(r.trip_mode, round(r.percentile * 100)): r.value for r in df.collect()}
    for label, modes in {"A": "A", "C": "C", "All Modes": "ABC"}.items():
        valid = [(v, w) for v, w in records(trips, modes) if v is not None]
        for i in range(101):
            assert got[label, i] == quantile(valid, i / 100), (label, i)
    assert not any(mode == "D" for mode, _ in got)


def test_one_heavy_value(frame):
    freq = frame("k string, value double, w double, n bigint",
                 ("a", 1.0, 1.0, 1), ("a", 2.0, 1000.0, 1), ("a", 9.0, 0.1, 1), ("b", 4.0, 2.0, 1))
    assert rows(weighted_quantile(freq, ["k"], 0.5)) == [("a", 2.0), ("b", 4.0)]
    points = weighted_ecdf(freq, ["k"])
    assert points.count() == 202
    assert rows(points.filter("k = 'a' AND percentile IN (0.0, 1.0)"), "percentile", "value") == [
        (0.0, 1.0), (1.0, 9.0)
    ]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_residual_histogram_matches_freedman_diaconis(spark, seed):
    rng = np.random.default_rng(seed)
    values = np.round(rng.normal(0, 50, 400) * 8) / 8
    values[::40] = 0.0
    df = spark.createDataFrame([("g", float(v)) for v in values], "g string, v double")
    got = rows(residual_histogram(df, ["g"], "v"), "bin_start", "bin_end", "geography_count")
    other = values[np.abs(values) > 1e-8]
    counts, edges = np.histogram(other, bins=np.histogram_bin_edges(other, bins="fd"))
    expected = [(0.0, 0.0, float((np.abs(values) <= 1e-8).sum()))]
    expected += [(edges[i], edges[i + 1], float(c)) for i, c in enumerate(counts)]
    assert len(got) == len(expected)
    for a, b in zip(sorted(got), sorted(expected)):
        assert a == pytest.approx(b)


def test_residual_histogram_special_cases(frame):
    df = frame("g string, v double", ("one", 8.0), ("zero", 0.0), ("same", 2.0), ("same", 2.0),
               ("two", 1.0), ("two", 5.0), ("none", None))
    got = rows(residual_histogram(df, ["g"], "v"))
    assert got == [
        ("one", 6.0, 10.0, 1.0), ("same", 1.0, 3.0, 2.0),
        ("two", 1.0, 3.0, 1.0), ("two", 3.0, 5.0, 1.0), ("zero", 0.0, 0.0, 1.0),
    ]


def test_histogram_has_at_most_200_bins(spark):
    values = [float(i % 7) for i in range(3000)] + [1e6]
    df = spark.createDataFrame([("g", v) for v in values], "g string, v double")
    result = residual_histogram(df, ["g"], "v").filter("bin_end > bin_start")
    assert result.count() == 200
    assert result.agg(F.sum("geography_count")).first()[0] == sum(1 for v in values if v)


def test_totals_and_zero_fill(frame):
    df = frame("a string, b int, v double", ("x", 1, 1.0), ("y", 1, 2.0), ("y", 3, 4.0))
    got = rows(add_totals(df, {"a": "all"}, ["a", "b"], ["v"]))
    assert ("all", 1, 3.0) in got and ("all", 3, 4.0) in got and len(got) == 5
    dense = rows(densify(df, ["a"], "b", [1, 2], ["v"]))
    assert dense == [("x", 1, 1.0), ("x", 2, 0.0), ("y", 1, 2.0), ("y", 2, 0.0)]


def test_daily_rows_are_derived_unless_only_daily_exists(frame):
    df = frame("k string, time_period string, v double", ("a", "AM", 1.0), ("a", "PM", 2.0),
               ("a", "Daily", 50.0), ("b", "Daily", 7.0))
    got = rows(with_daily_rows(df, ["k"], ["v"]), "k", "time_period", "v")
    assert got == [("a", "AM", 1.0), ("a", "Daily", 3.0), ("a", "PM", 2.0), ("b", "Daily", 7.0)]


def test_least_squares_edge_cases(frame):
    df = frame("g string, observed_volume double, modeled_volume double",
               ("line", 1.0, 3.0), ("line", 2.0, 5.0), ("line", 4.0, 9.0),
               ("point", 1.0, 1.0), ("upright", 2.0, 1.0), ("upright", 2.0, 3.0),
               ("flat", 1.0, 4.0), ("flat", 2.0, 4.0), ("gap", None, 1.0))
    got = {r.g: (r.slope, r.intercept, r.r_squared, r.n_locations)
           for r in least_squares(df, ["g"]).collect()}
    assert got["line"] == pytest.approx((2.0, 1.0, 1.0, 3))
    assert got["point"] == (None, None, None, 1)
    assert got["upright"] == (None, None, None, 2)
    assert got["flat"] == (0.0, 4.0, 1.0, 2)
    assert "gap" not in got
