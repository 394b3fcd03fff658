"""Weighted statistics and distributions of lookup components by mode."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tripweave.model import Config, Run
from tripweave.operators.weighted_stats import weighted_ecdf, weighted_statistics
from tripweave.plans.registry import summary
from tripweave.sources.lineage import cut_lineage

ALL_MODES = "All Modes"
CHOSEN = "chosen_mode"
ALL_RECORDS = "all_records"


def component_columns(df: DataFrame) -> list[str]:
    """Numeric columns produced by a lookup."""
    return [
        f.name for f in df.schema if "skim_" in f.name and isinstance(f.dataType, NumericType)
    ]


def chosen_frequencies(df: DataFrame | None, mode: str) -> DataFrame | None:
    """Weight per mode, component and value, with All Modes over the pertinent modes.

    A mode is pertinent to a component when it has at least one value of it. Rows are
    aggregated to distinct values before anything is totalled or ordered.
    """
    if df is None or not {mode, "finalweight"} <= set(df.columns):
        return None
    components = component_columns(df)
    if not components:
        return None
    values = F.array(
        *[
            F.struct(
                F.lit(name).alias("component"), F.col(f"`{name}`").cast("double").alias("value")
            )
            for name in components
        ]
    )
    detail = (
        df.filter(F.col(mode).isNotNull())
        .select(
            F.col(mode).cast("string").alias("mode"),
            F.col("finalweight").cast("double").alias("w"),
            F.explode(values).alias("_v"),
        )
        .groupBy("mode", F.col("_v.component").alias("component"), F.col("_v.value").alias("value"))
        .agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n"))
    )
    # Everything below reads this aggregate several times; the records are scanned once.
    detail = cut_lineage(detail)
    pertinent = (
        detail.filter(F.col("value").isNotNull()).select("mode", "component").distinct()
    )
    overall = (
        detail.join(pertinent, ["mode", "component"], "left_semi")
        .groupBy("component", "value")
        .agg(F.sum("w").alias("w"), F.sum("n").alias("n"))
        .withColumn("mode", F.lit(ALL_MODES))
    )
    # A component nobody has a value of still gets an All Modes row with zero totals.
    idle = (
        detail.groupBy("component")
        .agg(F.count("value").alias("_valid"))
        .filter("_valid = 0")
        .select(
            F.lit(ALL_MODES).alias("mode"),
            "component",
            F.lit(None).cast("double").alias("value"),
            F.lit(0.0).alias("w"),
            F.lit(0).cast("bigint").alias("n"),
        )
    )
    return detail.unionByName(overall).unionByName(idle)


def sidecar_frequencies(sidecar: DataFrame | None) -> DataFrame | None:
    needed = {"hypothetical_mode", "component", "value", "finalweight"}
    if sidecar is None or not needed <= set(sidecar.columns):
        return None
    return cut_lineage(
        sidecar.groupBy(
            F.col("hypothetical_mode").cast("string").alias("mode"),
            F.col("component").cast("string").alias("component"),
            F.col("value").cast("double").alias("value"),
        )
        .agg(
            F.sum(F.col("finalweight").cast("double")).alias("w"),
            F.count(F.lit(1)).alias("n"),
        )
    )


def _by_scenario(df: DataFrame | None, sidecar: DataFrame | None, mode: str, compute):
    parts = []
    for scenario, frequencies in (
        (CHOSEN, chosen_frequencies(df, mode)),
        (ALL_RECORDS, sidecar_frequencies(sidecar)),
    ):
        if frequencies is not None:
            parts.append(
                compute(frequencies, ["mode", "component"])
                .withColumn("skim_scenario", F.lit(scenario))
                .withColumnRenamed("mode", mode)
            )
    if not parts:
        return None
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _stats(frequencies: DataFrame, keys: list[str]) -> DataFrame:
    return weighted_statistics(frequencies, keys).withColumnRenamed("mode_value", "_mode_value")


def _stats_by_scenario(df, sidecar, mode):
    result = _by_scenario(df, sidecar, mode, _stats)
    return None if result is None else result.withColumnRenamed("_mode_value", "mode")


def _register(table: str, mode: str, sidecar: str) -> None:
    prefix = "trip" if table == "trips" else "tour"

    @summary(
        f"skimjoin_{prefix}_component_stats",
        f"skim_scenario string, {mode} string, component string, n_total double, "
        "n_valid double, mean double, mean_nonzero double, std double, min double, max double, "
        "median double, mode double, zero_share double, missing_share double",
        {table: f"{mode} finalweight"},
    )
    def stats(run: Run, config: Config) -> DataFrame | None:
        return _stats_by_scenario(run.tables.get(table), run.tables.get(sidecar), mode)

    @summary(
        f"skimjoin_{prefix}_component_ecdf",
        f"skim_scenario string, {mode} string, component string, percentile double, "
        "value double, n_valid double",
        {table: f"{mode} finalweight"},
        build_by_default=False,
    )
    def ecdf(run: Run, config: Config) -> DataFrame | None:
        return _by_scenario(run.tables.get(table), run.tables.get(sidecar), mode, weighted_ecdf)


_register("trips", "trip_mode", "trip_hypothetical_skims")
_register("tours", "tour_mode", "tour_hypothetical_skims")
