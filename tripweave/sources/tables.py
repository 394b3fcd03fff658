"""Reading run tables and external summaries; writing tables, summaries and the ledger."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from tripweave.schemas import schema_of

from tripweave.model import TABLES, Run
from tripweave.operators.aggregate import smallest_values
from tripweave.plans.registry import SummaryContractError, column_problems, get_summary

AVAILABLE, EMPTY, UNAVAILABLE, FAILED = "available", "empty", "unavailable", "failed"
CORE_TABLES = ("hh", "per", "tours", "trips")
DEFAULT_STEMS = {
    "hh": "final_households",
    "per": "final_persons",
    "day": "day",
    "tours": "final_tours",
    "trips": "final_trips",
    "vehicles": "final_vehicles",
    "joint_participants": "final_joint_tour_participants",
    "land_use": "final_land_use",
}
LEDGER = "run string, kind string, id string, state string, detail string"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in its file system (local, HDFS or object store)."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet or CSV table by its extension; CSV types are inferred from the whole file."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    if path.endswith(".csv"):
        return spark.read.option("header", True).option("inferSchema", True).csv(path)
    raise ValueError(f"table path must end with .csv or .parquet: {path}")


def read_run(
    spark: SparkSession,
    folder: str,
    label: str,
    stems: dict[str, str] | None = None,
    fallbacks: dict[str, str] | None = None,
) -> Run:
    """The raw tables of one run: Parquet first, then CSV, then the table's fallback file.

    A missing table is recorded as unavailable; it never stops the run.
    """
    stems, fallbacks = {**DEFAULT_STEMS, **(stems or {})}, fallbacks or {}
    tables: dict[str, DataFrame | None] = {}
    states: dict[str, tuple[str, str]] = {}
    for name in TABLES:
        paths = [f"{folder}/{stems[name]}.parquet", f"{folder}/{stems[name]}.csv"]
        if name in fallbacks:
            paths.append(fallbacks[name])
        found = next((p for p in paths if exists(spark, p)), None)
        if found is None:
            tables[name] = None
            states[name] = (UNAVAILABLE, f"no file {stems[name]}.parquet or .csv in {folder}")
            continue
        try:
            tables[name] = read_table(spark, found)
            states[name] = (AVAILABLE, "")
        except AnalysisException as error:
            tables[name] = None
            states[name] = (FAILED, str(error).splitlines()[0])
    return Run(label, tables, states)


def read_prepared(spark: SparkSession, paths: dict[str, str], label: str) -> Run:
    """Prepared tables supplied by the caller; nothing is derived from them."""
    tables: dict[str, DataFrame | None] = {}
    states: dict[str, tuple[str, str]] = {}
    for name in TABLES:
        tables[name] = None
        if name not in paths:
            missing = EMPTY if name in CORE_TABLES else UNAVAILABLE
            states[name] = (missing, "not supplied")
            continue
        try:
            tables[name] = read_table(spark, paths[name])
            states[name] = (AVAILABLE, "")
        except (AnalysisException, ValueError) as error:
            states[name] = (FAILED, str(error).splitlines()[0])
    return Run(label, tables, states)


# --- external summaries ------------------------------------------------------------------------


def external_summary(df: DataFrame, summary_id: str) -> DataFrame:
    """An outside table in the declared columns, order and types of a summary."""
    definition = get_summary(summary_id)
    problems = column_problems(df, definition.schema)
    if problems:
        raise SummaryContractError(f"external summary {summary_id!r}: {problems}")
    return definition.conform(df)


def load_external_summaries(
    spark: SparkSession, paths: dict[str, str], modes: Iterable[str]
) -> dict[tuple[str, str], DataFrame]:
    """(weighting mode, summary id) to table; outside tables are the same in every mode."""
    loaded = {sid: external_summary(read_table(spark, p), sid) for sid, p in paths.items()}
    return {(mode, sid): df for mode in modes for sid, df in loaded.items()}


def overlay_summaries(
    generated: dict[tuple[str, str], DataFrame], external: dict[tuple[str, str], DataFrame]
) -> dict[tuple[str, str], DataFrame]:
    """Generated summaries with outside tables in their place where given, plus derived fits."""
    from tripweave.operators.quality import count_fit, count_scatter

    merged = {**generated, **external}
    for mode in sorted({mode for mode, _ in merged}):
        counts = merged.get((mode, "count_location_counts_validation_summary"))
        volumes = merged.get((mode, "count_location_volumes_validation_summary"))
        if counts is None or volumes is None:
            continue
        scatter = count_scatter(counts, volumes)
        for sid, df in (
            ("count_location_scatter_validation_summary", scatter),
            ("count_location_fit_validation_summary", count_fit(scatter)),
        ):
            merged[mode, sid] = get_summary(sid).conform(df)
    return merged


# --- writing -----------------------------------------------------------------------------------


def write_tables(run: Run, folder: str, file_format: str = "parquet") -> list[str]:
    """Write every present table; returns their paths."""
    written = []
    for name, df in run.tables.items():
        if df is None:
            continue
        path = f"{folder}/{name}.{file_format}"
        writer = df.write.mode("overwrite")
        if file_format == "csv":
            writer.option("header", True).csv(path)
        else:
            writer.format(file_format).save(path)
        written.append(path)
    return written


PARTITIONS = ("run", "segmentation_type", "segment_id", "weighting_mode")


def publish(spark: SparkSession, finished: str, path: str) -> None:
    """Put a finished folder in its place by one rename; what was there before is replaced whole."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    source, target = hadoop(finished), hadoop(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(target.getParent())
    if files.exists(target):
        files.delete(target, True)
    if not files.rename(source, target):
        raise OSError(f"cannot rename {finished} to {path}")


def write_counted(df: DataFrame, path: str, file_format: str = "parquet") -> int:
    """Write a table and return its rows, counted by the write itself.

    The rows go to a folder beside the target that is renamed when it is complete, so a write that
    breaks leaves what was there, and a repeated one leaves no parts of both.
    """
    spark = df.sparkSession
    parent, name = path.rsplit("/", 1)
    unfinished = f"{parent}/_unfinished-{name.replace('=', '-')}-{uuid.uuid4().hex}"
    written = Observation()
    writer = df.observe(written, F.count(F.lit(1)).alias("rows")).write
    try:
        if file_format == "csv":
            writer.option("header", True).csv(unfinished)
        else:
            writer.format(file_format).save(unfinished)
    except Exception:
        folder = spark._jvm.org.apache.hadoop.fs.Path(unfinished)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        raise
    publish(spark, unfinished, path)
    return written.get["rows"]


def summary_path(
    folder: str, summary_id: str, run: str, mode: str, segmentation: str = "full", segment: str = "full"
) -> str:
    return (
        f"{folder}/{summary_id}/run={run}/segmentation_type={segmentation}/"
        f"segment_id={segment}/weighting_mode={mode}"
    )


def store_summary(df: DataFrame, path: str, file_format: str = "parquet") -> int:
    """One summary, sorted, under its path; returns its rows."""
    keys = [f.name for f in df.schema if f.dataType.simpleString() != "double"]
    return write_counted(df.orderBy(*keys), path, file_format)


def write_summary(
    df: DataFrame,
    folder: str,
    summary_id: str,
    run: str,
    mode: str,
    segmentation: str = "full",
    segment: str = "full",
    file_format: str = "parquet",
) -> str:
    """One summary of one run, segment and mode, sorted, under its partition folders."""
    path = summary_path(folder, summary_id, run, mode, segmentation, segment)
    store_summary(df, path, file_format)
    return path


def read_summary(spark: SparkSession, folder: str, summary_id: str) -> DataFrame:
    """A stored summary of all runs, segments and modes, with the partition columns."""
    return spark.read.option("basePath", f"{folder}/{summary_id}").parquet(
        f"{folder}/{summary_id}/*/*/*/*"
    )


def ledger(spark: SparkSession, run: Run, summaries: dict[str, tuple[str, str]]) -> DataFrame:
    """State and reason of every table and summary of a run."""
    rows = [(run.label, "table", name, *state) for name, state in run.states.items()]
    rows += [(run.label, "summary", sid, *state) for sid, state in summaries.items()]
    return spark.createDataFrame(rows, LEDGER)


def summary_state(rows: int, missing: dict[str, str]) -> tuple[str, str]:
    """State and reason of a stored summary, from the rows that its write counted."""
    if missing:
        return UNAVAILABLE, "; ".join(f"{t} ({why})" for t, why in sorted(missing.items()))
    return (EMPTY if rows == 0 else AVAILABLE), ""


# --- profiles ----------------------------------------------------------------------------------

FIRST_VALUES = 5


def table_profile(df: DataFrame, first_values: int = FIRST_VALUES) -> DataFrame:
    """Per column: type, number of distinct values, and the smallest values as text.

    first_values: how many values are listed; distinct values are counted over all rows.
    """
    entries = F.array(
        *[
            F.struct(
                F.lit(f.name).alias("column"),
                F.lit(f.dataType.simpleString()).alias("type"),
                F.col(f"`{f.name}`").cast("string").alias("value"),
            )
            for f in df.schema
        ]
    )
    values = df.select(F.explode(entries).alias("_e")).select("_e.*").distinct()
    counts = values.groupBy("column", "type").agg(F.count("value").alias("distinct_values"))
    shown = smallest_values(values, "column", "value", first_values)
    return counts.join(shown, "column", "left").select(
        "column",
        "type",
        "distinct_values",
        F.array_join("smallest", "|").alias("first_values"),
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Records per value of a category column."""
    return df.groupBy(F.col(column).cast("string").alias("value")).agg(
        F.count(F.lit(1)).alias("records")
    )


def empty_table(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema_of(schema))
