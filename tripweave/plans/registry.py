"""Summary registry: declared inputs, output contract, and the builder function."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tripweave.model import Config, Run
from tripweave.schemas import schema_of


class SummaryContractError(ValueError):
    """A summary table does not match its declared columns."""


@dataclass(frozen=True)
class SummaryDefinition:
    summary_id: str
    schema: StructType
    required: dict[str, tuple[str, ...]]
    builder: Callable[[Run, Config], DataFrame | None]
    build_by_default: bool = True

    @property
    def columns(self) -> list[str]:
        return self.schema.fieldNames()

    def missing_inputs(self, run: Run) -> dict[str, str]:
        """Tables or columns this summary needs and the run lacks."""
        missing = {}
        for table, columns in self.required.items():
            frame = run.tables.get(table)
            if frame is None:
                missing[table] = "required table is unavailable"
                continue
            absent = sorted(set(columns) - set(frame.columns))
            if absent:
                missing[table] = "missing required columns: " + ", ".join(absent)
        return missing

    def empty(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([], self.schema)

    def conform(self, df: DataFrame) -> DataFrame:
        """Exact declared columns, order and types; other columns are an error."""
        problems = column_problems(df, self.schema)
        if problems:
            raise SummaryContractError(f"summary {self.summary_id!r}: {problems}")
        return df.select(
            *[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.schema]
        )

    def build(self, run: Run, config: Config, spark: SparkSession | None = None) -> DataFrame:
        """The summary as a lazy DataFrame; a typed empty one when inputs are missing."""
        spark = spark or session_of(run)
        if self.missing_inputs(run):
            return self.empty(spark)
        result = self.builder(run, config)
        return self.empty(spark) if result is None else self.conform(result)


SUMMARIES: dict[str, SummaryDefinition] = {}


def summary(
    summary_id: str,
    schema: str,
    requires: dict[str, str] | None = None,
    build_by_default: bool = True,
):
    """Register a builder ``f(run, config) -> DataFrame`` under a summary id.

    ``schema`` is a DDL string, ``requires`` maps a table to its blank-separated columns.
    """

    def decorate(builder):
        definition = SummaryDefinition(
            summary_id=summary_id,
            schema=schema_of(schema),
            required={t: tuple(c.split()) for t, c in (requires or {}).items()},
            builder=builder,
            build_by_default=build_by_default,
        )
        SUMMARIES[summary_id] = definition
        return builder

    return decorate


def get_summary(summary_id: str) -> SummaryDefinition:
    import tripweave.plans.summaries  # noqa: F401  (fills the registry)

    if summary_id not in SUMMARIES:
        raise KeyError(f"unknown summary id: {summary_id}")
    return SUMMARIES[summary_id]


def summary_ids(default_only: bool = False) -> list[str]:
    import tripweave.plans.summaries  # noqa: F401

    return [k for k, d in SUMMARIES.items() if d.build_by_default or not default_only]


def session_of(run: Run) -> SparkSession:
    for frame in run.tables.values():
        if frame is not None:
            return frame.sparkSession
    return SparkSession.getActiveSession()


def column_problems(df: DataFrame, schema: StructType) -> str:
    """Missing and unexpected columns, as text; empty when the column set matches."""
    expected, actual = set(schema.fieldNames()), set(df.columns)
    parts = []
    if expected - actual:
        parts.append("missing columns: " + ", ".join(sorted(expected - actual)))
    if actual - expected:
        parts.append("unexpected columns: " + ", ".join(sorted(actual - expected)))
    return "; ".join(parts)


def contract_violations(df: DataFrame, definition: SummaryDefinition) -> list[str]:
    """Strict check of column set, order and types against the declaration."""
    problems = column_problems(df, definition.schema)
    if problems:
        return [problems]
    if df.columns != definition.columns:
        return [f"wrong column order: {df.columns}"]
    return [
        f"{field.name}: expected {field.dataType.simpleString()}, "
        f"got {df.schema[field.name].dataType.simpleString()}"
        for field in definition.schema
        if df.schema[field.name].dataType != field.dataType
    ]
