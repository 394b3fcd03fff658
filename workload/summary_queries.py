"""One query per summary table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from oracle.star_sql import with_query
from oracle.summaries_sql import SUMMARY_SQL, VALIDATION_SQL
from tripweave.plans.registry import get_summary
from tripweave.sources import star
from workload.shape import rounded, shaped_sql


def _query(summary_id: str, with_validation: bool):
    def run_query(spark: SparkSession, directory: str) -> DataFrame:
        tables = star.load(spark, directory)
        run = star.build_run(tables)
        if with_validation:
            run = star.add_validation_tables(run, tables)
        return rounded(get_summary(summary_id).build(run, star.CONFIG, spark))

    return run_query


def queries() -> dict:
    return {
        f"summary_{name}": _query(name, name in VALIDATION_SQL)
        for name in (*SUMMARY_SQL, *VALIDATION_SQL)
    }


def oracle_sql() -> dict[str, str]:
    return {
        f"summary_{name}": with_query(shaped_sql(body, get_summary(name).schema))
        for name, body in {**SUMMARY_SQL, **VALIDATION_SQL}.items()
    }
