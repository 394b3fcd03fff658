"""Externally supplied validation tables forced to their declared contracts.

The supplied tables are aggregates of the star-schema tables with other column types and order.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tripweave.plans.registry import get_summary
from tripweave.plans.summaries.external_contracts import EXTERNAL_SCHEMAS
from tripweave.sources import star, tables
from workload.context import Context, Registry

registry = Registry()
queries, oracle_sql = registry.queries, registry.oracle_sql

DERIVED = (
    "count_location_counts_validation_summary",
    "count_location_volumes_validation_summary",
    "count_location_scatter_validation_summary",
    "count_location_fit_validation_summary",
)


def expressions(schema: str) -> tuple[list[str], dict[str, str]]:
    """Group columns and aggregate columns of a supplied table, as SQL text."""
    groups: list[str] = []
    columns: dict[str, str] = {}
    for i, part in enumerate(schema.split(", ")):
        name, kind = part.split(" ")
        if kind == "double":
            columns[name] = f"CAST(SUM(l_quantity * {i}) AS DECIMAL(18, 1))"
        elif kind == "string":
            columns[name] = "'P' || CAST(l_linenumber AS STRING)"
            groups.append("l_linenumber")
        else:
            columns[name] = f"l_suppkey + {i}"
            groups.append("l_suppkey")
    return list(dict.fromkeys(groups)), columns


def _register(summary_id: str, schema: str) -> None:
    groups, columns = expressions(schema)
    selected = ", ".join(f'{e} AS "{n}"' for n, e in columns.items())
    sql = f"SELECT {selected} FROM lineitem GROUP BY {', '.join(groups)}"

    @registry.add(f"external_{summary_id}", schema, sql)
    def supplied(ctx: Context):
        aggregates = {n: e for n, e in columns.items() if "SUM(" in e}
        keys = {n: e for n, e in columns.items() if n not in aggregates}
        table = (
            ctx.tables["lineitem"]
            .groupBy(*groups)
            .agg(*[F.expr(e).alias(n) for n, e in reversed(aggregates.items())])
            .select(*aggregates, *[F.expr(e).alias(n) for n, e in keys.items()])
        )
        return tables.external_summary(table, summary_id)


for _id, _schema in EXTERNAL_SCHEMAS.items():
    if _id not in DERIVED:
        _register(_id, _schema)


@registry.add(
    "external_overlay_with_derived_fit",
    "summary_id string, n bigint",
    "SELECT 'count_location_counts_validation_summary' AS summary_id, COUNT(*) AS n FROM counts UNION "
    "ALL SELECT 'count_location_volumes_validation_summary', COUNT(*) FROM volumes UNION ALL SELECT "
    "'household_size_distribution', COUNT(DISTINCT FACTYPE) FROM counts UNION ALL SELECT "
    "'count_location_scatter_validation_summary', (SELECT COUNT(*) FROM counts c JOIN volumes v USING "
    "(id) WHERE c.FACTYPE = v.FACTYPE AND c.am_vol IS NOT NULL) + (SELECT COUNT(*) FROM counts c JOIN "
    "volumes v USING (id) WHERE c.FACTYPE = v.FACTYPE AND c.md_vol IS NOT NULL) + (SELECT 2 * COUNT(*) "
    "FROM counts c JOIN volumes v USING (id) WHERE c.FACTYPE = v.FACTYPE)",
)
def overlay(ctx: Context):
    """An outside table replaces a generated one, and the fits follow from counts and volumes."""
    counts, volumes = star.count_tables(ctx.tables)
    sizes = counts.groupBy(F.col("FACTYPE").alias("household_size")).agg(
        F.sum("am_vol").alias("household_count")
    )
    external = {
        ("weighted", "count_location_counts_validation_summary"): tables.external_summary(
            counts, "count_location_counts_validation_summary"
        ),
        ("weighted", "count_location_volumes_validation_summary"): tables.external_summary(
            volumes, "count_location_volumes_validation_summary"
        ),
        ("weighted", "household_size_distribution"): tables.external_summary(
            sizes, "household_size_distribution"
        ),
    }
    generated = {
        ("weighted", "household_size_distribution"): get_summary(
            "household_size_distribution"
        ).build(ctx.run, star.CONFIG)
    }
    merged = tables.overlay_summaries(generated, external)
    parts = [
        df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(sid).alias("summary_id"), "n")
        for (_, sid), df in merged.items()
        if sid != "count_location_fit_validation_summary"
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
