"""What a query function gets: the source tables and the runs built from them, lazily."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tripweave.schemas import schema_of

from oracle.star_sql import with_query
from tripweave.sources import star, star_raw
from workload.shape import rounded, shaped_sql


class Context:
    def __init__(self, spark: SparkSession, directory: str):
        self.spark = spark
        self.tables = star.load(spark, directory)

    @cached_property
    def run(self):
        return star.build_run(self.tables)

    @cached_property
    def raw(self):
        return star_raw.raw_run(self.tables)

    @cached_property
    def raw_config(self):
        return star_raw.config(self.tables)


@dataclass(frozen=True)
class Query:
    name: str
    schema: str
    build: Callable[[Context], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, directory: str) -> DataFrame:
        df = self.build(Context(spark, directory))
        fields = schema_of(self.schema)
        return rounded(
            df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in fields])
        )


class Registry:
    """Collects the queries of one module."""

    def __init__(self, extra_expressions: dict[str, str] | None = None):
        self.items: dict[str, Query] = {}
        self.extra = extra_expressions or {}

    def add(self, name: str, schema: str, sql: str | None):
        def decorate(build):
            self.items[name] = Query(name, schema, build, sql)
            return build

        return decorate

    def queries(self) -> dict:
        return {name: query.run for name, query in self.items.items()}

    def oracle_sql(self) -> dict[str, str]:
        return {
            name: with_query(shaped_sql(q.sql, q.schema), self.extra)
            for name, q in self.items.items()
            if q.sql is not None
        }
