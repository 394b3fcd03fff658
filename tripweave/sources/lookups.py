"""Lookup sources: keyed tables, origin-destination tables, matrices, and their catalogue."""

from __future__ import annotations

import os
import re
from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

KEYED, OD_TABLE, OD_MATRIX, AMBIGUOUS = "keyed_column", "od_table", "od_matrix", "ambiguous"
NO_DESTINATION = -1.0
TOKEN = re.compile(r"\{(\w+)\}")

# Header pairs that mark an origin-destination table.
OD_HEADERS = {
    ("origin", "destination"),
    ("otaz", "dtaz"),
    ("omaz", "dmaz"),
    ("orig", "dest"),
    ("from", "to"),
}


def read_ordered_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with column ``_order`` that follows the order of lines in the file."""
    df = spark.read.option("header", True).option("inferSchema", True).csv(path)
    order = F.struct(
        F.col("_metadata.file_path"),
        F.col("_metadata.file_block_start"),
        F.monotonically_increasing_id(),
    )
    return df.select("*", order.alias("_order"))


def last_value(df: DataFrame, keys: dict[str, str], values: Sequence[str], order: str) -> DataFrame:
    """Last non-null value per key in source order; keys compare as doubles."""
    keyed = df.select(
        *[F.col(f"`{c}`").cast("double").alias(k) for k, c in keys.items()],
        *[F.col(f"`{c}`").cast("double").alias(c) for c in values],
        F.col(order).alias("_order"),
    )
    for key in keys:
        keyed = keyed.filter(F.col(key).isNotNull())
    return keyed.groupBy(*keys).agg(
        *[
            F.max_by(F.col(f"`{c}`"), F.when(F.col(f"`{c}`").isNotNull(), F.col("_order"))).alias(c)
            for c in values
        ]
    )


def keyed_table(df: DataFrame, key: str, values: Sequence[str], order: str = "_order") -> DataFrame:
    return last_value(df, {"key": key}, values, order)


def od_table(
    df: DataFrame,
    origin: str,
    destination: str,
    values: Sequence[str],
    demand: DataFrame | None = None,
    order: str = "_order",
) -> DataFrame:
    """Values per zone pair. Only demanded pairs (o, d) are aggregated when given."""
    if demand is not None:
        pairs = demand.select(
            F.col("o").cast("double").alias("_do"), F.col("d").cast("double").alias("_dd")
        )
        df = df.join(
            pairs,
            (F.col(f"`{origin}`").cast("double") == F.col("_do"))
            & (F.col(f"`{destination}`").cast("double") == F.col("_dd")),
            "left_semi",
        )
    return last_value(df, {"o": origin, "d": destination}, values, order)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType)]


def is_od_header(columns: Sequence[str]) -> bool:
    if len(columns) < 3:
        return False
    first, second = ("".join(ch for ch in c.lower() if ch.isalnum()) for c in columns[:2])
    return (first, second) in OD_HEADERS


@dataclass(frozen=True)
class TableSource:
    """One lookup table: file name and its columns (a source order column aside)."""

    file: str
    df: DataFrame
    order: str = "_order"
    only: tuple[str, ...] | None = None

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c != self.order]

    @property
    def kind(self) -> str:
        return OD_TABLE if is_od_header(self.columns) else KEYED

    @property
    def key_columns(self) -> list[str]:
        return self.columns[: 2 if self.kind == OD_TABLE else 1]

    @property
    def value_columns(self) -> list[str]:
        numeric = numeric_columns(self.df)
        values = [c for c in self.columns if c in numeric and c not in self.key_columns]
        if not values:
            raise ValueError(f"{self.file}: no numeric value column")
        return values if self.only is None else [c for c in values if c in self.only]

    def matrix_name(self, column: str) -> str:
        return f"{os.path.splitext(self.file)[0]}__{column}"

    def long(self, columns: Sequence[str], demand: DataFrame | None = None) -> DataFrame:
        """(matrix_name, o, d, value) of the wanted value columns, missing values left out."""
        if self.kind == OD_TABLE:
            origin, destination = self.key_columns
            wide = od_table(self.df, origin, destination, columns, demand, self.order)
        else:
            wide = (
                keyed_table(self.df, self.key_columns[0], columns, self.order)
                .withColumnRenamed("key", "o")
                .withColumn("d", F.lit(NO_DESTINATION))
            )
        entries = F.array(
            *[
                F.struct(
                    F.lit(self.matrix_name(c)).alias("matrix_name"),
                    F.col(f"`{c}`").alias("value"),
                )
                for c in columns
            ]
        )
        return (
            wide.select("o", "d", F.explode(entries).alias("_e"))
            .select("_e.matrix_name", "o", "d", "_e.value")
            .filter(F.col("value").isNotNull())
        )


@dataclass(frozen=True)
class MatrixSource:
    """Matrices of one file as rows (matrix, o_idx, values array), optionally with a zone map.

    A matrix row stays an array; cells are taken from it by position.
    """

    file: str
    rows: DataFrame
    names: tuple[str, ...]
    size: int
    zone_map: DataFrame | None = None

    def ids(self) -> list[str]:
        return [f"{self.file}::{name}" for name in self.names]

    def named_rows(self) -> DataFrame:
        return self.rows.filter(F.col("matrix").isin(*self.names)).select(
            F.concat(F.lit(f"{self.file}::"), "matrix").alias("source_id"),
            F.col("o_idx").cast("double").alias("o_idx"),
            "values",
        )

    def zones(self, side: str) -> DataFrame:
        """Zone and index of the origins (o) or destinations (d)."""
        return self.zone_map.select(
            F.col("zone").cast("double").alias(side),
            F.col("idx").cast("double").alias(f"{side}_idx"),
        )

    def answers(self, demand: DataFrame) -> DataFrame:
        """(source_id, o, d, value) of the demanded cells that there are; an empty cell is NaN.

        The demand is gathered by matrix row (at most one entry a zone), so a row is picked once,
        rows nobody asks for stay where they are, and no cell is made that nobody asks for.
        """
        asked = demand.filter(F.col("source_id").isin(*self.ids()))
        for side in ("o", "d"):
            if self.zone_map is None:
                asked = asked.withColumn(f"{side}_idx", F.col(side))
            else:
                asked = asked.join(self.zones(side), side)
        wanted = asked.groupBy("source_id", "o_idx").agg(
            F.collect_list(F.struct("o", "d", "d_idx")).alias("_asked")
        )
        at, size = F.col("_e.d_idx"), F.size("values")
        inside = (at >= 0) & (at < size) & (at == F.floor(at))
        cell = F.coalesce(
            F.get("values", F.when(inside, at).otherwise(0).cast("int")).cast("double"),
            F.lit(float("nan")),
        )
        return (
            self.named_rows()
            .join(wanted, ["source_id", "o_idx"])
            .select("source_id", "values", F.explode("_asked").alias("_e"))
            .filter(inside)
            .select("source_id", F.col("_e.o").alias("o"), F.col("_e.d").alias("d"), cell.alias("value"))
        )

    def all_cells(self) -> DataFrame:
        """(source_id, o, d, value) of every cell."""
        cells = self.named_rows().select(
            "source_id", "o_idx", F.posexplode("values").alias("d_idx", "value")
        )
        cells = cells.withColumn("d_idx", F.col("d_idx").cast("double"))
        for side in ("o", "d"):
            if self.zone_map is None:
                cells = cells.withColumnRenamed(f"{side}_idx", side)
            else:
                cells = cells.join(self.zones(side), f"{side}_idx")
        value = F.coalesce(F.col("value").cast("double"), F.lit(float("nan")))
        return cells.select("source_id", "o", "d", value.alias("value"))


@dataclass(frozen=True)
class LookupSources:
    """Everything a rule can look up: a catalogue of names and one long value table."""

    spark: SparkSession
    tables: tuple[TableSource, ...] = ()
    matrices: tuple[MatrixSource, ...] = ()

    def referenced_by(self, templates: Sequence[str]) -> "LookupSources":
        """Only the value columns and matrices a matrix template can name."""
        patterns = [
            re.compile(".+".join(map(re.escape, TOKEN.split(t)[::2]))) for t in templates
        ]

        def used(file: str, name: str) -> bool:
            return any(p.fullmatch(name) or p.fullmatch(f"{file}::{name}") for p in patterns)

        tables = [
            replace(
                t, only=tuple(c for c in t.value_columns if used(t.file, t.matrix_name(c)))
            )
            for t in self.tables
        ]
        matrices = [
            replace(m, names=tuple(n for n in m.names if used(m.file, n))) for m in self.matrices
        ]
        return replace(
            self,
            tables=tuple(t for t in tables if t.only),
            matrices=tuple(m for m in matrices if m.names),
        )

    def records(self) -> list[tuple[str, str, str, int]]:
        """(name, qualified name, kind, size) of every value column and matrix."""
        rows = [
            (t.matrix_name(c), f"{t.file}::{t.matrix_name(c)}", t.kind, 0)
            for t in self.tables
            for c in t.value_columns
        ]
        for m in self.matrices:
            kind = OD_TABLE if m.zone_map is not None else OD_MATRIX
            rows += [(name, f"{m.file}::{name}", kind, m.size) for name in m.names]
        return rows

    def catalogue(self) -> DataFrame:
        """One row per usable reference; a name two files share is ambiguous unless qualified."""
        records = self.records()
        seen: dict[str, list[str]] = {}
        for name, qualified, _, _ in records:
            seen.setdefault(name, []).append(qualified)
        rows = [(q, q, kind, size, None) for _, q, kind, size in records]
        rows += [(n, q, kind, size, None) for n, q, kind, size in records if len(seen[n]) == 1]
        rows += [
            (name, None, AMBIGUOUS, 0, ", ".join(sorted(files)))
            for name, files in seen.items()
            if len(files) > 1
        ]
        return self.spark.createDataFrame(
            rows,
            "matrix_name string, source_id string, source_kind string, size int, "
            "ambiguous_sources string",
        )

    def _table_values(self, table: TableSource, demand: DataFrame | None) -> DataFrame:
        if demand is not None:
            ids = [f"{table.file}::{table.matrix_name(c)}" for c in table.value_columns]
            demand = demand.filter(F.col("source_id").isin(*ids)).select("o", "d").distinct()
        long = table.long(table.value_columns, demand if table.kind == OD_TABLE else None)
        return long.select(
            F.concat(F.lit(f"{table.file}::"), "matrix_name").alias("source_id"), "o", "d", "value"
        )

    def answers(self, demand: DataFrame) -> DataFrame:
        """(source_id, o, d, value) for a demand (source_id, o, d) of distinct rows.

        Keyed tables give all their keys, zone-pair tables the demanded pairs, matrices the
        demanded cells. Origins and destinations of a matrix without zone map are its indices.
        """
        parts = [self._table_values(t, demand) for t in self.tables]
        return self._together(parts + [m.answers(demand) for m in self.matrices])

    def values(self) -> DataFrame:
        """(source_id, o, d, value) of everything; matrix cells that are empty keep a NaN value."""
        parts = [self._table_values(t, None) for t in self.tables]
        return self._together(parts + [m.all_cells() for m in self.matrices])

    def _together(self, parts: list[DataFrame]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame(
                [], "source_id string, o double, d double, value double"
            )
        return reduce(DataFrame.unionByName, parts)
