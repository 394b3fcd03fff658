"""Zones, geographies and origin-destination values."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripweave.model import Config, label_column


NULL_PARTS = 1024


def unique_lookup(df: DataFrame, key: str, value: str) -> DataFrame:
    """One value per key: the smallest, so the choice does not depend on row order."""
    return (
        df.filter(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("_key"))
        .agg(F.min(value).alias("_value"))
    )


def null_spread(df: DataFrame, *keys: str) -> Column:
    """A second join key that deals rows with a null key over many tasks; 0 for all others.

    A null key matches nothing, but a shuffled join would send all such rows to one task.
    """
    ids = [F.col(f"`{c}`") for c in df.columns if c.endswith("_id")]
    if not ids:
        return F.lit(0).cast("bigint")
    absent = F.lit(False)
    for key in keys:
        absent = absent | F.col(key).isNull()
    return F.when(absent, 1 + F.pmod(F.xxhash64(*ids), F.lit(NULL_PARTS))).otherwise(0)


def matched_spread(*keys: str) -> Column:
    """The other side of ``null_spread``: always 0, but not a constant the optimizer would drop."""
    return F.pmod(F.xxhash64(*keys), F.lit(1)).alias("_spread")


def attach(df: DataFrame, lookup: DataFrame, key: str, output: str) -> DataFrame:
    """Left join of a (``_key``, ``_value``) lookup; small lookups broadcast by their size."""
    if output == key:
        return df
    renamed = lookup.select(
        F.col("_key").alias(key), F.col("_value").alias(output), matched_spread("_key")
    )
    spread = df.drop(output).withColumn("_spread", null_spread(df, key))
    return spread.join(renamed, [key, "_spread"], "left").drop("_spread")


def to_taz(df: DataFrame, zone: str, output: str, land_use: DataFrame, config: Config) -> DataFrame:
    """Coarse zone of a fine zone column, or a copy when the model has coarse zones only."""
    if zone not in df.columns:
        return df
    if not config.use_maz:
        return df.withColumn(output, F.col(zone))
    maz = next((c for c in config.candidates("maz") if c in land_use.columns), None)
    taz = next((c for c in config.candidates("taz") if c in land_use.columns), None)
    if maz is None or taz is None:
        return df.withColumn(output, F.lit(None).cast("bigint"))
    return attach(df, unique_lookup(land_use, maz, taz), zone, output)


def add_geography(
    df: DataFrame, taz: str, output: str, land_use: DataFrame, config: Config
) -> DataFrame:
    """Label of a zone from the configured land-use column."""
    label = config.geography_column
    keys = config.candidates("taz" if config.use_maz else "maz")
    key = next((c for c in keys if c in land_use.columns), None)
    if label is None or label not in land_use.columns or key is None or taz not in df.columns:
        return df
    named = land_use.withColumn("_label", label_column(F.col(label), config.geography_labels))
    return attach(df, unique_lookup(named, key, "_label"), taz, output)


def add_configured_geographies(
    df: DataFrame, role: str, maz: str, taz: str, config: Config
) -> DataFrame:
    """One ``<role>_geo__<name>`` column per configured zone grouping."""
    for aggregation in config.geographies:
        zone = maz if aggregation.source_zone_system == "maz" else taz
        if aggregation.lookup is None or zone not in df.columns:
            continue
        lookup = aggregation.lookup.select(
            F.col("zone").alias("_key"), F.col("label").alias("_value")
        )
        df = attach(df, lookup, zone, f"{role}_geo__{aggregation.name}")
    return df


@dataclass(frozen=True)
class Skim:
    """Origin-destination values in long form, by matrix index.

    ``values`` has ``o_idx``, ``d_idx`` and ``value``. With a ``zone_map`` (zone, idx) zones
    are looked up through it; without one, zone numbers are indices from 0 when every zone
    fits and a zone 0 occurs, else from 1.
    """

    values: DataFrame
    size: int
    zone_map: DataFrame | None = None
    offset: int | None = None

    def for_zones(self, zones: DataFrame, column: str) -> "Skim":
        """Fix the index rule once from the zone system, instead of per looked-up table."""
        if self.zone_map is not None or self.offset is not None:
            return self
        row = index_offset(zones, column, column, self.size).first()
        return replace(self, offset=int(row["offset"]))

    def by_zone(self) -> DataFrame:
        """(o_zone, d_zone, value) through the zone map."""
        origin = self.zone_map.select(F.col("zone").alias("o_zone"), F.col("idx").alias("o_idx"))
        destination = self.zone_map.select(
            F.col("zone").alias("d_zone"), F.col("idx").alias("d_idx")
        )
        return (
            self.values.join(origin, "o_idx")
            .join(destination, "d_idx")
            .select("o_zone", "d_zone", "value")
        )


def explode_matrix(rows: DataFrame) -> DataFrame:
    """Matrix rows (matrix, o_idx, values array) as long (matrix, o_idx, d_idx, value)."""
    return rows.select("matrix", "o_idx", F.posexplode("values").alias("d_idx", "value"))


def index_offset(df: DataFrame, origin: str, destination: str, size: int) -> DataFrame:
    """One row: 0 when zones are 0-based matrix indices, else 1."""
    o, d = F.col(origin).cast("bigint"), F.col(destination).cast("bigint")
    usable = df.filter(o.isNotNull() & d.isNotNull())
    zero_based = (
        (F.min(o) >= 0)
        & (F.min(d) >= 0)
        & (F.max(o) < size)
        & (F.max(d) < size)
        & (F.count_if((o == 0) | (d == 0)) > 0)
    )
    return usable.agg(F.when(zero_based, 0).otherwise(1).cast("bigint").alias("offset"))


def add_skim_value(
    df: DataFrame, skim: Skim, origin: str, destination: str, output: str
) -> DataFrame:
    """Matrix value of a zone pair; outside the matrix or missing gives null."""
    o, d = F.col(origin).cast("bigint"), F.col(destination).cast("bigint")
    if skim.zone_map is not None:
        table = skim.by_zone()
        keyed = df.withColumn("_o", o).withColumn("_d", d)
    else:
        table = skim.values.select(
            F.col("o_idx").cast("bigint").alias("o_zone"),
            F.col("d_idx").cast("bigint").alias("d_zone"),
            "value",
        )
        offset = (
            index_offset(df, origin, destination, skim.size).scalar()
            if skim.offset is None
            else F.lit(skim.offset)
        )
        keyed = df.withColumn("_o", o - offset).withColumn("_d", d - offset)
    value = F.col("value").cast("double")
    looked_up = table.select(
        F.col("o_zone").alias("_o"),
        F.col("d_zone").alias("_d"),
        F.when(~F.isnan(value), value).alias("_skim_value"),
        matched_spread("o_zone", "d_zone"),
    )
    return (
        keyed.withColumn("_spread", null_spread(keyed, "_o", "_d"))
        .join(looked_up, ["_o", "_d", "_spread"], "left")
        .withColumn(output, F.col("_skim_value"))
        .drop("_o", "_d", "_spread", "_skim_value")
    )


def unresolved_report(df: DataFrame, metrics: dict[str, tuple[tuple[str, ...], str]]) -> DataFrame:
    """Per metric: rows with all source columns present, and those whose output is missing.

    ``metrics`` maps a metric id to (source columns, output column). One pass per table.
    """
    aggregates = []
    for i, (sources, output) in enumerate(metrics.values()):
        present = F.lit(True)
        for source in sources:
            present = present & F.col(source).isNotNull()
        aggregates.append(F.count_if(present).alias(f"t{i}"))
        aggregates.append(F.count_if(present & F.col(output).isNull()).alias(f"u{i}"))
    counts = df.agg(*aggregates)
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("metric_id"),
                F.col(f"t{i}").alias("total"),
                F.col(f"u{i}").alias("unresolved"),
                F.when(F.col(f"t{i}") > 0, F.col(f"u{i}") / F.col(f"t{i}")).alias(
                    "unresolved_share"
                ),
            )
            for i, name in enumerate(metrics)
        ]
    )
    return counts.select(F.explode(rows).alias("_r")).select("_r.*")


class GeographyLookupError(ValueError):
    """A zone-to-geography table is not usable."""


def geography_lookup(rows: DataFrame, zone: str, label: str) -> DataFrame:
    """Cleaned (zone, label) lookup: integer zones, no blank labels, identical rows collapse."""
    text = F.trim(F.col(label).cast("string"))
    return rows.select(
        F.col(zone).try_cast("bigint").alias("zone"), F.nullif(text, F.lit("")).alias("label")
    ).distinct()


def geography_conflicts(lookup: DataFrame) -> DataFrame:
    """Rows that make a lookup unusable: no zone, a blank label, or two labels for a zone."""
    return (
        lookup.groupBy("zone")
        .agg(
            F.count_distinct("label").alias("labels"),
            F.count_if(F.col("label").isNull()).alias("blank"),
        )
        .filter(F.col("zone").isNull() | (F.col("labels") > 1) | (F.col("blank") > 0))
        .select(
            "zone",
            F.when(F.col("zone").isNull(), "zone is not an integer")
            .when(F.col("blank") > 0, "blank label")
            .otherwise("several labels")
            .alias("problem"),
        )
    )


def checked_geography_lookup(rows: DataFrame, zone: str, label: str) -> DataFrame:
    """The cleaned lookup; raises when a zone is ambiguous."""
    lookup = geography_lookup(rows, zone, label)
    bad = geography_conflicts(lookup).limit(5).collect()
    if bad:
        raise GeographyLookupError("; ".join(f"zone {r['zone']}: {r['problem']}" for r in bad))
    return lookup
