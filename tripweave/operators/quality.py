"""Checks of prepared tables and model fit against counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NumericType

from tripweave.model import Run
from tripweave.operators.aggregate import least_squares
from tripweave.plans.registry import session_of

# Foreign keys of the prepared tables (table, key, related table).
RELATIONSHIPS = (
    ("per", "household_id", "hh"),
    ("day", "household_id", "hh"),
    ("day", "person_id", "per"),
    ("tours", "household_id", "hh"),
    ("tours", "person_id", "per"),
    ("trips", "household_id", "hh"),
    ("trips", "person_id", "per"),
    ("trips", "tour_id", "tours"),
    ("vehicles", "household_id", "hh"),
    ("joint_participants", "person_id", "per"),
    ("joint_participants", "tour_id", "tours"),
)
CHECK_SCHEMA = (
    "source_table string, key string, target_table string, state string, orphan_count bigint, "
    "detail string"
)


def relationship_report(run: Run) -> DataFrame:
    """Rows whose non-null key has no match, for every foreign key: passed, failed or skipped.

    Every table is read once and gives its keys as entries: as a child of each relation and as a
    parent of the relations that point to it. One aggregation by key counts children and tells
    whether there is a parent; nothing is joined. Entries are dealt by key before they meet a hash
    table: a task that reads a table passes them on, however many keys its part of the file has,
    and a task that counts holds the keys of one shuffle partition.
    """
    rows, checked = [], []
    for relation in RELATIONSHIPS:
        reason = _skip_reason(run, *relation)
        if reason:
            rows.append((*relation, "skipped", 0, reason))
        else:
            checked.append(relation)
    parts = []
    if checked:
        parts.append(_orphans(run, checked))
    if rows:
        parts.append(session_of(run).createDataFrame(rows, CHECK_SCHEMA))
    return reduce(DataFrame.unionByName, parts)


def _orphans(run: Run, relations: list[tuple[str, str, str]]) -> DataFrame:
    types = {
        (table, key): run.tables[table].schema[key].dataType
        for source, key, target in relations
        for table in (source, target)
    }
    whole = all(isinstance(t, IntegralType) for t in types.values())
    entries: dict[str, list[Column]] = {}

    def entry(table: str, key: str, tag: int, numeric: bool, slot: int | None) -> None:
        made = F.struct(
            F.lit(tag).cast("byte").alias("tag"),
            (F.col(key).cast("long") if whole else _key_text(key, numeric)).alias("key"),
            F.lit(slot).cast("byte").alias("slot"),
        )
        entries.setdefault(table, []).append(made)

    sought: dict[tuple[str, str, bool], list[int]] = {}
    for i, (source, key, target) in enumerate(relations):
        numeric = any(isinstance(types[table, key], NumericType) for table in (source, target))
        sought.setdefault((target, key, numeric), []).append(i)
    place = {}
    for tag, ((target, key, numeric), own) in enumerate(sought.items()):
        for slot, i in enumerate(own):
            place[i] = tag, slot
            entry(relations[i][0], key, tag, numeric, slot)
        entry(target, key, tag, numeric, None)
    keys = reduce(
        DataFrame.unionByName,
        [
            run.tables[table].select(F.explode(F.array(*made)).alias("_e")).select("_e.*")
            for table, made in entries.items()
        ],
    ).filter(F.col("key").isNotNull())
    slot = F.col("slot")
    by_key = keys.repartition("tag", "key").groupBy("tag", "key").agg(
        F.bool_or(slot.isNull()).alias("_parent"),
        *[F.count_if(slot == k).alias(f"_s{k}") for k in range(max(map(len, sought.values())))],
    )
    alone = by_key.filter(~F.col("_parent"))
    sums = alone.agg(
        *[
            F.coalesce(F.sum(F.when(F.col("tag") == tag, F.col(f"_s{k}"))), F.lit(0)).alias(f"_n{i}")
            for i, (tag, k) in place.items()
        ]
    )
    told = F.array(
        *[
            F.struct(
                F.lit(source).alias("source_table"),
                F.lit(key).alias("key"),
                F.lit(target).alias("target_table"),
                F.when(F.col(f"_n{i}") > 0, "failed").otherwise("passed").alias("state"),
                F.col(f"_n{i}").alias("orphan_count"),
                F.lit(None).cast("string").alias("detail"),
            )
            for i, (source, key, target) in enumerate(relations)
        ]
    )
    return sums.select(F.explode(told).alias("_r")).select("_r.*")


def _key_text(key: str, numeric: bool) -> Column:
    """A key as text, so that keys of all types meet in one set; numbers are equal by value."""
    text = F.col(key).cast("string")
    if not numeric:
        return text
    return F.coalesce(F.col(key).try_cast("decimal(38,6)").cast("string"), F.concat(F.lit("text "), text))


def _skip_reason(run: Run, source: str, key: str, target: str) -> str | None:
    for table in (source, target):
        state = run.states.get(table, ("available", ""))[0]
        if state in ("unavailable", "failed"):
            return f"table {table} is {state}"
        if run.tables.get(table) is None:
            return f"table {table} is unavailable"
        if key not in run.tables[table].columns:
            return f"table {table} is missing column {key}"
    return None


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Key values that occur more than once (a join on them would repeat rows)."""
    return (
        df.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("rows"))
        .filter("rows > 1")
    )


# --- counts and volumes --------------------------------------------------------------------

# Count periods and their columns.
COUNT_PERIODS = {"AM": "am_vol", "MD": "md_vol", "PM": "pm_vol", "Day": "day_vol"}


def _long(df: DataFrame, periods: dict[str, str], value: str) -> DataFrame:
    entries = F.array(
        *[
            F.struct(F.lit(p).alias("period"), F.col(c).cast("double").alias("v"))
            for p, c in periods.items()
        ]
    )
    return df.select(
        F.col("id").try_cast("bigint").alias("id"),
        F.col("FACTYPE").cast("string").alias("facility_type"),
        F.explode(entries).alias("_e"),
    ).select("id", "facility_type", "_e.period", F.col("_e.v").alias(value))


def count_scatter(counts: DataFrame, volumes: DataFrame) -> DataFrame:
    """Observed and modelled volume per count location and period both tables have."""
    shared = {
        p: c for p, c in COUNT_PERIODS.items() if c in counts.columns and c in volumes.columns
    }
    observed = _long(counts, shared, "observed_volume")
    modeled = _long(volumes, shared, "modeled_volume")
    return observed.join(modeled, ["id", "facility_type", "period"]).filter(
        "observed_volume IS NOT NULL AND modeled_volume IS NOT NULL"
    )


def equation_label(slope: str, intercept: str):
    sign = F.when(F.col(intercept) >= 0, "+").otherwise("-")
    return F.format_string("y = %.2fx %s %.2f", F.col(slope), sign, F.abs(F.col(intercept)))


def count_fit(scatter: DataFrame) -> DataFrame:
    """Least-squares fit per period and facility type, and over all facility types."""
    both = scatter.withColumn(
        "facility_type", F.explode(F.array(F.col("facility_type"), F.lit("All")))
    )
    fit = least_squares(both, ["facility_type", "period"])
    defined = F.col("slope").isNotNull()
    return fit.withColumn(
        "equation_label", F.when(defined, equation_label("slope", "intercept")).otherwise("")
    ).withColumn(
        "r_squared_label",
        F.when(defined, F.format_string("R² = %.2f", F.col("r_squared"))).otherwise(""),
    )
