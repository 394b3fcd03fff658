"""Segments: slices of a run by a column of one of its tables or by a lookup table.

Slices use semi joins, so a related row appears once however many matching rows point to it. Segments
can also be taken together: their rows stand in the same tables with the segment as a key.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripweave.model import TABLES, Run
from tripweave.operators.quality import duplicate_keys

ANCHOR_KEYS = {
    "hh": "household_id",
    "per": "person_id",
    "day": "day_id",
    "tours": "tour_id",
    "trips": "trip_id",
    "vehicles": "vehicle_id",
}


SEGMENT = "_segment_id"


class SegmentError(ValueError):
    """A segmentation cannot be applied to a run."""


@dataclass(frozen=True)
class Segmentation:
    """Where segment values come from, and the named segments with their values.

    ``column`` names a column of ``table`` (or of the only table that has it). With
    ``lookup`` (key, value) rows, values are attached to ``table`` by ``key``.
    """

    name: str
    segments: dict[str, tuple]
    column: str = "segment"
    table: str | None = None
    lookup: DataFrame | None = None
    key: str | None = None
    on_empty: str = "keep"


def resolve_table(run: Run, spec: Segmentation) -> str:
    """Anchor table of a segmentation; the column must be in exactly one table."""
    if spec.lookup is not None:
        if spec.table is None or not run.has(spec.table, spec.key):
            raise SegmentError(f"table {spec.table!r} has no key column {spec.key!r}")
        return spec.table
    if spec.table is not None:
        if not run.has(spec.table, spec.column):
            raise SegmentError(f"column {spec.column!r} is not in table {spec.table!r}")
        return spec.table
    owners = [t for t in TABLES if run.has(t, spec.column)]
    if len(owners) != 1:
        raise SegmentError(
            f"column {spec.column!r} is in {', '.join(owners) or 'no table'}; name the table"
        )
    return owners[0]


def anchor_table(run: Run, spec: Segmentation) -> DataFrame:
    """The anchor table with the segment value. Lookups with two rows per key are refused."""
    anchor = run.tables[resolve_table(run, spec)]
    if spec.lookup is None:
        return anchor
    if not duplicate_keys(spec.lookup, "key").limit(1).isEmpty():
        raise SegmentError("segment lookup has several rows for one key")
    kind = anchor.schema[spec.key].dataType
    rows = spec.lookup.select(
        F.col("key").try_cast(kind).alias(spec.key),
        F.col("value").cast("string").alias(spec.column),
    )
    return anchor.drop(spec.column).join(rows, spec.key, "left")


def segment_columns(spec: Segmentation) -> list[Column]:
    """For each segment its id where the row belongs to it, else null."""
    value = F.col(spec.column).cast("string")
    return [
        F.when(value.isin(*[str(v) for v in values]), F.lit(segment_id))
        for segment_id, values in spec.segments.items()
    ]


def _ids(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """Keys of the rows, with the segment where rows have one."""
    name = name or column
    by = [SEGMENT] if SEGMENT in df.columns else []
    return df.select(F.col(column).alias(name), *by).filter(F.col(name).isNotNull())


def _related(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among the ids, once, or once for each segment that has the key.

    A key meets the rows with an array of its segments, so each table is shuffled at its own size.
    """
    if SEGMENT not in ids.columns:
        return df.join(ids, key, "left_semi")
    members = ids.groupBy(key).agg(F.collect_set(SEGMENT).alias("_segments"))
    return df.join(members, key).select(
        *[F.col(f"`{c}`") for c in df.columns], F.explode("_segments").alias(SEGMENT)
    )


def _keep(name: str, df: DataFrame | None, ids: DataFrame, key: str) -> DataFrame | None:
    """Rows whose key is among the ids; a table that has no key cannot be cut."""
    if df is None:
        return None
    if key not in df.columns:
        raise SegmentError(f"segments need {key} in table {name}")
    return _related(df, ids, key)


def slice_run(run: Run, table: str, matched: DataFrame) -> Run:
    """The run cut to what relates to the matched rows of one table.

    Where matched rows carry a segment (one row for each segment they belong to), the result holds
    all cuts: a row comes once for each segment, with the segment as a column.
    """
    t = dict(run.tables)

    def keep(names: str, ids: DataFrame, key: str) -> None:
        for name in names.split():
            t[name] = _keep(name, run.tables.get(name), ids, key)

    if table == "land_use":
        zone = next((c for c in ("MAZ", "TAZ") if c in matched.columns), None)
        home = "home_zone_id" if zone == "MAZ" else "home_taz"
        if zone is None or not run.has("hh", home):
            raise SegmentError("land-use segments need MAZ or TAZ and the household home zone")
        keep("land_use", _ids(matched, zone), zone)
        keep("hh", _ids(matched, zone, home), home)
        keep("per tours trips day vehicles", _ids(t["hh"], "household_id"), "household_id")
    elif table in ("hh", "vehicles"):
        if table == "vehicles":
            t["vehicles"] = _matched_rows(run, table, matched)
        ids = _ids(matched, "household_id")
        keep("hh per tours trips day" + ("" if table == "vehicles" else " vehicles"), ids,
             "household_id")
    elif table == "per":
        people = _ids(matched, "person_id")
        keep("per tours trips day", people, "person_id")
        keep("hh vehicles", _ids(t["per"], "household_id"), "household_id")
        keep("joint_participants", people, "person_id")
    elif table in ("tours", "trips"):
        if table == "trips":
            keep("trips", _ids(matched, "trip_id"), "trip_id")
            keep("tours", _ids(t["trips"], "tour_id"), "tour_id")
        else:
            keep("tours trips", _ids(matched, "tour_id"), "tour_id")
        keep("per day", _ids(t[table], "person_id"), "person_id")
        keep("hh vehicles", _ids(t[table], "household_id"), "household_id")
    elif table == "day":
        t["day"] = _matched_rows(run, table, matched)
        if "person_id" in matched.columns:
            people = _ids(matched, "person_id")
            keep("per tours trips", people, "person_id")
        elif "household_id" in matched.columns:
            keep("per tours trips", _ids(matched, "household_id"), "household_id")
        else:
            raise SegmentError("day segments need person_id or household_id")
        homes = _ids(t["per"], "household_id")
        if "household_id" in matched.columns:
            homes = homes.unionByName(_ids(matched, "household_id"))
        keep("hh vehicles", homes, "household_id")
    elif table == "joint_participants":
        if not {"tour_id", "person_id"} <= set(matched.columns):
            raise SegmentError("participant segments need tour_id and person_id")
        t["joint_participants"] = _own_columns(run.joint_participants, matched)
        keep("tours trips", _ids(matched, "tour_id"), "tour_id")
        people = _ids(matched, "person_id").unionByName(_ids(t["tours"], "person_id"))
        keep("per day", people, "person_id")
        homes = _ids(t["per"], "household_id").unionByName(_ids(t["tours"], "household_id"))
        keep("hh vehicles", homes, "household_id")
    else:
        raise SegmentError(f"table {table!r} cannot anchor a segment")

    if table not in ("per", "joint_participants") and run.has("tours", "tour_id"):
        keep("joint_participants", _ids(t["tours"], "tour_id"), "tour_id")
    for sidecar, owner, key in (
        ("trip_hypothetical_skims", "trips", "trip_id"),
        ("tour_hypothetical_skims", "tours", "tour_id"),
    ):
        if run.has(sidecar, key):
            keep(sidecar, _ids(t[owner], key), key)
    return run.with_tables(**t)


def _matched_rows(run: Run, table: str, matched: DataFrame) -> DataFrame:
    own, key = run.tables[table], ANCHOR_KEYS[table]
    if key in own.columns and key in matched.columns:
        return _related(own, _ids(matched, key), key)
    return _own_columns(own, matched)


def _own_columns(own: DataFrame, matched: DataFrame) -> DataFrame:
    by = [SEGMENT] if SEGMENT in matched.columns else []
    return matched.select(*[F.col(f"`{c}`") for c in own.columns], *by)


def segments_together(run: Run, spec: Segmentation) -> Run:
    """All segments of a run in one: each row once for every segment it belongs to.

    Membership is a relation of (segment, key) that each table meets once, so the number of scans
    does not depend on the number of segments, and segments may overlap. Tables that no segment
    cuts (land use, but where it is the anchor) stay without a segment.
    """
    table, anchor = resolve_table(run, spec), anchor_table(run, spec)
    member = F.array_compact(F.array(*segment_columns(spec)))
    sliced = slice_run(run, table, anchor.withColumn(SEGMENT, F.explode(member)))
    return replace(sliced, by=(SEGMENT,))


@dataclass(frozen=True)
class AnalysisUnit:
    """A full run or one segment of it."""

    segmentation: str
    segment_id: str
    run: Run

    @property
    def is_full(self) -> bool:
        return self.segment_id == "full"


def analysis_units(run: Run, spec: Segmentation | None = None) -> list[AnalysisUnit]:
    """The full run and every segment. Empty segments are kept, skipped or an error."""
    units = [AnalysisUnit("full", "full", run)]
    if spec is None:
        return units
    table, anchor = resolve_table(run, spec), anchor_table(run, spec)
    conditions = dict(zip(spec.segments, segment_columns(spec)))
    if spec.on_empty != "keep":
        counts = anchor.agg(*[F.count(c).alias(s) for s, c in conditions.items()]).first()
    for segment_id, condition in conditions.items():
        matched = anchor.filter(condition.isNotNull())
        if spec.on_empty != "keep" and not counts[segment_id]:
            if spec.on_empty == "error":
                raise SegmentError(f"segment {segment_id!r} is empty")
            continue
        sliced = slice_run(run, table, matched)
        units.append(
            AnalysisUnit(spec.name, segment_id, replace(sliced, label=run.label, facts={}))
        )
    return units
