"""Data model: one run as named lazy DataFrames, and the plain-dataclass configuration."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TABLES = (
    "hh",
    "per",
    "day",
    "tours",
    "trips",
    "vehicles",
    "joint_participants",
    "land_use",
)

ALL_TOUR_PURPOSES = "all_tour_purposes"
ALL_PERSON_TYPES = "all_person_types"
ALL_GEOGRAPHIES = "all_geographies"
ALL_TOUR_MODES = "all_tour_modes"


@dataclass(frozen=True)
class GeographyAggregation:
    """A named grouping of zones: ``lookup`` rows are (zone id, label)."""

    name: str
    source_zone_system: str = "taz"
    lookup: DataFrame | None = None


@dataclass(frozen=True)
class StudentType:
    """A student label with its enrolment columns and optional person selectors."""

    label: str
    land_use_columns: tuple[str, ...]
    is_university: bool | None = None
    school_segment: tuple[str, ...] = ()
    SCHG: tuple[str, ...] = ()
    pstudent: tuple[str, ...] = ()

    @property
    def has_selector(self) -> bool:
        return self.is_university is not None or bool(
            self.school_segment or self.SCHG or self.pstudent
        )


# Accepted source names of the canonical columns, first match wins.
DEFAULT_ALIASES: dict[str, tuple[str, ...]] = {
    "ptype": ("ptype",),
    "hhsize": ("hhsize",),
    "auto_ownership": ("auto_ownership",),
    "num_workers": ("num_workers",),
    "num_adults": ("num_adults",),
    "household_id": ("household_id",),
    "person_id": ("person_id",),
    "tour_id": ("tour_id",),
    "trip_id": ("trip_id",),
    "tour_purpose": ("tour_purpose", "primary_purpose", "tour_type", "purpose"),
    "trip_purpose": ("trip_purpose", "purpose"),
    "tour_mode": ("tour_mode",),
    "trip_mode": ("trip_mode",),
    "tour_category": ("tour_category",),
    "tour_start": ("start", "start_hour"),
    "tour_end": ("end", "end_hour"),
    "tour_duration": ("duration", "tourdur"),
    "trip_depart": ("depart", "depart_hour"),
    "total_employment": (
        "EMP_TOTAL",
        "EMP_Total",
        "EMPLOY_TOT",
        "TOTEMP",
        "total_employment",
        "employment",
    ),
    "income_segment": ("income_segment", "income_broad", "income"),
    "home_zone_id": ("home_zone_id",),
    "workplace_zone_id": ("workplace_zone_id",),
    "school_zone_id": ("school_zone_id",),
    "has_license": ("has_license",),
    "mandatory_tour_frequency": ("mandatory_tour_frequency",),
    "is_student": ("is_student", "student"),
    "is_university": ("is_university", "major_uni"),
    "school_segment": ("school_segment",),
    "schg": ("SCHG",),
    "pstudent": ("pstudent",),
    "tour_origin": ("origin",),
    "tour_destination": ("destination",),
    "trip_origin": ("origin",),
    "trip_destination": ("destination",),
    "stop_frequency": ("stop_frequency",),
    "trip_outbound": ("outbound",),
    "trip_num": ("trip_num",),
    "pnr_zone_id": ("pnr_zone_id",),
    "pnr_lot_capacity": ("PNR_SPACES",),
    "is_worker": ("is_worker",),
    "adult": ("adult", "is_adult"),
    "day_id": ("day_id",),
    "day_weight": ("day_weight",),
    "vehicle_id": ("vehicle_id",),
    "vehicle_num": ("vehicle_num",),
    "vehicle_type": ("vehicle_type",),
    "school_esc_outbound": ("school_esc_outbound",),
    "school_esc_inbound": ("school_esc_inbound",),
    "num_escortees": ("num_escortees", "num_escorted"),
    "out_escorted_tour_ids": ("out_escorted_tour_ids",),
    "inb_escorted_tour_ids": ("inb_escorted_tour_ids",),
    "out_escorting_type": ("out_escorting_type",),
    "inb_escorting_type": ("inb_escorting_type",),
    "out_chauffeur_tour_id": ("out_chauffeur_tour_id",),
    "inb_chauffeur_tour_id": ("inb_chauffeur_tour_id",),
    "maz": ("MAZ", "zone_id"),
    "taz": ("TAZ",),
}


@dataclass(frozen=True)
class Config:
    """Caller-supplied settings. Everything has a default; nothing is read from files."""

    use_maz: bool = True
    geographies: tuple[GeographyAggregation, ...] = ()
    geography_column: str | None = None
    geography_labels: dict[str, str] = field(default_factory=dict)
    group_school_tour_purposes: bool = True
    group_atwork_tour_purposes: bool = True
    group_joint_tour_purposes: bool = True
    aliases: dict[str, tuple[str, ...]] = field(default_factory=dict)
    labels: dict[str, dict[str, str]] = field(default_factory=dict)
    orders: dict[str, tuple[str, ...]] = field(default_factory=dict)
    mode_groups: dict[str, tuple[str, ...]] = field(default_factory=dict)
    pnr_tour_modes: tuple[str, ...] = ("PNR_TRANSIT",)
    student_types: tuple[StudentType, ...] = ()
    auto_sufficiency_basis: str = "licensed_drivers"
    escort_labels: dict[str, str] = field(default_factory=dict)
    sample_rate_column: str | None = None
    period_breakpoints: tuple[int, ...] = ()
    period_labels: tuple[str, ...] = ()
    weighting_modes: tuple[str, ...] = ("weighted", "unweighted")

    def candidates(self, key: str) -> tuple[str, ...]:
        """Configured source names of one canonical column."""
        return tuple(self.aliases.get(key, DEFAULT_ALIASES.get(key, (key,))))

    @property
    def zone_base(self) -> str:
        return "maz" if self.use_maz else "taz"


@dataclass
class Run:
    """One model run or survey. Tables are lazy DataFrames; an absent table is ``None``.

    ``by`` names columns that tell several cuts of one run apart, whose rows stand in the same
    tables: joins and groups inside the run use them as well.
    """

    label: str
    tables: dict[str, DataFrame | None]
    states: dict[str, tuple[str, str]] = field(default_factory=dict)
    facts: dict[str, Any] = field(default_factory=dict)
    by: tuple[str, ...] = ()

    def __getattr__(self, name: str):
        if name.startswith("_") or "tables" not in self.__dict__:
            raise AttributeError(name)
        return self.tables.get(name)

    def has(self, table: str, *columns: str) -> bool:
        frame = self.tables.get(table)
        return frame is not None and set(columns) <= set(frame.columns)

    def with_tables(self, **tables: DataFrame | None) -> "Run":
        """A copy with some tables replaced; cached facts are dropped."""
        return replace(self, tables={**self.tables, **tables}, facts={})

    def fact(self, name: str, compute) -> Any:
        """A data-dependent yes/no that selects a plan; evaluated at most once per run."""
        if name not in self.facts:
            self.facts[name] = compute()
        return self.facts[name]

    @property
    def has_day_rows(self) -> bool:
        day = self.day
        return day is not None and self.fact("has_day_rows", lambda: not day.isEmpty())

    def multiday(self, owner: str, day_column: str) -> bool:
        """Whether any ``owner`` (person or household) is observed on several days."""
        if not self.has("day", owner, day_column):
            return False
        day = self.day

        def compute() -> bool:
            spans = (
                day.filter(F.col(owner).isNotNull() & F.col(day_column).isNotNull())
                .groupBy(owner)
                .agg(F.min(day_column).alias("lo"), F.max(day_column).alias("hi"))
            )
            return not spans.filter("lo < hi").limit(1).isEmpty()

        return self.fact(f"multiday:{owner}:{day_column}", compute)


def first_column(columns, candidates) -> str | None:
    """The first candidate present, or ``None``."""
    present = set(columns)
    return next((name for name in candidates if name in present), None)


def label_column(column: Column, labels: dict[str, str]) -> Column:
    """Recode values through a label table, keeping values that have no label."""
    text = column.cast("string")
    if not labels:
        return text
    table = F.create_map(*[F.lit(part) for pair in labels.items() for part in pair])
    return F.coalesce(F.try_element_at(table, text), text)
