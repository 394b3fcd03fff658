"""Weighting modes: named run-to-run functions, and summaries for several modes."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import partial, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripweave.model import Config, Run
from tripweave.operators.segments import (
    SEGMENT,
    Segmentation,
    analysis_units,
    resolve_table,
    segments_together,
)
from tripweave.operators.weights import column_weights, unweighted
from tripweave.plans.counts import CountedTogether, sharing, weights_of_modes
from tripweave.plans.registry import get_summary
from tripweave.sources.lineage import cut_lineage


class WeightingError(ValueError):
    """A weighting mode is unknown, registered twice, or lacks its columns."""


@dataclass(frozen=True)
class WeightingMode:
    """A mode id, its label, the transform, and the columns it needs per table.

    ``weights_only``: the transform keeps all rows and changes nothing but weights, so that its
    weights can stand beside those of other modes.
    """

    mode_id: str
    label: str
    transform: Callable[[Run, Config], Run]
    required: dict[str, tuple[str, ...]] = field(default_factory=dict)
    copies_external: bool = True
    weights_only: bool = False

    def validate(self, run: Run) -> None:
        for table, columns in self.required.items():
            frame = run.tables.get(table)
            if frame is None:
                raise WeightingError(f"mode {self.mode_id!r} needs table {table!r}")
            absent = [c for c in columns if c not in frame.columns]
            if absent:
                raise WeightingError(
                    f"mode {self.mode_id!r} needs columns on {table!r}: {', '.join(absent)}"
                )

    def apply(self, run: Run, config: Config) -> Run:
        self.validate(run)
        return self.transform(run, config)


class WeightingModes:
    """Registered modes in order."""

    def __init__(self) -> None:
        self._modes: dict[str, WeightingMode] = {}

    def register(self, mode: WeightingMode) -> WeightingMode:
        if mode.mode_id in self._modes:
            raise WeightingError(f"mode {mode.mode_id!r} is registered twice")
        if any(m.label.casefold() == mode.label.casefold() for m in self._modes.values()):
            raise WeightingError(f"label {mode.label!r} is used by another mode")
        self._modes[mode.mode_id] = mode
        return mode

    def register_columns(self, mode_id: str, label: str, columns: dict[str, str]) -> WeightingMode:
        """A mode that takes weights from other columns of households, persons or trips."""
        unknown = set(columns) - {"households", "persons", "trips"}
        if unknown or not columns:
            raise WeightingError(f"unknown tables: {', '.join(sorted(unknown)) or '(none given)'}")
        names = {"households": "hh", "persons": "per", "trips": "trips"}
        return self.register(
            WeightingMode(
                mode_id,
                label,
                lambda run, config: column_weights(run, columns),
                {names[t]: (c,) for t, c in columns.items()},
                weights_only=True,
            )
        )

    def get(self, mode_id: str) -> WeightingMode:
        key = str(mode_id).strip().lower()
        if key not in self._modes:
            raise WeightingError(f"unknown mode {mode_id!r}; known: {', '.join(self._modes)}")
        return self._modes[key]

    def ids(self) -> list[str]:
        return list(self._modes)


def default_modes() -> WeightingModes:
    modes = WeightingModes()
    for mode_id, label, change in (
        ("weighted", "Weighted", lambda run, config: run),
        ("unweighted", "Unweighted", lambda run, config: unweighted(run)),
    ):
        modes.register(WeightingMode(mode_id, label, change, weights_only=True))
    return modes


def counted_together(
    run: Run,
    config: Config,
    ids: Sequence[str],
    mode_ids: Sequence[str],
    modes: WeightingModes,
    segmentation: Segmentation | None = None,
) -> list[CountedTogether]:
    """Summaries that share a scan over all modes; those not in the result are built one by one.

    With a segmentation they are counted for all its segments instead of the full run, and weights
    are those of the full run. Where cutting trips would change weights (tours take the mean of
    their trips), nothing is shared.
    """
    chosen = {m: modes.get(m) for m in mode_ids}
    if not all(mode.weights_only for mode in chosen.values()):
        return []
    if (
        segmentation is not None
        and resolve_table(run, segmentation) == "trips"
        and any("trips" in mode.required for mode in chosen.values())
    ):
        return []
    weighed = weights_of_modes(
        run, {m: partial(mode.apply, config=config) for m, mode in chosen.items()}
    )
    if segmentation is not None:
        weighed = segments_together(weighed, segmentation)
    groups = sharing(weighed, ids, mode_ids)
    return [CountedTogether(weighed, source, own, mode_ids) for source, own in groups.items()]


def summaries_by_mode(
    run: Run,
    config: Config,
    summary_id: str,
    mode_ids: Sequence[str] | None = None,
    modes: WeightingModes | None = None,
) -> DataFrame:
    """One summary for every enabled mode, with a ``weighting_mode`` column.

    Declared counts take all modes from one aggregation.
    """
    modes = modes or default_modes()
    mode_ids = list(mode_ids or config.weighting_modes)
    definition = get_summary(summary_id)
    for together in counted_together(run, config, [summary_id], mode_ids, modes):
        if summary_id in together.counted:
            return together.table(summary_id)
    parts = [
        definition.build(modes.get(m).apply(run, config), config).withColumn(
            "weighting_mode", F.lit(m)
        )
        for m in mode_ids
    ]
    return reduce(DataFrame.unionByName, parts)


def summaries_by_segment(
    run: Run,
    config: Config,
    ids: Sequence[str],
    segmentation: Segmentation,
    mode_ids: Sequence[str] | None = None,
    modes: WeightingModes | None = None,
) -> dict[str, DataFrame]:
    """Summaries of every segment and mode by id, with ``segment_id`` and ``weighting_mode``.

    Declared counts of one source take all segments and modes from one aggregation, in which the
    segment is a key; a row in two segments counts in both. Others are built segment by segment.
    """
    modes = modes or default_modes()
    mode_ids = list(mode_ids or config.weighting_modes)
    found = {}
    for together in counted_together(run, config, ids, mode_ids, modes, segmentation):
        if together.grouped is not None:
            together.grouped = cut_lineage(together.grouped)
        for sid in together.counted:
            found[sid] = together.table(sid).withColumnRenamed(SEGMENT, "segment_id")
    left = [sid for sid in ids if sid not in found]
    units = analysis_units(run, segmentation)[1:] if left else []
    for sid in left:
        parts = [
            summaries_by_mode(unit.run, config, sid, mode_ids, modes).withColumn(
                "segment_id", F.lit(unit.segment_id)
            )
            for unit in units
        ]
        found[sid] = reduce(DataFrame.unionByName, parts)
    return found
