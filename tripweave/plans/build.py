"""Building and storing the summaries of a run for every segment and weighting mode."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripweave.model import Config, Run
from tripweave.operators.segments import SEGMENT, Segmentation, analysis_units
from tripweave.plans.counts import MODE, CountedTogether
from tripweave.plans.registry import get_summary, session_of, summary_ids
from tripweave.plans.weighting import WeightingModes, counted_together, default_modes
from tripweave.sources.lineage import cut_lineage
from tripweave.sources.tables import (
    FAILED,
    ledger,
    store_summary,
    summary_path,
    summary_state,
    write_tables,
)


def build_summaries(
    run: Run, config: Config, ids: Sequence[str] | None = None
) -> dict[str, DataFrame]:
    """Lazy summary tables by id; nothing runs before one is written or read."""
    spark = session_of(run)
    return {
        sid: get_summary(sid).build(run, config, spark)
        for sid in (ids or summary_ids(default_only=True))
    }


def stored_run(run: Run, folder: str) -> Run:
    """The run read back from prepared tables written once to a new folder.

    Summaries are many, so what prepares a table runs once and each summary reads the few columns
    it needs from Parquet.
    """
    place = f"{folder}/prepared/{run.label}-{uuid.uuid4().hex}"
    write_tables(run, place)
    spark = session_of(run)
    return run.with_tables(
        **{
            name: spark.read.schema(df.schema).parquet(f"{place}/{name}.parquet")
            for name, df in run.tables.items()
            if df is not None
        }
    )


def store_summaries(
    run: Run,
    config: Config,
    folder: str,
    ids: Sequence[str] | None = None,
    segmentation: Segmentation | None = None,
    modes: WeightingModes | None = None,
    raise_on_error: bool = False,
) -> DataFrame:
    """Write every summary under run, segment and mode; returns the availability ledger.

    The run's tables are written first and summaries are built from the stored ones. Declared counts
    are taken in two aggregations of each source: of the full run, and of all segments at once.

    A summary that fails is recorded and the others go on, unless errors are to be raised.
    """
    modes, spark = modes or default_modes(), session_of(run)
    run = stored_run(run, folder)
    states: dict[str, tuple[str, str]] = {}
    ids = list(ids or summary_ids(default_only=True))
    whole = shared_counts(run, config, ids, modes)
    parts = shared_counts(run, config, ids, modes, segmentation) if segmentation else {}
    for unit in analysis_units(run, segmentation):
        shared = whole if unit.is_full else parts
        for mode in config.weighting_modes:
            weighted = modes.get(mode).apply(unit.run, config)
            for sid in ids:
                definition = get_summary(sid)
                key = f"{unit.segmentation}/{unit.segment_id}/{mode}/{sid}"
                try:
                    if sid in shared:
                        df = shared[sid].table(sid, [mode]).drop(MODE)
                        if not unit.is_full:
                            own = F.col(SEGMENT) == unit.segment_id
                            df = df.filter(own).drop(SEGMENT)
                    else:
                        df = definition.build(weighted, config, spark)
                    path = summary_path(
                        folder, sid, run.label, mode, unit.segmentation, unit.segment_id
                    )
                    rows = store_summary(df, path)
                    states[key] = summary_state(rows, definition.missing_inputs(weighted))
                except Exception as error:
                    if raise_on_error:
                        raise
                    states[key] = (FAILED, str(error).splitlines()[0])
    return ledger(spark, run, states)


def shared_counts(
    run: Run,
    config: Config,
    ids: Sequence[str],
    modes: WeightingModes,
    segmentation: Segmentation | None = None,
) -> dict[str, CountedTogether]:
    """Declared counts of all modes by summary; each source is aggregated once and cut off there.

    With a segmentation they are those of all its segments.

    What cannot be aggregated together is left to its own build, which reports its error.
    """
    try:
        groups = counted_together(run, config, ids, config.weighting_modes, modes, segmentation)
        for together in groups:
            if together.grouped is not None:
                together.grouped = cut_lineage(together.grouped)
    except PySparkException:
        return {}
    return {sid: together for together in groups for sid in together.counted}
