"""Summaries that are weighted sums by keys, declared so that several share one scan.

A declaration names its source (rows of a table with a weight), which rows count, the keys and the
measures. One summary alone is a filter and a group-by. Several summaries of one source, for several
weighting modes, are the grouping sets of one aggregation: every mode is a weight column of its own,
every summary a set of its keys and a flag of its rows. Totals, zero rows and modes are laid out from
that small result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripweave.functions.expressions import total
from tripweave.model import Config, Run
from tripweave.operators.aggregate import add_totals
from tripweave.operators.weights import WEIGHT, side_by_side
from tripweave.plans.registry import SUMMARIES, get_summary, summary

MODE = "weighting_mode"


@dataclass(frozen=True)
class Source:
    """Rows of a table; ``weigh`` adds an output column for each weight column."""

    table: str
    weigh: Callable[[Run, dict[str, str]], DataFrame]


@dataclass(frozen=True)
class Counted:
    """Which rows count, their keys, and the measures: a condition, or None for all these rows."""

    where: Column
    keys: dict[str, Column]
    measures: dict[str, Column | None]


@dataclass(frozen=True)
class CountSummary:
    summary_id: str
    source: Source
    define: Callable[[DataFrame], Counted | None]
    totals: dict[str, str] = field(default_factory=dict)
    finish: Callable[[DataFrame, list[str]], DataFrame] | None = None

    def laid_out(self, detail: DataFrame, counted: Counted, extra: list[str]) -> DataFrame:
        """Totals and zero rows from the sums by key; ``extra`` keys are carried along."""
        keys = [*counted.keys, *extra]
        if self.totals:
            detail = add_totals(detail, self.totals, keys, list(counted.measures))
        return self.finish(detail, extra) if self.finish else detail

    def build(self, run: Run, config: Config) -> DataFrame | None:
        weight = "_w"
        rows = self.source.weigh(run, {WEIGHT: weight})
        counted = self.define(rows)
        if counted is None:
            return None
        detail = (
            rows.filter(counted.where)
            .groupBy(*[value.alias(key) for key, value in counted.keys.items()])
            .agg(*[total(_when(c, weight)).alias(m) for m, c in counted.measures.items()])
        )
        return self.laid_out(detail, counted, [])


COUNTS: dict[str, CountSummary] = {}


def count_summary(
    summary_id: str,
    schema: str,
    requires: dict[str, str],
    source: Source,
    totals: dict[str, str] | None = None,
    finish: Callable[[DataFrame, list[str]], DataFrame] | None = None,
):
    """Register ``f(rows) -> Counted`` as a summary that can share its scan."""

    def decorate(define):
        declared = CountSummary(summary_id, source, define, totals or {}, finish)
        COUNTS[summary_id] = declared
        summary(summary_id, schema, requires)(declared.build)
        return define

    return decorate


def _when(condition: Column | None, weight: str) -> Column:
    return F.col(weight) if condition is None else F.when(condition, F.col(weight))


def weights_of_modes(run: Run, transforms: dict[str, Callable[[Run], Run]]) -> Run:
    """The run with a weight column for each mode."""
    return side_by_side(run, {mode_column(m): change for m, change in transforms.items()})


def mode_column(mode: str) -> str:
    return f"{WEIGHT}__{mode}"


def sharing(run: Run, ids: Sequence[str], modes: Sequence[str]) -> dict[Source, list[str]]:
    """Those of the summaries that can be counted together, by source.

    ``run`` has the weights of all modes. Summaries that lack inputs, or whose table has no weight
    under some mode, are left out.
    """
    found: dict[Source, list[str]] = {}
    for sid in ids:
        if sid not in COUNTS or SUMMARIES[sid].missing_inputs(run):
            continue
        source = COUNTS[sid].source
        if run.has(source.table, *[mode_column(m) for m in modes]):
            found.setdefault(source, []).append(sid)
    return found


class CountedTogether:
    """Sums of several summaries of one source and several modes, from one aggregation."""

    def __init__(self, run: Run, source: Source, ids: Sequence[str], modes: Sequence[str]):
        self.modes, self.by = list(modes), list(run.by)
        weights = {m: f"_w{i}" for i, m in enumerate(self.modes)}
        rows = source.weigh(run, {mode_column(m): w for m, w in weights.items()})
        self.counted = {sid: COUNTS[sid].define(rows) for sid in ids}
        self.counted = {sid: c for sid, c in self.counted.items() if c is not None}
        self.sets: dict[str, list[str]] = {}
        keys: dict[str, Column] = {}
        sums: dict[str, Column] = {}
        self.sum_of: dict[tuple[str, str, str], str] = {}
        for i, (sid, counted) in enumerate(self.counted.items()):
            self.sets[sid] = [*self.by, f"_counts{i}"]
            keys[f"_counts{i}"] = F.coalesce(counted.where, F.lit(False))
            for key, value in counted.keys.items():
                self.sets[sid].append(f"_k{i}_{key}")
                keys[f"_k{i}_{key}"] = F.when(counted.where, value)
            for measure, condition in counted.measures.items():
                for mode, weight in weights.items():
                    # Sums over all counted rows are the same column for every summary.
                    name = f"_s{weight}" if condition is None else f"_s{i}_{measure}{weight}"
                    sums[name] = F.col(weight) if condition is None else _when(condition, weight)
                    self.sum_of[sid, measure, mode] = name
        self.columns = [*self.by, *keys]
        values = rows.select(
            *self.by,
            *[value.alias(name) for name, value in keys.items()],
            *[value.alias(name) for name, value in sums.items()],
        )
        self.grouped = None
        if self.counted:
            grouped = values.groupingSets(
                [[F.col(c) for c in columns] for columns in self.sets.values()],
                *[F.col(c) for c in self.columns],
            )
            self.grouped = grouped.agg(
                F.grouping_id().alias("_set"), *[total(name).alias(name) for name in sums]
            )

    def set_number(self, sid: str) -> int:
        """Spark's number of the grouping set: a bit for each column that it leaves out."""
        return int("".join("0" if c in self.sets[sid] else "1" for c in self.columns), 2)

    def table(self, sid: str, modes: Sequence[str] | None = None) -> DataFrame:
        """Columns of the summary, ``weighting_mode``, and those that tell cuts of the run apart."""
        counted = self.counted[sid]
        flag, *key_names = self.sets[sid][len(self.by) :]
        sums = F.array(
            *[
                F.struct(
                    F.lit(mode).alias(MODE),
                    *[F.col(self.sum_of[sid, m, mode]).alias(m) for m in counted.measures],
                )
                for mode in (modes or self.modes)
            ]
        )
        detail = (
            self.grouped.filter((F.col("_set") == self.set_number(sid)) & F.col(flag))
            .select(
                *[F.col(n).alias(key) for n, key in zip(key_names, counted.keys)],
                *self.by,
                F.explode(sums).alias("_m"),
            )
            .select(*counted.keys, *self.by, f"_m.{MODE}", *[f"_m.{m}" for m in counted.measures])
        )
        laid_out = COUNTS[sid].laid_out(detail, counted, [MODE, *self.by])
        shape = get_summary(sid)
        return laid_out.select(
            *[F.col(f.name).cast(f.dataType).alias(f.name) for f in shape.schema], MODE, *self.by
        )
