"""Rule-driven lookups.

What is looked up for a row depends on few of its columns: the mode, the zones and what conditions and
matrix names are made of. A table is grouped to the distinct values of these columns, its demand, and
everything is looked up for the demand, which stays small while rows grow. Chains are a shrinking
remainder: the first steps are looked up as distinct (source, origin, destination), a fallback step
only for the chains that no step before has answered. Rows take the outcome by one join on the
demand's columns. Steps without a source or a zone never enter a lookup join.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripweave.operators.lookup_rules import PLACEHOLDER, TOUR_DIRECTION, Rule, RuleSet
from tripweave.sources.lineage import cut_lineage
from tripweave.sources.lookups import (
    AMBIGUOUS,
    KEYED,
    NO_DESTINATION,
    OD_MATRIX,
    LookupSources,
)

ROWS, KEY = "_rows", "_key_"
ROW_ID = "row_id"
MISSING_OD, SENTINEL, MISSING_MATRIX = "missing_od", "sentinel_value", "missing_matrix"


class AmbiguousSourceError(ValueError):
    """A matrix name occurs in several files and is not qualified."""


def _condition(df: DataFrame, rule: Rule) -> Column:
    condition = F.lit(True)
    for column, value in rule.when:
        if column not in df.columns:
            continue
        if isinstance(value, dict):
            condition = condition & F.col(column).isin(*value["in"])
        else:
            condition = condition & (F.col(column) == F.lit(value))
    return condition


def _token(rule: Rule, name: str) -> Column:
    text = F.col(rule.token_column(name)).cast("string")
    values = rule.dimensions[name].values
    if not values:
        return text
    table = F.create_map(*[F.lit(part) for pair in values for part in pair])
    return F.try_element_at(table, text)


def _matrix_name(rule: Rule) -> Column:
    pieces: list[Column] = []
    for i, part in enumerate(PLACEHOLDER.split(rule.matrix)):
        if i % 2:
            pieces.append(_token(rule, part))
        elif part:
            pieces.append(F.lit(part))
    return F.concat(*pieces)


def _step(df: DataFrame, rule: Rule, index: int, order: int) -> Column:
    """One planned step as a struct; ``reason`` says why it cannot be looked up.

    Only numbers and the matrix name travel with the rows; the rule's texts are joined to the
    reports through ``rule_index``.
    """
    missing = sorted(rule.needed_columns() - set(df.columns))
    nothing = F.lit(None)
    if missing:
        reason, matrix = F.lit(f"missing_trip_column:{missing[0]}"), nothing
    else:
        reason = F.coalesce(
            *[
                F.when(_token(rule, t).isNull(), f"missing_dimension_value:{t}")
                for t in rule.tokens
            ],
            nothing,
        )
        matrix = _matrix_name(rule)

    def zone(column: str | None) -> Column:
        known = column is not None and column in df.columns
        return (F.col(column) if known else nothing).cast("double")

    return F.struct(
        F.lit(index).alias("rule_index"),
        F.lit(order).alias("chain_order"),
        F.lit(rule.step).alias("step"),
        zone(rule.origin_column).alias("origin"),
        zone(rule.destination_column).alias("destination"),
        matrix.cast("string").alias("matrix_name"),
        reason.cast("string").alias("reason"),
    )


def chain_orders(rules: list[Rule]) -> dict[str, int]:
    """Position of every chain, in order of first appearance."""
    return {chain: i for i, chain in enumerate(dict.fromkeys(r.chain for r in rules))}


def rule_texts(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Names, mode, component, output, direction and combination of each rule.

    One row per configured rule, so it is broadcast.
    """
    table = df.sparkSession.createDataFrame(
        [
            (i, r.name, r.mode, r.component, r.output, r.direction, r.combine)
            for i, r in enumerate(rules)
        ],
        "rule_index int, rule_name string, mode string, component string, output string, "
        "direction string, combine string",
    )
    return F.broadcast(table)


def ids_of(df: DataFrame) -> list[str]:
    """The columns that tell rows apart: their identifier, or the values of a demand."""
    return [c for c in df.columns if c == ROW_ID or c.startswith(KEY)]


def chain_of(df: DataFrame) -> list[str]:
    return [*ids_of(df), "chain_order"]


def rows_of(df: DataFrame) -> Column:
    """How many rows a row stands for: the count of a demand, else one."""
    return (F.col(ROWS) if ROWS in df.columns else F.lit(1)).cast("bigint").alias("rows")


def planned_steps(
    df: DataFrame, rules: list[Rule], mode: str, row_id: str | None, any_mode: bool = False
) -> DataFrame:
    """One row per table row and applicable rule step, with the number of rows it stands for.

    The steps of a mode are built only for rows of that mode; with ``any_mode`` every row gets
    the steps of all modes. Without ``row_id`` the rows are a demand and known by its values.
    """
    identity = [F.col(row_id).alias(ROW_ID)] if row_id else [F.col(c) for c in ids_of(df)]
    orders = chain_orders(rules)
    by_mode: dict[str, list[Column]] = defaultdict(list)
    for index, rule in enumerate(rules):
        step = F.when(_condition(df, rule), _step(df, rule, index, orders[rule.chain]))
        by_mode[rule.mode].append(step)
    if any_mode:
        all_steps = F.array(*[step for steps in by_mode.values() for step in steps])
    else:
        all_steps = F.coalesce(
            *[
                F.when(F.col(mode).cast("string") == m, F.array(*steps))
                for m, steps in by_mode.items()
            ]
        )
    return (
        df.select(*identity, rows_of(df), F.explode(all_steps).alias("_s"))
        .filter(F.col("_s").isNotNull())
        .select("*", "_s.*")
        .drop("_s")
    )


def matrix_offsets(steps: DataFrame) -> DataFrame:
    """0 or 1 per matrix without a zone map: 0 when its zones fit as indices and a 0 occurs."""
    o, d = F.col("origin").cast("bigint"), F.col("destination").cast("bigint")
    fits = (
        (F.min(o) >= 0)
        & (F.min(d) >= 0)
        & (F.max(o) < F.max("size"))
        & (F.max(d) < F.max("size"))
        & (F.count_if((o == 0) | (d == 0)) > 0)
    )
    return (
        steps.filter(F.col("source_kind") == OD_MATRIX)
        .groupBy("source_id")
        .agg(F.when(fits, 0.0).otherwise(1.0).alias("_offset"))
    )


def close_to_any(value: Column, targets: Column) -> Column:
    """Within 1e-8 + 1e-5 x |target| of a listed value."""
    return F.exists(targets, lambda s: F.abs(value - s) <= 1e-8 + 1e-5 * F.abs(s))


STEP_COLUMNS = (
    "rows",
    "rule_index",
    "chain_order",
    "step",
    "origin",
    "destination",
    "matrix_name",
)


def _sentinel_hit(value: Column, rules: list[Rule]) -> Column:
    """Whether a value is one of the sentinels of its rule."""
    by_values: dict[tuple[float, ...], list[int]] = defaultdict(list)
    for index, rule in enumerate(rules):
        if rule.sentinels:
            by_values[rule.sentinels].append(index)
    hit = F.lit(False)
    for sentinels, indices in by_values.items():
        targets = F.array(*[F.lit(float(v)) for v in sentinels])
        hit = hit | (F.col("rule_index").isin(*indices) & close_to_any(value, targets))
    return hit


def executed_steps(steps: DataFrame, rules: list[Rule], sources: LookupSources) -> DataFrame:
    """Executed steps with ``value``, ``valid`` and, when not valid, the reason.

    A step of a chain is executed only where no step before it was valid.
    """
    sources = sources.referenced_by([r.matrix for r in rules])
    # The catalogue and the offsets have one row per lookup source: both are broadcast.
    located = steps.join(F.broadcast(sources.catalogue()), "matrix_name", "left")
    shift: Column = F.lit(0.0)
    if any(m.zone_map is None for m in sources.matrices):
        located = located.join(F.broadcast(matrix_offsets(located)), "source_id", "left")
        shift = F.coalesce("_offset", F.lit(0.0))
    keyed = located.withColumn("_o", F.col("origin") - shift).withColumn(
        "_d",
        F.when(F.col("source_kind") == KEYED, NO_DESTINATION).otherwise(
            F.col("destination") - shift
        ),
    )
    keyed = cut_lineage(keyed)  # every level reads the steps of the demand
    orders = chain_orders(rules)
    levels = sorted({r.step for r in rules})
    done: list[DataFrame] = []
    for level in levels:
        outcome = looked_up_steps(keyed.filter(F.col("step") == level), rules, sources)
        further = sorted({orders[r.chain] for r in rules if r.step > level})
        if further:
            outcome = cut_lineage(outcome)  # read as a result and for what remains
            solved = outcome.filter(F.col("valid") & F.col("chain_order").isin(*further))
            left = keyed.filter(F.col("step") > level)
            keyed = joined_by_values(left, solved, chain_of(left), chain_of(left), "left_anti")
        done.append(outcome)
    return reduce(DataFrame.unionByName, done)


def looked_up_steps(steps: DataFrame, rules: list[Rule], sources: LookupSources) -> DataFrame:
    """Outcome of steps; only distinct demand is looked up, and only what can be."""
    keys = ["source_id", "_o", "_d"]
    can = F.lit(True)
    for name in keys:
        can = can & F.col(name).isNotNull()
    can = can & F.col("reason").isNull()
    asked = steps.filter(can)
    demand = asked.select(F.col("source_id"), F.col("_o").alias("o"), F.col("_d").alias("d"))
    values = sources.answers(demand.distinct()).select(
        "source_id", F.col("o").alias("_o"), F.col("d").alias("_d"), F.col("value").alias("_raw")
    )
    rest = steps.filter(~can).withColumn("_raw", F.lit(None).cast("double"))
    found = asked.join(values, keys, "left").unionByName(rest)
    raw = F.col("_raw")
    sentinel = raw.isNotNull() & ~F.isnan(raw) & _sentinel_hit(raw, rules)
    valid = raw.isNotNull() & ~sentinel & F.col("reason").isNull()
    outcome = (
        F.when(F.col("reason").isNotNull(), F.col("reason"))
        .when(F.col("source_kind").isNull() | (F.col("source_kind") == AMBIGUOUS), MISSING_MATRIX)
        .when(raw.isNull(), MISSING_OD)
        .when(sentinel, SENTINEL)
    )
    planned = F.col("reason").isNull()
    return found.select(
        *ids_of(steps),
        *STEP_COLUMNS,
        F.when(valid, raw).alias("value"),
        valid.alias("valid"),
        outcome.alias("reason"),
        planned.alias("planned"),
        (planned & F.col("source_kind").isNotNull()).alias("looked_up"),
    )


def check_ambiguous(rules: list[Rule], sources: LookupSources) -> None:
    """Fail early when a fixed matrix name of a rule is ambiguous."""
    counts: dict[str, list[str]] = defaultdict(list)
    for name, qualified, _, _ in sources.records():
        counts[name].append(qualified)
    for rule in rules:
        pattern = ".+".join(map(re.escape, PLACEHOLDER.split(rule.matrix)[::2]))
        for name, files in counts.items():
            if len(files) > 1 and re.fullmatch(pattern, name):
                raise AmbiguousSourceError(
                    f"{name!r} is ambiguous; qualify it with one of: {', '.join(sorted(files))}"
                )


def resolved_values(attempts: DataFrame) -> DataFrame:
    """The valid step of every chain that has one: one row per (row, chain)."""
    return attempts.filter("valid").select(*chain_of(attempts), "rule_index", "value")


def combined_values(resolved: DataFrame, rules: list[Rule]) -> DataFrame:
    """One value per (row, mode, output): the sum of its chains, or the first chain's."""
    texts = rule_texts(resolved, rules).select("rule_index", "mode", "output", "combine")
    value = F.when(F.min("combine") == "sum", F.sum("value")).otherwise(
        F.min_by("value", "chain_order")
    )
    return (
        resolved.join(texts, "rule_index")
        .groupBy(*ids_of(resolved), "mode", "output")
        .agg(value.alias("value"))
        .withColumn("value", F.when(~F.isnan("value"), F.col("value")))
    )


def output_columns(combined: DataFrame, outputs: list[str]) -> DataFrame:
    """One column per known output, by a pivot with listed values."""
    return combined.groupBy(*ids_of(combined)).pivot("output", outputs).agg(F.first("value"))


def joined_by_values(
    rows: DataFrame, found: DataFrame, own: list[str], keys: list[str], how: str
) -> DataFrame:
    """Rows joined with what was found for the values of their columns ``own``; null equals null."""
    named = [F.col(f"`{k}`").alias(f"_on_{i}") for i, k in enumerate(keys)]
    rest = [] if how == "left_anti" else [F.col(f"`{c}`") for c in found.columns if c not in keys]
    found = found.select(*named, *rest)
    same = reduce(
        Column.__and__, [rows[f"`{c}`"].eqNullSafe(found[f"_on_{i}"]) for i, c in enumerate(own)]
    )
    joined = rows.join(found, same, how)
    return joined.drop(*[f"_on_{i}" for i in range(len(keys))])


@dataclass(frozen=True)
class Annotated:
    """The table with its outputs, and the attempts of its demand (``row_id``: the demand's values)."""

    table: DataFrame
    demand_attempts: DataFrame
    resolved: DataFrame
    base: DataFrame
    keys: list[str]
    row_id: str

    def by_row(self, report: DataFrame, column: str = ROW_ID) -> DataFrame:
        """A report of the demand as one of the table's rows, known by ``column``."""
        ids = with_keys(self.base, self.keys, [F.col(self.row_id).cast("bigint").alias("_id")])
        found = joined_by_values(ids, report.drop("rows"), key_names(self.keys), key_names(self.keys), "inner")
        others = [F.col(f"`{c}`") for c in report.columns if c not in {"rows", *ids_of(report)}]
        return found.select(F.col("_id").alias(column), F.lit(1).cast("bigint").alias("rows"), *others)

    @property
    def attempts(self) -> DataFrame:
        """The attempts of every row."""
        return self.by_row(self.demand_attempts)


def key_names(keys: list[str]) -> list[str]:
    return [f"{KEY}{i}" for i in range(len(keys))]


def with_keys(df: DataFrame, keys: list[str], columns: list[Column]) -> DataFrame:
    """The keys under names of their own, and further columns."""
    return df.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, key_names(keys))], *columns)


def demand_of(table: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct values of the keys and their rows; each value also under the name of its key."""
    named = with_keys(table, keys, [])
    counted = named.groupBy(*key_names(keys)).agg(F.count(F.lit(1)).alias(ROWS))
    return counted.select("*", *[F.col(n).alias(k) for k, n in zip(keys, key_names(keys))])


def needed_names(rules: list[Rule]) -> set[str]:
    return set().union(*(r.needed_columns() for r in rules)) if rules else set()


def trip_keys(trips: DataFrame, rules: list[Rule], mode: str | None) -> list[str]:
    """Columns of trips that decide what is looked up."""
    wanted = needed_names(rules) | {mode}
    return [c for c in trips.columns if c in wanted]


def tour_keys(tours: DataFrame, rules: list[Rule], mode: str | None) -> list[str]:
    """Columns of tours that decide what is looked up for their two directions."""
    needed = needed_names(rules)
    wanted = (needed | {mode}) - {*LEG_SOURCES, "outbound", TOUR_DIRECTION}
    for name, sources in LEG_SOURCES.items():
        if name in needed or name in ("OTAZ", "DTAZ"):
            wanted.update([c for c in sources if c in tours.columns][:1])
    return [c for c in tours.columns if c in wanted]


def annotate(
    base: DataFrame,
    keys: list[str],
    context: Callable[[DataFrame], DataFrame],
    rules: list[Rule],
    sources: LookupSources,
    mode: str,
    row_id: str,
) -> Annotated:
    """The base table with lookup outputs, and the attempts for reports."""
    check_ambiguous(rules, sources)
    steps = planned_steps(context(demand_of(base, keys)), rules, mode, None)
    attempts = executed_steps(steps, rules, sources)
    resolved = resolved_values(attempts)
    outputs = list(dict.fromkeys(r.output for r in rules))
    wide = output_columns(combined_values(resolved, rules), outputs)
    kept = base.drop(*[o for o in outputs if o in base.columns])
    named = attempts.join(rule_texts(attempts, rules), "rule_index")
    table = joined_by_values(kept, wide, keys, key_names(keys), "left")
    return Annotated(table, named, resolved, base, keys, row_id)


def _as_is(demand: DataFrame) -> DataFrame:
    return demand


def annotate_trips(trips, rules: RuleSet, sources, mode="trip_mode", row_id="trip_id"):
    keys = trip_keys(trips, rules.trips, mode)
    return annotate(trips, keys, _as_is, rules.trips, sources, mode, row_id)


def annotate_tours(tours, rules: RuleSet, sources, mode="tour_mode", row_id="tour_id"):
    keys = tour_keys(tours, rules.tours, mode)
    return annotate(tours, keys, tour_context, rules.tours, sources, mode, row_id)


# Where the columns of a tour's direction come from, the first that there is.
LEG_SOURCES = {
    "OTAZ": ("OTAZ", "origin"),
    "DTAZ": ("DTAZ", "destination"),
    "o_maz": ("o_maz", "OTAZ", "origin"),
    "d_maz": ("d_maz", "DTAZ", "destination"),
    "depart": ("depart", "start", "start_hour"),
}


def tour_context(tours: DataFrame) -> DataFrame:
    """Both directions of every tour; inbound swaps origin and destination."""

    def first(*names: str) -> Column:
        present = [n for n in names if n in tours.columns]
        if not present:
            raise ValueError(f"tours need one of {', '.join(names)}")
        return F.col(present[0]).cast("double")

    depart = next((c for c in LEG_SOURCES["depart"] if c in tours.columns), None)
    ends = {name: first(*names) for name, names in LEG_SOURCES.items() if name != "depart"}
    swap = {"OTAZ": "DTAZ", "DTAZ": "OTAZ", "o_maz": "d_maz", "d_maz": "o_maz"}
    legs = F.array(
        *[
            F.struct(
                F.lit(direction).alias(TOUR_DIRECTION),
                F.lit(direction == "outbound").alias("outbound"),
                (F.col(depart) if depart else F.lit(None).cast("int")).alias("depart"),
                *[
                    ends[name if direction == "outbound" else swap[name]].alias(name)
                    for name in ends
                ],
            )
            for direction in ("outbound", "inbound")
        ]
    )
    kept = [c for c in tours.columns if c not in {*ends, "outbound", "depart", TOUR_DIRECTION}]
    quoted = [F.col(f"`{c}`") for c in kept]
    return tours.select(*quoted, F.explode(legs).alias("_leg")).select(*quoted, "_leg.*")


def demanded_pairs(inputs: list[tuple[DataFrame, list[Rule]]]) -> DataFrame:
    """Distinct (o, d) pairs any rule of any table asks for."""
    frames = []
    for df, rules in inputs:
        pairs = {
            (r.origin, r.destination)
            for r in rules
            if not r.by_key and {r.origin, r.destination} <= set(df.columns)
        }
        if pairs:
            entries = F.array(
                *[
                    F.struct(
                        F.col(o).cast("double").alias("o"), F.col(d).cast("double").alias("d")
                    )
                    for o, d in sorted(pairs)
                ]
            )
            frames.append(df.select(F.explode(entries).alias("_p")).select("_p.o", "_p.d"))
    if not frames:
        return inputs[0][0].sparkSession.createDataFrame([], "o double, d double")
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return result.filter(F.col("o").isNotNull() & F.col("d").isNotNull()).distinct()


# --- hypothetical modes ---------------------------------------------------------------------


def looked_up_demand(
    demand: DataFrame, context: Callable, rules: list[Rule], sources: LookupSources, mode: str
) -> DataFrame:
    """Value by mode and output of a demand under every rule mode."""
    steps = planned_steps(context(demand), rules, mode, None, any_mode=True)
    attempts = executed_steps(steps, rules, sources)
    return combined_values(resolved_values(attempts), rules)


def demand_components(demand: DataFrame, values: DataFrame, rules: list[Rule]) -> DataFrame:
    """Hypothetical mode, component and value of a demand for every available component.

    A component that some row has a value of is available; a row without one has a null there.
    """
    pairs = sorted({(r.mode, r.output) for r in rules})
    grid = F.array(*[F.struct(F.lit(m).alias("mode"), F.lit(o).alias("output")) for m, o in pairs])
    # At most one row per configured mode and output: broadcast.
    available = values.select("mode", "output").distinct()
    ids = ids_of(demand)
    laid_out = demand.select(*ids, F.explode(grid).alias("_g")).select(*ids, "_g.mode", "_g.output")
    laid_out = laid_out.join(F.broadcast(available), ["mode", "output"], "left_semi")
    found = joined_by_values(laid_out, values, [*ids, "mode", "output"], [*ids, "mode", "output"], "left")
    return found.select(
        *ids, F.col("mode").alias("hypothetical_mode"), F.col("output").alias("component"), "value"
    )


def hypothetical_values(
    table: DataFrame,
    keys: list[str],
    context: Callable[[DataFrame], DataFrame],
    rules: list[Rule],
    sources: LookupSources,
    mode: str,
    row_id: str,
) -> DataFrame:
    """Every row under every rule mode, in long form, with its observed mode and weight."""
    demand = demand_of(table, keys)
    values = looked_up_demand(demand, context, rules, sources, mode)
    observed = [
        F.col(row_id).cast("bigint").alias(row_id),
        F.col(mode).cast("string").alias("observed_mode"),
        F.col("finalweight").cast("double").alias("finalweight"),
    ]
    rows, names = with_keys(table, keys, observed), key_names(keys)
    found = joined_by_values(rows, demand_components(demand, values, rules), names, names, "inner")
    return found.select(
        row_id, "observed_mode", "hypothetical_mode", "component", "value", "finalweight"
    )


def hypothetical_frequencies(
    table: DataFrame,
    keys: list[str],
    context: Callable[[DataFrame], DataFrame],
    rules: list[Rule],
    sources: LookupSources,
    mode: str,
) -> DataFrame:
    """Rows ``n`` and summed weights per observed mode, hypothetical mode, component and value.

    Weights are summed over the demand first, so there are never rows times modes.
    """
    names = key_names(keys)
    observed = [F.col(mode).cast("string").alias("observed_mode"), F.col("finalweight").cast("double")]
    weighted = (
        with_keys(table, keys, observed)
        .groupBy(*names, "observed_mode")
        .agg(F.count(F.lit(1)).alias("_n"), F.sum("finalweight").alias("_w"))
    )
    demand = demand_of(weighted.withColumnsRenamed(dict(zip(names, keys))), keys)
    values = looked_up_demand(demand, context, rules, sources, mode)
    found = joined_by_values(weighted, demand_components(demand, values, rules), names, names, "inner")
    return found.groupBy("observed_mode", "hypothetical_mode", "component", "value").agg(
        F.sum("_n").alias("n"), F.sum("_w").alias("finalweight")
    )


def trip_hypotheticals(trips, rules: RuleSet, sources, mode="trip_mode") -> DataFrame:
    keys = trip_keys(trips, rules.trips, None)
    return hypothetical_values(trips, keys, _as_is, rules.trips, sources, mode, "trip_id")


def trip_hypothetical_frequencies(trips, rules: RuleSet, sources, mode="trip_mode") -> DataFrame:
    keys = trip_keys(trips, rules.trips, None)
    return hypothetical_frequencies(trips, keys, _as_is, rules.trips, sources, mode)


def with_direction(components: DataFrame) -> DataFrame:
    """The direction that a tour's component ends in."""
    direction = F.when(F.col("component").endswith("_outbound"), "outbound").when(
        F.col("component").endswith("_inbound"), "inbound"
    )
    return components.withColumn("direction", direction)


def tour_hypotheticals(tours, rules: RuleSet, sources, mode="tour_mode") -> DataFrame:
    keys = tour_keys(tours, rules.tours, None)
    return with_direction(
        hypothetical_values(tours, keys, tour_context, rules.tours, sources, mode, "tour_id")
    )


def tour_hypothetical_frequencies(tours, rules: RuleSet, sources, mode="tour_mode") -> DataFrame:
    keys = tour_keys(tours, rules.tours, None)
    return with_direction(
        hypothetical_frequencies(tours, keys, tour_context, rules.tours, sources, mode)
    )


# --- reports --------------------------------------------------------------------------------


def used_attempts(attempts: DataFrame) -> DataFrame:
    """Attempts up to the step that resolved the chain, with that step (null if none did)."""
    chain = Window.partitionBy(*chain_of(attempts))
    solved = F.min(F.when(F.col("valid"), F.col("step"))).over(chain)
    return attempts.withColumn("resolved_step", solved)


def lookup_summary(attempts: DataFrame) -> DataFrame:
    """Rows, mean, range and missing count per rule and matrix of the executed lookups."""
    executed = used_attempts(attempts).filter(
        F.col("looked_up")
        & (F.col("resolved_step").isNull() | (F.col("step") <= F.col("resolved_step")))
    )
    value = F.when(~F.isnan("value"), F.col("value"))
    weight = F.when(value.isNotNull(), F.col("rows"))
    return executed.groupBy("rule_name", "mode", "component", "output", "matrix_name").agg(
        F.sum("rows").alias("n_trips"),
        F.try_divide(F.sum(value * weight), F.sum(weight)).alias("mean_value"),
        F.min(value).alias("min_value"),
        F.max(value).alias("max_value"),
        F.sum(F.when(F.col("valid"), 0).otherwise(F.col("rows"))).alias("n_missing"),
    )


FAILURE = ("rule_name", "origin", "destination", "matrix_name", "reason", "step", "output")


def final_failures(attempts: DataFrame) -> DataFrame:
    """Last failure of every chain no step resolved; an executed step counts before a planned one."""
    unresolved = used_attempts(attempts).filter(F.col("resolved_step").isNull())
    last = F.max_by(
        F.struct(*FAILURE), F.struct(F.col("planned").cast("int"), F.col("step"))
    )
    return (
        unresolved.groupBy(*chain_of(attempts))
        .agg(last.alias("_f"), F.max("rows").alias("rows"))
        .select(*chain_of(attempts), "rows", "_f.*")
    )


def row_named(attempts: DataFrame, name: str) -> list[Column]:
    """Identifier columns of a report: the row's under its name, or those of the demand."""
    return [F.col(c).alias(name) if c == ROW_ID else F.col(c) for c in ids_of(attempts)]


def missing_report(attempts: DataFrame) -> DataFrame:
    """Chains that no step answered, by row (``trip_id``) or by demand."""
    return final_failures(attempts).select(
        *row_named(attempts, "trip_id"),
        "rows",
        "rule_name",
        F.col("origin").cast("bigint").alias("origin"),
        F.col("destination").cast("bigint").alias("destination"),
        "matrix_name",
        "reason",
    )


def skipped_rules(missing: DataFrame) -> DataFrame:
    """How often each rule ended in each reason."""
    return missing.groupBy("rule_name", "reason").agg(F.sum("rows").alias("count"))


def fallback_report(attempts: DataFrame, rules: list[Rule], table_name: str) -> DataFrame:
    """Rows a fallback step resolved, and rows that exhausted all steps of a fallback chain."""
    orders = chain_orders(rules)
    eligible = sorted({orders[r.chain] for r in rules if r.step > 0})
    scoped = used_attempts(attempts).filter(F.col("chain_order").isin(*eligible))
    step, solved = F.col("step"), F.col("resolved_step")
    earlier = ~F.col("valid") & (solved.isNull() | (step < solved))
    history = scoped.groupBy(*chain_of(scoped), "rows", "direction", "output", "resolved_step").agg(
        F.max(F.when(earlier & (step == 0), F.col("matrix_name"))).alias("primary_matrix_name"),
        F.max_by("reason", F.when(earlier, step)).alias("_last_reason"),
        F.max(F.when(step == solved, F.struct("rule_name", "matrix_name", "step"))).alias("_hit"),
        F.max_by(
            F.struct("rule_name", "matrix_name", "step", "reason"),
            F.struct(F.col("planned").cast("int"), step),
        ).alias("_last"),
    )
    done = solved.isNotNull()
    return history.filter(solved.isNull() | (solved > 0)).select(
        *row_named(attempts, "logical_id"),
        F.lit(table_name).alias("table_name"),
        "rows",
        F.when(done, F.col("_hit.rule_name")).otherwise(F.col("_last.rule_name")).alias("rule_name"),
        "output",
        "direction",
        "primary_matrix_name",
        F.when(done, F.col("_hit.matrix_name"))
        .otherwise(F.col("_last.matrix_name"))
        .alias("fallback_matrix_name"),
        F.when(done, F.col("_hit.step")).otherwise(F.col("_last.step")).alias(
            "fallback_step_index"
        ),
        F.when(done, F.col("_last_reason")).otherwise(F.col("_last.reason")).alias(
            "fallback_reason"
        ),
        done.alias("fallback_succeeded"),
        (~done).alias("fallback_exhausted"),
    )


# --- checks ---------------------------------------------------------------------------------


def uncovered_modes(df: DataFrame, mode: str, rules: list[Rule], ignored=()) -> DataFrame:
    """Observed modes no rule covers, with their record count."""
    covered = sorted({r.mode for r in rules} | set(ignored))
    return (
        df.filter(F.col(mode).isNotNull() & ~F.col(mode).cast("string").isin(*covered))
        .groupBy(F.col(mode).cast("string").alias("mode"))
        .agg(F.count(F.lit(1)).alias("records"))
    )


def uncovered_segments(df: DataFrame, mode: str, rules: RuleSet) -> DataFrame:
    """Observed segment values of a mode that no rule lists."""
    entries = [
        F.when(
            (F.col(mode) == m) & F.col(c).isNotNull() & ~F.col(c).isin(*[F.lit(v) for v in values]),
            F.struct(F.lit(m).alias("mode"), F.col(c).cast("string").alias("segment")),
        )
        for m, (c, values) in rules.segments.items()
        if c in df.columns
    ]
    return (
        df.select(F.explode(F.array(*entries)).alias("_s"))
        .filter(F.col("_s").isNotNull())
        .groupBy("_s.mode", "_s.segment")
        .agg(F.count(F.lit(1)).alias("records"))
    )


def zones_out_of_bounds(steps: DataFrame, sources: LookupSources) -> DataFrame:
    """Rows of planned steps per matrix whose zones are missing, not numbers, below 1 or above its size."""
    matrices = sources.catalogue().filter(F.col("source_kind") == OD_MATRIX)
    sized = steps.join(F.broadcast(matrices), "matrix_name")
    outside = F.lit(False)
    for column in ("origin", "destination"):
        zone = F.col(column).try_cast("double")
        outside = outside | F.coalesce(
            F.isnan(zone) | (zone < 1) | (zone > F.col("size")), F.lit(True)
        )
    return sized.groupBy("matrix_name").agg(
        F.sum("rows").alias("lookups"),
        F.sum(F.when(outside, F.col("rows")).otherwise(0)).alias("out_of_bounds"),
    )


class LookupPolicyError(ValueError):
    """A lookup check failed under the error policy."""


def apply_policy(report: DataFrame, policy: str, what: str) -> DataFrame:
    """``error`` raises when the report has rows; ``warn`` and ``set_null`` return it."""
    if policy == "error":
        bad = report.limit(5).collect()
        if bad:
            raise LookupPolicyError(f"{what}: {[r.asDict() for r in bad]}")
    return report
