"""Preparation of a raw run: the stages in order, each a plain function of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tripweave.model import Config, Run, first_column
from tripweave.operators.columns import (
    CategoryMapping,
    canonicalize_run,
    cast_prepared,
    map_categories,
)
from tripweave.operators.escort_events import events_by_participants, events_by_tour_links
from tripweave.operators.persons import (
    add_day_person_type,
    add_student_enrollment,
    enrich_households,
    enrich_persons,
)
from tripweave.operators.tours import add_time_periods, enrich_tours, normalize_escort_fields
from tripweave.operators.trips import add_walk_distance, enrich_trips
from tripweave.operators.weights import WeightColumns, compute_weights
from tripweave.operators.zones import Skim
from tripweave.sources.lineage import cut_lineage
from tripweave.plans.summaries.vehicles import split_vehicle_type


def split_vehicles(vehicles: DataFrame) -> DataFrame:
    """Vehicle type text as body, age and fuel."""
    if "vehicle_type" not in vehicles.columns:
        return vehicles
    return vehicles.withColumns(split_vehicle_type("vehicle_type"))


def prepare(
    run: Run,
    config: Config,
    skim: Skim | None = None,
    weights: WeightColumns = WeightColumns(),
    periods: DataFrame | None = None,
    walk_distances: DataFrame | None = None,
    categories: dict[str, list[CategoryMapping]] | None = None,
) -> Run:
    """Canonical columns, weights, zones, households to trips, periods and final types.

    Each stage reads the checkpointed result of the one before, so plans stay small however
    many lookups are configured, and a lost executor repeats one stage at most.
    """
    for table, specs in (categories or {}).items():
        df = run.tables.get(table)
        if df is not None:
            for spec in specs:
                df = map_categories(df, spec)
            run = run.with_tables(**{table: df})
    run = canonicalize_run(run, config)
    run = run.with_tables(tours=normalize_escort_fields(run.tours, config))
    run = compute_weights(run, config, weights)
    taz = first_column(run.land_use.columns, ("TAZ",))
    if skim is not None and taz:
        skim = skim.for_zones(run.land_use, taz)
    run = enrich_persons(enrich_households(run, config), config, skim)
    run = add_student_enrollment(run, config)
    run = run.with_tables(hh=cut_lineage(run.hh), per=cut_lineage(run.per))
    if run.day is not None:
        run = run.with_tables(day=add_day_person_type(run))
    if run.vehicles is not None:
        run = run.with_tables(vehicles=split_vehicles(run.vehicles))
    run = enrich_tours(run, config, skim)
    run = run.with_tables(tours=cut_lineage(run.tours))
    run = enrich_trips(run, config, skim)
    run = run.with_tables(trips=cut_lineage(run.trips))
    run = run.with_tables(trips=events_by_participants(run))
    run = run.with_tables(trips=events_by_tour_links(run))
    if walk_distances is not None and {"o_maz", "d_maz"} <= set(run.trips.columns):
        run = run.with_tables(trips=add_walk_distance(run.trips, walk_distances))
    if periods is not None:
        run = add_time_periods(run, periods)
    run = cast_prepared(run)
    return run.with_tables(tours=cut_lineage(run.tours), trips=cut_lineage(run.trips))
