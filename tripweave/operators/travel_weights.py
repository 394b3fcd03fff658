"""Person-travel and household-tour weights of joint travel.

Only joint records need a join. They are split off, joined on their tour, and put back, so
individual travel (the bulk) is never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripweave.functions.expressions import (
    NOT_APPLICABLE_CODE,
    is_joint,
    joint_party_size,
    valid_identifier,
)
from tripweave.model import Run


def stated_party_weight(
    df: DataFrame,
    participant_column: str,
    weight: str = "finalweight",
    category: str = "tour_category",
) -> Column:
    """Record weight, multiplied by a valid stated party size on joint records."""
    w = F.col(weight).cast("double")
    if category not in df.columns or participant_column not in df.columns:
        return w
    party = F.col(participant_column).try_cast("double")
    valid = (party > 0) & (party < NOT_APPLICABLE_CODE)
    return F.when(is_joint(category), w * F.when(valid, party).otherwise(1.0)).otherwise(w)


def participant_weights(run: Run, weights: dict[str, str]) -> DataFrame:
    """Sums of the participants' person weights per joint tour, null where none is known.

    ``weights`` maps weight columns of persons to output columns.
    """
    persons = run.per.filter(F.col("person_id").isNotNull()).select(
        "person_id",
        *run.by,
        *[F.col(w).cast("double").alias(name) for w, name in weights.items()],
    )
    return (
        run.joint_participants.filter(F.col("tour_id").isNotNull())
        .select("tour_id", "person_id", *run.by)
        .join(persons, ["person_id", *run.by])
        .groupBy("tour_id", *run.by)
        .agg(*[F.sum(name).alias(name) for name in weights.values()])
    )


def attach_person_travel_weights(
    run: Run,
    activity: DataFrame,
    participant_column: str,
    weights: dict[str, str],
    category: str = "tour_category",
) -> DataFrame:
    """Add person-tour or person-trip weights to every record, one output per weight column.

    All of them come from one join, so several weighting modes cost what one costs.
    """
    stated = {
        name: stated_party_weight(activity, participant_column, weight, category)
        for weight, name in weights.items()
    }
    attributable = (
        {category, "tour_id"} <= set(activity.columns)
        and run.has("joint_participants", "tour_id", "person_id")
        and run.has("per", "person_id", *weights)
    )
    if not attributable:
        return activity.withColumns(stated)
    attributed = {name: f"_participants_{name}" for name in stated}
    sums = participant_weights(run, {w: attributed[name] for w, name in weights.items()})
    joint = (
        activity.filter(is_joint(category))
        .join(sums, ["tour_id", *run.by], "left")
        .withColumns({n: F.coalesce(F.col(attributed[n]), w) for n, w in stated.items()})
        .drop(*attributed.values())
    )
    return activity.filter(~is_joint(category)).withColumns(stated).unionByName(joint)


def attach_person_travel_weight(
    run: Run,
    activity: DataFrame,
    participant_column: str,
    output: str,
    category: str = "tour_category",
) -> DataFrame:
    """Add a person-tour or person-trip weight to every record."""
    weights = {"finalweight": output}
    return attach_person_travel_weights(run, activity, participant_column, weights, category)


def with_household_tour_weights(
    tours: DataFrame,
    weights: dict[str, str],
    category: str = "tour_category",
    joint_id: str = "joint_tour_id",
    by: tuple[str, ...] = (),
) -> DataFrame:
    """Add household-tour weights, one output per weight column: a joint tour stored as one row
    per participant counts once, by dividing the weight by the rows of a complete group.

    Groups are told apart by ``by`` columns as well.
    """
    own = {name: F.col(w).cast("double") for w, name in weights.items()}
    if not {category, joint_id} <= set(tours.columns):
        return tours.withColumns(own)
    party = joint_party_size(tours.columns)
    grouped = tours.filter(valid_identifier(joint_id))
    complete = (
        grouped.groupBy(joint_id, *by)
        .agg(
            F.sum(F.when(is_joint(category), 1.0).otherwise(0.0)).alias("_rows"),
            F.min(party).alias("_smallest"),
            F.max(party).alias("_largest"),
        )
        .filter("_rows > 1 AND _smallest = _rows AND _largest = _rows")
        .select(joint_id, *by, "_rows")
    )
    in_scope = is_joint(category) & valid_identifier(joint_id)
    members = F.coalesce(F.col("_rows"), F.lit(1.0))
    shared = (
        tours.filter(in_scope)
        .join(complete, [joint_id, *by], "left")
        .withColumns({name: w / members for name, w in own.items()})
        .drop("_rows")
    )
    return tours.filter(~in_scope).withColumns(own).unionByName(shared)


def with_household_tour_weight(
    tours: DataFrame,
    output: str = "_tour_weight",
    weight: str = "finalweight",
    category: str = "tour_category",
    joint_id: str = "joint_tour_id",
) -> DataFrame:
    """Add the household-tour weight of one weight column."""
    return with_household_tour_weights(tours, {weight: output}, category, joint_id)
