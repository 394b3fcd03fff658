"""Reusable Column expressions. All are built-in functions, so they stay in generated code."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tripweave.model import ALL_TOUR_PURPOSES, Config

NOT_APPLICABLE_CODE = 995.0

# Purpose aliases that fold into one summary purpose.
SCHOOL_PURPOSES = ("college", "univ", "university")
ATWORK_PURPOSES = ("business", "eat", "maint")

# Child person types, escort tokens after removing "_" and spaces.
CHILD_PERSON_TYPES = ("6", "7", "8")
NOT_ESCORTED_TOKENS = ("", "0", "none", "null", "nan", "notescorted", "noescort")
PURE_ESCORT_TOKENS = ("1", "pureescort")
RIDE_SHARE_TOKENS = ("2", "rideshare")

# Modes with a known vehicle occupancy.
NON_MOTORIZED_MODES = ("BIKE", "EBIKE", "WALK")
OCCUPANCY_ONE = (
    "AUTO SOV",
    "DRIVEALONE",
    "DRIVE_ALONE",
    "PNR_TRANSIT",
    "SOV",
    "TAXI",
    "TNC_SINGLE",
)
OCCUPANCY_TWO = ("AUTO 2 PERSON", "HOV2", "KNR_TRANSIT", "SHARED2", "SHARED_2")
OCCUPANCY_THREE_PLUS = ("AUTO 3+ PERSON", "HOV3", "SHARED3", "SHARED_3")
OCCUPANCY_THREE_PLUS_VALUE = 3.33
AUTO_MODE_PATTERN = "DRIVE|SHARED|SOV|HOV|AUTO|TAXI|TNC"
DRIVE_TRANSIT_PATTERN = "PNR|KNR"

SUBMILE_BIN = ">0-<1"


def zero(column: Column) -> Column:
    return F.coalesce(column, F.lit(0.0))


def total(column: Column | str) -> Column:
    """Sum whose empty or all-null group is 0 rather than null."""
    return zero(F.sum(F.col(column) if isinstance(column, str) else column)).cast("double")


def lowered(column: str | Column) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.lower(column.cast("string"))


def normalized(column: str | Column) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.lower(F.trim(column.cast("string")))


def is_true(column: Column) -> Column:
    return F.coalesce(column, F.lit(False))


def truthy(column: str, tokens: Sequence[str] = ("true", "1", "yes")) -> Column:
    """Token-set truth test for text, number or boolean flags (null stays null)."""
    return lowered(column).isin(*tokens)


def finite(column: Column) -> Column:
    infinite = F.lit(float("inf"))
    return ~F.isnan(column) & (column < infinite) & (column > -infinite)


def clock_to_period(hour: str, minute: str) -> Column:
    """Half-hour period 1..48 counted from 03:00; an invalid clock gives null."""
    h, m = F.col(hour).try_cast("bigint"), F.col(minute).try_cast("bigint")
    since_three = F.pmod(h * 60 + m - 180, F.lit(1440))
    return F.when(
        h.between(0, 23) & m.between(0, 59), F.floor(since_three / 30) + 1
    ).cast("int")


def clip(column: Column, low: int, high: int) -> Column:
    """Bound a value on both sides; null stays null."""
    return F.when(column.isNotNull(), F.greatest(F.least(column, F.lit(high)), F.lit(low)))


def distance_bin_labels(cap: int = 40) -> list[str]:
    return ["0", SUBMILE_BIN, *map(str, range(1, cap)), f"{cap}+"]


def distance_bin(column: str, cap: int = 40) -> Column:
    """Exact zero, under one mile, whole miles, then an open last bin; unusable gives null."""
    d = F.col(column).try_cast("double")
    return (
        F.when(~finite(d) | (d < 0), F.lit(None).cast("string"))
        .when(d == 0, "0")
        .when(d < 1, SUBMILE_BIN)
        .when(d >= cap, f"{cap}+")
        .otherwise(F.floor(d).cast("string"))
    )


def distance_bin_order(column: str = "distance_bin") -> Column:
    """Numeric sort key of the distance-bin labels."""
    number = F.regexp_replace(F.col(column), r"\+$", "").try_cast("double")
    return F.when(F.col(column) == SUBMILE_BIN, 0.5).otherwise(
        F.coalesce(number, F.lit(float("inf")))
    )


def trip_direction(columns: Iterable[str]) -> Column | None:
    """Outbound/inbound label from whichever direction flag exists."""
    if "inbound" in columns:
        inbound = lowered("inbound").isin("1", "true")
    elif "outbound" in columns:
        inbound = lowered("outbound").isin("false", "0")
    else:
        return None
    return F.when(inbound, "inbound").otherwise("outbound")


def summary_purpose(
    columns: Iterable[str], config: Config, source: str = "tour_purpose"
) -> Column:
    """Reporting purpose: school, at-work and joint tours grouped as configured."""
    columns = set(columns)
    purpose = F.col(source).cast("string")
    is_total = normalized(purpose) == ALL_TOUR_PURPOSES
    category = normalized("tour_category") if "tour_category" in columns else None

    result = purpose
    if config.group_school_tour_purposes:
        result = F.when(normalized(purpose).isin(*SCHOOL_PURPOSES), "school").otherwise(result)
    if config.group_atwork_tour_purposes:
        if category is not None:
            at_work = category == "atwork"
        else:
            at_work = normalized(purpose).isin(*ATWORK_PURPOSES)
            if "atwork_subtour_frequency" in columns:
                frequency = normalized("atwork_subtour_frequency")
                at_work = is_true(at_work) | ~frequency.isin("", "no_subtours")
        result = F.when(at_work, "atwork").otherwise(result)
    if category is not None:
        joint_label = (
            F.lit("joint")
            if config.group_joint_tour_purposes
            else F.concat(F.lit("joint_"), result)
        )
        result = F.when(category == "joint", joint_label).otherwise(result)
    return F.when(is_total, purpose).otherwise(result)


def is_joint(column: str = "tour_category") -> Column:
    return is_true(normalized(column) == "joint")


def category_token(column: str = "tour_category") -> Column:
    """Tour category with blanks and dashes written as underscores."""
    return F.regexp_replace(normalized(column), "[- ]", "_")


def joint_party_size(columns: Iterable[str]) -> Column:
    """First stated party size that is a real joint party."""
    candidates = []
    for name in ("number_of_participants", "NUMBER_HH"):
        if name in columns:
            size = F.col(name).try_cast("double")
            candidates.append(
                F.when(finite(size) & (size >= 2) & (size < NOT_APPLICABLE_CODE), size)
            )
    return F.coalesce(*candidates) if candidates else F.lit(None).cast("double")


def valid_identifier(column: str) -> Column:
    """Non-blank id that is not a zero, negative or not-applicable number."""
    text = F.trim(F.col(column).cast("string"))
    number = F.col(column).try_cast("double")
    usable = finite(number) & (number > 0) & (number != NOT_APPLICABLE_CODE)
    return is_true((text != "") & (number.isNull() | usable))


def _escort_token(column: str) -> Column:
    return F.regexp_replace(normalized(column), "[_ ]", "")


def not_escorted(column: str) -> Column:
    return F.col(column).isNull() | _escort_token(column).isin(*NOT_ESCORTED_TOKENS)


def pure_escort(column: str) -> Column:
    return is_true(_escort_token(column).isin(*PURE_ESCORT_TOKENS))


def ride_share(column: str) -> Column:
    return is_true(_escort_token(column).isin(*RIDE_SHARE_TOKENS))


def escort_present(column: str) -> Column:
    return ~not_escorted(column)


def escort_explicit(column: str) -> Column:
    return pure_escort(column) | ride_share(column)


def escort_type(column: str) -> Column:
    """Normalised escort status; an unknown label counts as ride share."""
    return (
        F.when(not_escorted(column), "not_escorted")
        .when(pure_escort(column), "pure_escort")
        .otherwise("ride_share")
    )


def is_child(column: str = "person_type") -> Column:
    return F.col(column).cast("string").isin(*CHILD_PERSON_TYPES)


def is_worker() -> Column:
    return truthy("is_worker", ("true", "1", "yes", "worker"))


def is_student() -> Column:
    return truthy("is_student", ("true", "1", "yes", "student"))


def works_from_home() -> Column:
    return truthy("work_from_home", ("true", "1", "yes", "work_from_home", "home"))


def internal_commuter(columns: Iterable[str]) -> Column | None:
    """Workers with a usual internal workplace outside the home."""
    columns = set(columns)
    if not {"is_worker", "workplace_zone_id", "work_from_home"} <= columns:
        return None
    external: Column | None = None
    if "is_external_worker" in columns:
        external = F.coalesce(
            truthy("is_external_worker", ("true", "1", "yes", "external")), F.lit(True)
        )
    if "external_workplace_zone_id" in columns:
        placed = is_true(F.col("external_workplace_zone_id").try_cast("double") > 0)
        external = placed if external is None else external | placed
    if external is None:
        return None
    return (
        is_worker()
        & (F.col("workplace_zone_id").try_cast("double") > 0)
        & ~works_from_home()
        & ~external
    )


def auto_mode(config: Config, include_drive_transit: bool) -> Column:
    """Personal auto trips, with or without park-and-ride and kiss-and-ride."""
    mode = F.upper(F.col("trip_mode").cast("string"))
    if "Auto" in config.mode_groups:
        eligible = mode.isin(*[str(value).upper() for value in config.mode_groups["Auto"]])
    else:
        eligible = mode.rlike(AUTO_MODE_PATTERN)
    drive_transit = mode.rlike(DRIVE_TRANSIT_PATTERN)
    return eligible | drive_transit if include_drive_transit else eligible & ~drive_transit


def stated_occupancy(columns: Iterable[str]) -> Column:
    """Occupancy from the mode, else from a valid stated party, else 1."""
    mode = F.upper(F.col("trip_mode").cast("string"))
    fallback: Column = F.lit(1.0)
    if "num_participants" in columns:
        party = F.col("num_participants").try_cast("double")
        usable = finite(party) & (party > 0) & (party < NOT_APPLICABLE_CODE)
        fallback = F.when(usable, party).otherwise(1.0)
    return (
        F.when(mode.isin(*OCCUPANCY_ONE), 1.0)
        .when(mode.isin(*OCCUPANCY_TWO), 2.0)
        .when(mode.isin(*OCCUPANCY_THREE_PLUS), OCCUPANCY_THREE_PLUS_VALUE)
        .otherwise(fallback)
    )


def residual_metrics(target: str, modeled: str) -> dict[str, Column]:
    """Modelled minus target, its absolute value, and percent of a positive target."""
    residual = F.col(modeled) - F.col(target)
    return {
        "residual_count": residual.cast("double"),
        "absolute_residual_count": F.abs(residual).cast("double"),
        "percent_error": F.when(F.col(target) > 0, residual / F.col(target) * 100.0).cast(
            "double"
        ),
    }


def integer_text(column: str) -> Column:
    """Identifier as integer text, so 12, "12" and 12.0 compare equal."""
    return F.col(column).try_cast("double").try_cast("bigint").cast("string")
