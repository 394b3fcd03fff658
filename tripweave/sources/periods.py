"""Period table: breakpoints and labels expanded to period numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def period_table(
    spark: SparkSession, breakpoints: Sequence[int], labels: Sequence[str]
) -> DataFrame:
    """(period, label) rows: label i covers breakpoints i to i+1, period numbers from 1."""
    if len(breakpoints) < 2:
        raise ValueError("at least two breakpoints are needed")
    if len(labels) != len(breakpoints) - 1:
        raise ValueError("there must be one label less than breakpoints")
    spans = [
        (int(start), int(stop), str(label))
        for start, stop, label in zip(breakpoints, breakpoints[1:], labels)
        if int(stop) > int(start)
    ]
    return spark.createDataFrame(spans, "start int, stop int, label string").select(
        F.explode(
            F.sequence((F.col("start") + 1).cast("bigint"), F.col("stop").cast("bigint"))
        ).alias("period"),
        "label",
    )
