"""Cutting long plans between preparation stages."""

from __future__ import annotations

from pyspark.sql import DataFrame


def cut_lineage(df: DataFrame) -> DataFrame:
    """The same rows read from a reliable checkpoint, so later plans start from here.

    The folder is the one the session names in spark.checkpoint.dir (or set on its context). Where
    none is set the plan stays as it is.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            return df
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
