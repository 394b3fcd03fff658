"""Flat schemas from text such as ``person_type string, person_count double``."""

from __future__ import annotations

from pyspark.sql.types import (
    BooleanType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

TYPES = {
    "string": StringType(),
    "int": IntegerType(),
    "bigint": LongType(),
    "double": DoubleType(),
    "boolean": BooleanType(),
}


def schema_of(text: str) -> StructType:
    """Parsed without a running session, so schemas can be declared at import time."""
    fields = [part.split() for part in text.split(",")]
    return StructType([StructField(name, TYPES[kind]) for name, kind in fields])
