"""Result shaping shared by both engines: rounded doubles and exact column types."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from tripweave.schemas import schema_of

DIGITS = 6
SQL_TYPES = {
    "string": "VARCHAR",
    "int": "INTEGER",
    "bigint": "BIGINT",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
}


def rounded(df: DataFrame) -> DataFrame:
    """Measures rounded to six digits, so sums in another order compare equal."""
    return df.select(
        *[
            (F.round(F.col(f"`{f.name}`"), DIGITS) + F.lit(0.0)).alias(f.name)
            if isinstance(f.dataType, DoubleType)
            else F.col(f"`{f.name}`")
            for f in df.schema
        ]
    )


def shaped_sql(body: str, schema: StructType | str) -> str:
    """The same columns, types and rounding in SQL."""
    if isinstance(schema, str):
        schema = schema_of(schema)
    columns = []
    for f in schema:
        name = f'"{f.name}"'
        text = f"CAST({name} AS {SQL_TYPES[f.dataType.simpleString()]})"
        if isinstance(f.dataType, DoubleType):
            text = f"ROUND({text}, {DIGITS}) + 0.0"
        columns.append(f"{text} AS {name}")
    return f"SELECT {', '.join(columns)} FROM ({body}) AS result"
