"""Shape and column kinds of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from tableops.columns import is_numeric, is_text


def kind(data_type: T.DataType) -> str:
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if is_numeric(data_type):
        return "numeric"
    if is_text(data_type):
        return "text"
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    return "other"


def numeric_columns(df: DataFrame) -> list[str]:
    """Columns that can be summed; booleans count as numbers."""
    return [f.name for f in df.schema if kind(f.dataType) in ("numeric", "boolean")]


def shape(df: DataFrame) -> DataFrame:
    """One row: ``n_rows``, ``n_columns``."""
    return df.agg(F.count("*").alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


def column_profile(df: DataFrame) -> DataFrame:
    """One row per column: position, name, kind, and the table's row count."""
    described = F.array(
        *[
            F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("name"), F.lit(kind(f.dataType)).alias("kind"))
            for i, f in enumerate(df.schema)
        ]
    )
    counted = df.agg(F.count("*").alias("n_rows"))
    return counted.select(F.inline(described), "n_rows")
