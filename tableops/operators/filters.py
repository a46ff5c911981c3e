"""Equality filters, their totals and the values to choose from."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, functions as F, types as T

from tableops.columns import as_list, col, dtype, is_floating, literal_fits, missing_to_null, require
from tableops.functions import as_text, exact_sum
from tableops.operators.profile import numeric_columns


def filter_eq(df: DataFrame, filters: Iterable[tuple[str, object]]) -> DataFrame:
    """Rows meeting every ``(column, value)`` pair; a blank value is no condition.

    The value is cast to the column's type and the column stays bare, so the
    predicate reaches the file scan. A value that the type cannot hold as it is
    (8.5 for a whole number, a time for a day, "yes" for a flag) matches nothing.
    """
    filters = list(filters)
    if not filters:
        raise ValueError("give at least one filter")
    conditions = []
    for name, value in filters:
        (name,) = require(df, name, "filter column")
        if value is None or value == "":
            continue
        fits = literal_fits(df.sparkSession, value, [dtype(df, name)])[0]
        conditions.append(col(name) == F.lit(value).try_cast(dtype(df, name)) if fits else F.lit(False))
    return df.filter(reduce(lambda x, y: x & y, conditions)) if conditions else df


def total(df: DataFrame, column: str | None = None, places: int | None = None) -> DataFrame:
    """One row: ``n_rows`` and, for a numeric ``column``, ``total`` and ``total_text``.

    ``places`` adds exactly to that many decimals: money then comes to the same
    cent whatever order the tasks finish in.
    """
    counted = F.count("*").alias("n_rows")
    if column is None:
        return df.agg(counted)
    (column,) = require(df, column, "total column")
    if column not in numeric_columns(df):
        raise ValueError(f"column {column!r} is not numeric")
    value, data_type = missing_to_null(df, column), dtype(df, column)
    if isinstance(data_type, T.BooleanType):
        value = value.cast("bigint")
    summed = F.sum(value) if places is None else exact_sum(value, data_type, places)
    result = df.agg(counted, F.coalesce(summed, F.lit(0).cast("int")).alias("total"))
    result = result.withColumn("total_text", F.format_number("total", 2))
    return result.withColumn("total", F.col("total").cast("double")) if is_floating(data_type) else result


def distinct_values(df: DataFrame, column: str, sort: bool = True) -> DataFrame:
    """Distinct non-missing values of a column as text, ascending."""
    (column,) = require(df, as_list(column))
    value = missing_to_null(df, column)
    text = df.filter(value.isNotNull()).select(as_text(value, dtype(df, column)).alias("value")).distinct()
    return text.orderBy("value") if sort else text
