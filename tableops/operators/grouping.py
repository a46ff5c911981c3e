"""Group by one or more columns and aggregate one metric."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tableops.columns import as_list, col, dtype, free_name, is_numeric, is_text, missing_to_null, require, require_unique
from tableops.functions import exact_sum, to_number

FUNCTIONS = ("sum", "mean", "count", "max", "min")


def summarize(
    df: DataFrame,
    keys: str | Iterable[str],
    metric: str,
    functions: Iterable[str] = ("sum",),
    places: int | None = None,
    sort: bool = False,
) -> DataFrame:
    """``keys`` plus one ``<metric>_<function>`` column per function.

    Text metrics are parsed, cells that are not numbers count as missing. Rows
    with a missing key are left out. The sum of no values is 0; the other
    functions are NULL (count 0). The metric may itself be a key. ``places``
    adds to that many decimals, rounded once, whatever order the tasks finish in.
    Everything is a partial aggregate before the one shuffle on ``keys``, so a
    hot key costs one row per map task.
    """
    keys = require(df, keys, "group column")
    (metric,) = require(df, metric, "metric column")
    functions = as_list(functions)
    if not keys or not functions:
        raise ValueError("give at least one group column and one function")
    unknown = [f for f in functions if f not in FUNCTIONS]
    if unknown:
        raise ValueError(f"unknown functions {unknown}; choose from {FUNCTIONS}")
    outputs = {f: f"{metric}_{f}" for f in functions}
    require_unique([*keys, *outputs.values()], "summarize")

    value, data_type = _number(df, metric)
    inner = free_name("_metric", df.columns)
    narrowed = df.select(*[missing_to_null(df, k).alias(k) for k in keys], value.cast(data_type).alias(inner))
    present = narrowed.filter(reduce(lambda x, y: x & y, [col(k).isNotNull() for k in keys]))
    aggregates = [_aggregate(f, col(inner), data_type, places).alias(outputs[f]) for f in functions]
    result = present.groupBy(*[col(k) for k in keys]).agg(*aggregates)
    return result.orderBy(*[col(k) for k in keys]) if sort else result


def _number(df: DataFrame, metric: str) -> tuple[Column, T.DataType]:
    data_type = dtype(df, metric)
    if is_text(data_type):
        return to_number(col(metric)), T.DoubleType()
    if isinstance(data_type, T.BooleanType):
        return col(metric), T.LongType()
    if is_numeric(data_type):
        return missing_to_null(df, metric), data_type
    raise ValueError(f"metric {metric!r} is {data_type.simpleString()}, not a number or text")


def _aggregate(function: str, value: Column, data_type: T.DataType, places: int | None) -> Column:
    if function == "count":
        return F.count(value)
    if function in ("max", "min"):
        return F.max(value) if function == "max" else F.min(value)
    if places is None:
        return F.coalesce(F.sum(value), F.lit(0).cast("int")) if function == "sum" else F.avg(value)
    if function == "sum":
        return F.coalesce(exact_sum(value, data_type, places).cast("double"), F.lit(0.0))
    # The sum is not rounded to ``places`` first. A mean of no values is missing, not a division by zero.
    return F.try_divide(exact_sum(value, data_type, places + 4).cast("double"), F.count(value))
