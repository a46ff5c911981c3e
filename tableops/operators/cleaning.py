"""Cleaning steps, applied in a fixed order: duplicates, missing values, text."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F, types as T

from tableops.columns import (
    free_name,
    literal_fits,
    as_list,
    col,
    dtype,
    is_floating,
    is_text,
    missing_to_null,
    require,
    text_columns,
)
from tableops.functions import as_text, strip_ws

TEXT_ACTIONS = ("strip", "upper", "lower")


@dataclass(frozen=True)
class CleanSpec:
    """What to clean. A step left at its default is not run.

    ``duplicates``: column subset, or ``"*"`` for whole rows.
    ``missing``: ``"drop"`` or ``"fill"`` (with ``fill_value``).
    ``text_actions``: any of strip, upper, lower, on ``text_columns`` (default:
    every text column).
    """

    duplicates: str | tuple[str, ...] | None = None
    order_by: tuple[str, ...] = ()
    missing: str | None = None
    fill_value: str = "0"
    text_columns: tuple[str, ...] | None = None
    text_actions: tuple[str, ...] = ()


def dedupe(df: DataFrame, subset: str | Iterable[str] | None = None, order_by: str | Iterable[str] = ()) -> DataFrame:
    """First row of each ``subset`` group in ``order_by`` order.

    Missing equals missing, and NaN comes out as missing. Remaining columns break ties, so the result is
    the same on every run. Spark keeps one row per group and map task before
    the shuffle (WindowGroupLimit), so a hot group is no burden.
    """
    names = list(df.columns) if subset is None or subset == "*" else require(df, subset)
    if not names:
        return df
    if len(set(names)) == len(df.columns):
        return df.select(*[missing_to_null(df, c).alias(c) for c in df.columns]).distinct()
    first = require(df, order_by, "order column")
    rest = [c for c in df.columns if c not in set(first) | set(names)]
    # Order columns may be part of the subset, where they are constant.
    order = [col(c).asc_nulls_last() for c in [*first, *rest]]
    window = Window.partitionBy(*[missing_to_null(df, c) for c in names]).orderBy(*order)
    number = free_name("_row_number", df.columns)
    numbered = df.withColumn(number, F.row_number().over(window)).filter(F.col(number) == 1)
    return numbered.select(*[missing_to_null(df, c).alias(c) for c in df.columns])


def drop_missing(df: DataFrame) -> DataFrame:
    """Rows with a value in every column; NaN counts as missing."""
    # Bare IS NOT NULL tests reach the scan; dropna would hide them from it.
    present = [col(c).isNotNull() for c in df.columns]
    numbers = [~F.isnan(col(f.name)) for f in df.schema if is_floating(f.dataType)]
    return df.filter(reduce(lambda x, y: x & y, present + numbers))


def fill_missing(df: DataFrame, value: str = "0") -> DataFrame:
    """Replace missing cells by ``value``, cast to each column's type.

    A column whose type cannot hold the value becomes text first; nested
    columns stay as they are.
    """
    castable = _castable(df, value)
    filled = []
    for name in df.columns:
        kept, data_type = missing_to_null(df, name), dtype(df, name)
        if _is_nested(data_type):
            filled.append(col(name))
        elif castable[data_type.simpleString()]:
            filled.append(F.coalesce(kept, F.lit(value).try_cast(data_type)).alias(name))
        else:
            filled.append(F.coalesce(as_text(kept, data_type), F.lit(value)).alias(name))
    return df.select(*filled)


def _is_nested(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.ArrayType, T.MapType, T.StructType))


def _castable(df: DataFrame, value: str) -> dict[str, bool]:
    """Which column types can hold ``value``. A constant query; reads no table."""
    flat = [f.dataType for f in df.schema if not is_text(f.dataType) and not _is_nested(f.dataType)]
    types = sorted({t.simpleString() for t in flat})
    if not types:
        return {f.dataType.simpleString(): True for f in df.schema}
    by_name = {t.simpleString(): t for t in flat}
    answer = dict(zip(types, literal_fits(df.sparkSession, value, [by_name[t] for t in types])))
    return {f.dataType.simpleString(): answer.get(f.dataType.simpleString(), True) for f in df.schema}


def standardize(
    df: DataFrame, columns: str | Iterable[str] | None = None, actions: Iterable[str] = TEXT_ACTIONS
) -> DataFrame:
    """Strip, then upper, then lower the given text columns (all by default)."""
    actions = as_list(actions)
    unknown = [a for a in actions if a not in TEXT_ACTIONS]
    if unknown:
        raise ValueError(f"unknown text actions {unknown}; choose from {TEXT_ACTIONS}")
    chosen = set(text_columns(df) if columns is None else require(df, columns, "text column"))
    wrong = [c for c in chosen if not is_text(dtype(df, c))]
    if wrong:
        raise ValueError(f"not text columns: {wrong}")
    # Appending nothing keeps the optimizer from shortening lower(upper(x)) to
    # lower(x), which differs for letters such as the German sharp s.
    steps = {"strip": strip_ws, "upper": lambda c: F.concat(F.upper(c), F.lit("")), "lower": F.lower}

    def cell(name: str):
        value = col(name)
        if name in chosen:
            for step in TEXT_ACTIONS:
                if step in actions:
                    value = steps[step](value)
        return value.alias(name)

    return df.select(*[cell(c) for c in df.columns])


def clean(df: DataFrame, spec: CleanSpec) -> DataFrame:
    """Run the steps of ``spec`` in the fixed order."""
    result = df
    if spec.duplicates:
        result = dedupe(result, spec.duplicates, spec.order_by)
    if spec.missing == "drop":
        result = drop_missing(result)
    elif spec.missing == "fill":
        result = fill_missing(result, spec.fill_value)
    elif spec.missing is not None:
        raise ValueError(f"missing must be 'drop' or 'fill', not {spec.missing!r}")
    if spec.text_actions:
        chosen = spec.text_columns if spec.text_columns is not None else text_columns(df)
        still_text = [c for c in require(result, chosen) if is_text(dtype(result, c))]
        result = standardize(result, still_text, spec.text_actions)
    return result


def report(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: ``rows_before``, ``rows_after``."""
    counts = before.agg(F.count("*").alias("rows_before"), F.lit(None).cast("bigint").alias("rows_after")).unionByName(
        after.agg(F.lit(None).cast("bigint").alias("rows_before"), F.count("*").alias("rows_after"))
    )
    return counts.agg(F.max("rows_before").alias("rows_before"), F.max("rows_after").alias("rows_after"))
