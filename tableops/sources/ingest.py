"""Turning text cells into missing values and numbers."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tableops.columns import as_list, col, dtype, is_text, require, require_unique, text_columns
from tableops.functions import to_flag, to_number, to_whole

# The words read as a missing cell.
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def null_tokens(df: DataFrame, columns: str | Iterable[str] | None = None, tokens: Sequence[str] = NULL_TOKENS) -> DataFrame:
    """NULL for every text cell that is one of the missing-value words."""
    chosen = set(text_columns(df) if columns is None else require(df, columns))
    return df.select(
        *[F.when(~col(c).isin(*tokens), col(c)).alias(c) if c in chosen else col(c) for c in df.columns]
    )


def _text(df: DataFrame, columns: str | Iterable[str] | None) -> list[str]:
    chosen = text_columns(df) if columns is None else require(df, columns, "text column")
    wrong = [c for c in chosen if not is_text(dtype(df, c))]
    if wrong:
        raise ValueError(f"not text columns: {wrong}")
    return chosen


def numeric_cells(df: DataFrame, columns: str | Iterable[str] | None = None, suffix: str = "_num") -> DataFrame:
    """Add ``<column>_num`` with the cells that read as numbers (decimal comma or dot).

    The text stays as it is: a column cannot hold numbers and text at once.
    """
    chosen = _text(df, as_list(columns) if columns is not None else None)
    added = [to_number(col(c), decimal_comma=True).alias(c + suffix) for c in chosen]
    require_unique([*df.columns, *[c + suffix for c in chosen]], "numeric_cells")
    return df.select("*", *added)


def promote_numeric(
    df: DataFrame, columns: str | Iterable[str] | None = None, decimal_comma: bool = True
) -> DataFrame:
    """Change the type of text columns whose every cell, missing ones aside, allows it.

    Whole numbers first, then doubles, then booleans; any other column keeps
    its text untouched. One aggregate over all columns counts the cells that
    stand in the way, and one row of counts decides.
    """
    chosen = _text(df, as_list(columns) if columns is not None else None)
    if not chosen:
        return df
    readings = {c: _readings(col(c), decimal_comma) for c in chosen}
    counts = []
    for i, c in enumerate(chosen):
        counts.append(F.count(col(c)).alias(f"v{i}"))
        counts += [F.count(r).alias(f"v{i}_{j}") for j, r in enumerate(readings[c])]
    seen = df.agg(*counts).first()

    def typed(name: str) -> Column:
        if name not in readings:
            return col(name)
        i = chosen.index(name)
        if seen[f"v{i}"] == 0:
            return col(name).try_cast("double").alias(name)
        for j, reading in enumerate(readings[name]):
            if seen[f"v{i}_{j}"] == seen[f"v{i}"]:
                return reading.alias(name)
        return col(name)

    return df.select(*[typed(c) for c in df.columns])


def _readings(c: Column, decimal_comma: bool) -> list[Column]:
    return [to_whole(c), to_number(c, decimal_comma), to_flag(c)]
