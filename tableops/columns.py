"""Column lookup by plain name.

Spreadsheet headers hold dots, blanks and backticks, all of which ``F.col``
would read as syntax, so every operator goes through :func:`col`.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


def col(name: str, parent: str | None = None) -> Column:
    """Column called exactly ``name``, optionally a field of struct ``parent``."""
    quoted = "`" + name.replace("`", "``") + "`"
    return F.col(f"{parent}.{quoted}" if parent else quoted)


def as_list(names: str | Iterable[str] | None) -> list[str]:
    if names is None:
        return []
    return [names] if isinstance(names, str) else list(names)


def require(df: DataFrame, names: str | Iterable[str], what: str = "column") -> list[str]:
    """Check that each name exists; return the names as spelled in ``df``."""
    by_lower = {c.lower(): c for c in df.columns}
    found = []
    for name in as_list(names):
        if not isinstance(name, str) or name.lower() not in by_lower:
            raise ValueError(f"unknown {what} {name!r}; available: {df.columns}")
        found.append(by_lower[name.lower()])
    return found


def free_name(name: str, *taken: Iterable[str]) -> str:
    """``name``, with underscores before it until none of the given columns has it."""
    used = {c.lower() for columns in taken for c in columns}
    while name.lower() in used:
        name = "_" + name
    return name


def literal_fits(spark: SparkSession, value: object, types: Sequence[T.DataType]) -> list[bool]:
    """Which types hold the constant ``value`` as it is, nothing rounded or cut off. Reads no table."""
    literal, tests = F.lit(value), []
    for data_type in types:
        held = literal.try_cast(data_type)
        if isinstance(data_type, (T.IntegralType, T.DecimalType)) and not isinstance(value, bool):
            text = F.trim(literal.cast("string"))
            fits = text.try_cast("decimal(38,18)") == held.cast("string").try_cast("decimal(38,18)")
        elif isinstance(data_type, T.DateType):
            fits = literal.try_cast("timestamp") == held.cast("timestamp")
        elif isinstance(data_type, T.BooleanType):
            fits = F.lower(F.trim(literal.cast("string"))) == held.cast("string")
        else:
            fits = held.isNotNull()
        tests.append(F.coalesce(held.isNotNull() & fits, F.lit(False)))
    return list(spark.sql("SELECT 1").select(*[t.alias(f"t{i}") for i, t in enumerate(tests)]).first()) if tests else []


def require_unique(names: Sequence[str], what: str) -> None:
    seen: set[str] = set()
    for name in names:
        if name.lower() in seen:
            raise ValueError(f"{what}: duplicate column name {name!r}")
        seen.add(name.lower())


def dtype(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_numeric(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.NumericType)


def is_text(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.StringType, T.CharType, T.VarcharType))


def is_floating(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.DoubleType, T.FloatType))


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_text(f.dataType)]


def missing_to_null(df: DataFrame, name: str) -> Column:
    """The column with NaN folded to NULL, so there is one kind of missing."""
    c = col(name)
    return F.when(~F.isnan(c), c) if is_floating(dtype(df, name)) else c


def comparable_key_types(left: T.DataType, right: T.DataType) -> str | None:
    """Cast target that makes two key types comparable.

    None means they already agree. Text against number (or any other mixed
    pair) is refused instead of being left to implicit casts.
    """
    if left == right or (is_text(left) and is_text(right)):
        return None
    if is_numeric(left) and is_numeric(right):
        if is_floating(left) or is_floating(right):
            return "double"
        if isinstance(left, T.DecimalType) or isinstance(right, T.DecimalType):
            return _wider_decimal(left, right)
        return "bigint"
    temporal = (T.DateType, T.TimestampNTZType)
    if isinstance(left, temporal) and isinstance(right, temporal):
        return "timestamp_ntz"
    raise ValueError(f"key types cannot be compared: {left.simpleString()} and {right.simpleString()}")


def _wider_decimal(left: T.DataType, right: T.DataType) -> str:
    whole, scale = 0, 0
    for t in (left, right):
        p, s = (t.precision, t.scale) if isinstance(t, T.DecimalType) else (19, 0)
        whole, scale = max(whole, p - s), max(scale, s)
    if whole + scale > 38:
        raise ValueError(f"key types need more than 38 digits: {left.simpleString()} and {right.simpleString()}")
    return f"decimal({whole + scale},{scale})"
