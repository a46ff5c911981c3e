"""Number parsing and tolerant equality as built-in column expressions."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, functions as F, types as T

from tableops.columns import is_floating, is_numeric, is_text

# The accepted spellings of a number. Spark's own cast also takes
# '1d', '1f' and 'NaN', which are text (or missing) in a spreadsheet.
NUMBER = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf(inity)?)\s*$"
INFINITY = r"(?i)inf"
WHOLE = r"^\s*[+-]?\d+\s*$"
TRUE_WORDS = ("True", "TRUE", "true")
FALSE_WORDS = ("False", "FALSE", "false")


# How exact_sum cuts a number of units in three, how many digits their sum may have, and how much finer than asked for it counts.
PART_BITS = 21
SUM_DIGITS = 28
FINER = 6


def to_number(c: Column, decimal_comma: bool = False) -> Column:
    """Text to double, NULL where the text is not a number.

    A finite spelling that overflows a double is NULL rather than infinity.
    """
    text = F.replace(c, F.lit(","), F.lit(".")) if decimal_comma else c
    value = text.try_cast("double")
    fits = (F.abs(value) < F.lit(float("inf"))) | text.rlike(INFINITY)
    return F.when(text.rlike(NUMBER) & fits, value)


def to_whole(c: Column) -> Column:
    """Text to bigint, NULL where the text is not a whole number that fits."""
    return F.when(c.rlike(WHOLE), F.trim(c).try_cast("bigint"))


def to_flag(c: Column) -> Column:
    """Text to boolean, NULL for anything but the usual true / false words."""
    return F.when(c.isin(*TRUE_WORDS), F.lit(True)).when(c.isin(*FALSE_WORDS), F.lit(False))


def exact_sum(c: Column, data_type: T.DataType, places: int) -> Column:
    """Sum to ``places`` decimals that no order of addition can change.

    Floating values are counted in units six digits finer than asked for and rounded once, at the
    end. The units go into three whole-number sums, of 21 bits each, which hold 4 * 10^12 rows and cost
    far less per row than decimals; values too large for that are added as decimals. Infinities come out as
    such (both signs: NaN). Only with values beyond 10^30 or a total beyond 10^28 units is the sum a
    floating one. NULL for no values.
    """
    if not is_floating(data_type):
        return F.sum(c)
    scale = places + FINER
    infinite, size = F.lit(float("inf")), F.abs(c)
    small = F.when(size < F.lit(9e18 / 10**scale), c)
    units = F.rint(small * F.lit(float(10**scale))).cast("bigint")
    mask = F.lit((1 << PART_BITS) - 1)
    parts = [F.shiftright(units, 2 * PART_BITS), F.shiftright(units, PART_BITS).bitwiseAND(mask), units.bitwiseAND(mask)]
    high, middle, low = [F.coalesce(F.sum(part).cast("decimal(19,0)"), F.lit(Decimal(0))) for part in parts]
    whole = high * F.lit(Decimal(1 << 2 * PART_BITS)) + middle * F.lit(Decimal(1 << PART_BITS)) + low
    fine = (whole.try_cast(f"decimal({SUM_DIGITS},0)") * F.lit(Decimal(1).scaleb(-scale))).cast(f"decimal(38,{scale})")
    large = F.when((size >= F.lit(9e18 / 10**scale)) & (size <= F.lit(10.0 ** min(30, 34 - places))), c).cast(f"decimal(38,{places})")
    added = F.round(fine, places).cast("double") + F.lit(0.0)
    exact = F.round(F.try_add(fine, F.try_sum(large)), places).cast("double")
    # Two extremes tell which of the sums hold: none by an empty group, the plain one by values beyond all bounds.
    top, bottom = F.max(c).cast("double"), F.min(c).cast("double")
    reach, plus, minus = F.greatest(top, -bottom), top == infinite, bottom == F.lit(float("-inf"))
    odd = F.when(plus & minus, F.lit(float("nan"))).when(plus, infinite).when(minus, F.lit(float("-inf")))
    odd = odd.when(reach > F.lit(10.0 ** min(30, 34 - places)), F.sum(c))
    return F.when(top.isNotNull(), F.coalesce(odd, F.when(reach >= F.lit(9e18 / 10**scale), exact).otherwise(added), F.sum(c)))


def exact_gap(a: Column, b: Column) -> Column:
    """Absolute difference of two whole or decimal numbers, without a floating step; NULL beyond 38 digits."""
    return F.abs(F.try_subtract(_as_decimal(a), _as_decimal(b)))


def _as_decimal(c: Column) -> Column:
    return F.try_add(c, F.lit(Decimal(0)))


def approx_equal(
    a: Column,
    b: Column,
    type_a: T.DataType,
    type_b: T.DataType,
    abs_tol: float = 0.0001,
    rel_tol: float = 0.0,
) -> Column:
    """Equality flag, never NULL: numbers within tolerance, the rest exactly.

    NULL equals NULL, NaN equals NaN, an infinity equals only itself.
    """
    if is_numeric(type_a) and is_numeric(type_b):
        fractional = any(is_floating(t) or isinstance(t, T.DecimalType) for t in (type_a, type_b))
        if not fractional and abs_tol < 1 and rel_tol == 0:
            return a.eqNullSafe(b)
        x, y = a.cast("double"), b.cast("double")
        gap = F.abs(x - y)
        near = gap <= F.lit(float(abs_tol))
        if not (is_floating(type_a) or is_floating(type_b)):
            near = exact_gap(a, b) <= F.lit(Decimal(str(abs_tol)))
        if rel_tol:
            # NaN sorts above every number here, so keep NaN and infinity out
            # of a bound that is multiplied by the value itself.
            limit = F.lit(float(abs_tol)) + F.lit(float(rel_tol)) * F.abs(y)
            near = (limit < F.lit(float("inf"))) & (gap <= limit)
        return F.coalesce(a.eqNullSafe(b) | near, F.lit(False))
    if type_a == type_b or (is_text(type_a) and is_text(type_b)):
        return a.eqNullSafe(b)
    return a.cast("string").eqNullSafe(b.cast("string"))
