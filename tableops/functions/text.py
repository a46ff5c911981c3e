"""Text expressions. All are built-in column expressions, so they stay in codegen."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

# The characters counted as white space at the ends of a cell
# (control separators, blank, NEL, no-break space and the Unicode spaces).
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Fixed value: characters outside printable ASCII and the Latin-1 letter block.
OUTSIDE_LATIN = r"[^\x20-\x7E\u00C0-\u00FF]+"

# Fixed value: anything but letters, numbers, underscore, white space, hyphen.
NOT_IN_FILE_NAME = r"[^\p{L}\p{N}_" + WHITESPACE + r"-]+"


def strip_ws(c: Column) -> Column:
    """Trim every kind of white space at both ends (``trim`` only knows blanks)."""
    return F.btrim(c, F.lit(WHITESPACE))


def clean_text(c: Column) -> Column:
    """No-break space to blank, drop characters outside Latin-1 text, trim."""
    blanks = F.replace(c, F.lit("\u00a0"), F.lit(" "))
    return F.trim(F.regexp_replace(blanks, OUTSIDE_LATIN, ""))


def slug(c: Column) -> Column:
    """Label usable as a file name."""
    kept = F.regexp_replace(c, NOT_IN_FILE_NAME, "")
    return F.replace(strip_ws(kept), F.lit(" "), F.lit("_"))


def as_text(c: Column, data_type: T.DataType) -> Column:
    """Cell text as shown to a user; booleans read True / False, numbers without an exponent.

    Floating numbers keep all their digits. Those of 10^28 and more, or below 10^-20, keep the exponent.
    """
    text = c.cast("string")
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        size = F.abs(c)
        kind = F.when((size >= 1e7) & (size < 1e28), F.replace(text, F.lit("E"), F.lit("e")).try_cast("decimal(38,10)").cast("string"))
        kind = kind.when((size < 1e-3) & (size >= 1e-20), text.try_cast("decimal(38,37)").cast("string"))
        plain = F.regexp_replace(F.regexp_replace(kind, r"0+$", ""), r"\.$", ".0")
        return F.coalesce(plain, text)
    return F.initcap(text) if isinstance(data_type, T.BooleanType) else text
