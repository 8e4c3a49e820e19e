"""Text expressions: whitespace, blank test, search."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters that count as whitespace when a cell is stripped.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Column) -> Column:
    """Remove leading and trailing Unicode whitespace (plain ``trim`` only knows the space)."""
    return F.btrim(c, F.lit(WHITESPACE))


def is_blank(c: Column, dtype: T.DataType | None = None) -> Column:
    """True for an absent cell, an empty cell and a cell of whitespace only."""
    if dtype is not None and not isinstance(dtype, T.StringType):
        return c.isNull()
    # A first byte in the visible ASCII range settles the common case without trimming.
    visible = (c >= F.lit("!")) & (c < F.lit("\x7f"))
    return F.when(visible, F.lit(False)).otherwise(F.coalesce(F.ltrim(c, F.lit(WHITESPACE)) == F.lit(""), F.lit(True)))


def pad_absent(c: Column) -> Column:
    """An absent trailing cell is written as an empty one."""
    return F.coalesce(c, F.lit(""))


def contains_ci(c: Column, needle: str) -> Column:
    """Case-insensitive substring test; an absent cell never matches."""
    return F.coalesce(F.contains(F.lower(c), F.lower(F.lit(needle))), F.lit(False))


def as_text(c: Column, dtype: T.DataType) -> Column:
    """The text of a typed cell. Strings pass through, which keeps predicate pushdown intact."""
    if isinstance(dtype, T.StringType):
        return c
    return F.to_json(c) if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)) else c.cast("string")
