"""Number expressions: lenient text-to-double and double-to-text."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import WHITESPACE

# A decimal literal as numeric text may be spelled: underscores only between two digits.
_DECIMAL = r"^[+-]?(?:\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?|\.\d+(?:_\d+)*)(?:[eE][+-]?\d+(?:_\d+)*)?$"
# The separators 0x1c to 0x1f count as whitespace in a cell, but not around a number.
_PADDING = "".join(ch for ch in WHITESPACE if not "\x1c" <= ch <= "\x1f")
_INFINITE = r"^(?i)[+-]?inf(?:inity)?$"
_NAN = r"^(?i)[+-]?nan$"


def _unicode_digits() -> tuple[str, str]:
    """All non-ASCII decimal digits and the ASCII digit each stands for."""
    digits = [chr(i) for i in range(128, sys.maxunicode + 1) if unicodedata.category(chr(i)) == "Nd"]
    return "".join(digits), "".join(str(unicodedata.decimal(d)) for d in digits)


_DIGITS, _ASCII_DIGITS = _unicode_digits()


def to_number(c: Column, dtype: T.DataType | None = None) -> Column:
    """Double value of a cell; anything that is not a number, an empty or an absent cell is 0.0."""
    if isinstance(dtype, T.NumericType):
        return F.coalesce(c.cast("double"), F.lit(0.0))
    cell = c if dtype is None or isinstance(dtype, T.StringType) else c.cast("string")
    # Digits with at most a sign and a point, the common case, need no pattern.
    plain = F.translate(cell, "0123456789", "").isin("", ".", "-", "-.")
    text = F.btrim(cell, F.lit(_PADDING))
    text = F.when(text.rlike(r"[^\x00-\x7f]"), F.translate(text, _DIGITS, _ASCII_DIGITS)).otherwise(text)
    return (
        F.when(plain, F.coalesce(cell.try_cast("double"), F.lit(0.0)))
        .when(text.rlike(_DECIMAL), F.replace(text, F.lit("_"), F.lit("")).try_cast("double"))
        .when(text.rlike(_INFINITE), F.lit(float("inf")) * F.when(text.startswith("-"), -1.0).otherwise(1.0))
        .when(text.rlike(_NAN), F.lit(float("nan")))
        .otherwise(F.lit(0.0))
    )


def float_text(c: Column) -> Column:
    """Decimal text of a double: plain from 1e-4 up to 1e16, else with a two-digit exponent."""
    raw = c.cast("string")
    plain = F.regexp_replace(raw.try_cast("decimal(38,21)").cast("string"), r"(\.\d*?)0+$", "$1")
    plain = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
    mantissa = F.regexp_replace(F.regexp_extract(raw, r"^(.*)E", 1), r"\.0$", "")
    exponent = F.regexp_extract(raw, r"E(-?\d+)$", 1).try_cast("int")
    scientific = F.concat(
        mantissa,
        F.when(exponent < 0, "e-").otherwise("e+"),
        F.when(F.abs(exponent) < 10, "0").otherwise(""),
        F.abs(exponent).cast("string"),
    )
    size = F.abs(c)
    return (
        F.when(F.isnan(c), "nan")
        .when(size == float("inf"), F.when(c > 0, "inf").otherwise("-inf"))
        .when((size == 0) | ~raw.contains("E"), raw)
        .when((size >= 1e-4) & (size < 1e16), plain)
        .otherwise(scientific)
    )
