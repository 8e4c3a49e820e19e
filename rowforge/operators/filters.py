"""Row filters by value set."""

from __future__ import annotations

import re
from collections.abc import Iterable
from datetime import date, datetime
from math import isfinite

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..columns import col, data_fields, find, missing
from ..functions import as_text, is_blank

# A value list up to this length is a literal IN, which reaches the scan; a longer one is a semi join.
LITERAL_VALUES = 1000
# A value list is broadcast only while its text is known to stay below this many characters.
BROADCAST_CHARS = 8 * 1024 * 1024


def value_table(spark: SparkSession, values: list[str], name: str, with_null: bool = False) -> DataFrame:
    """A driver-side value list as a one-column table, broadcast when its size allows."""
    rows = [(v,) for v in values] + ([(None,)] if with_null else [])
    table = spark.createDataFrame(rows, f"`{name}` string")
    return F.broadcast(table) if sum(map(len, values)) <= BROADCAST_CHARS else table


def _numbers(kind: T.IntegralType, values: list[str]) -> list[int]:
    """The values that are the text of a number of this type."""
    bits = {"tinyint": 7, "smallint": 15, "int": 31}.get(kind.simpleString(), 63)
    numbers = [int(v) for v in values if re.fullmatch(r"0|-?[1-9][0-9]{0,18}", v)]
    return [n for n in numbers if -(1 << bits) <= n < 1 << bits]


def _typed(kind: T.DataType, values: list[str]) -> list[object] | None:
    """The values as cells of the type, or nothing unless each has exactly one cell that could read like it.

    Zeros and what is no finite number are left to the text: their cells are equal to others of another text.
    Times with a time zone are, too: an hour that a clock repeats reads the same twice.
    """
    try:
        if isinstance(kind, T.BooleanType):
            return [{"true": True, "false": False}[v] for v in values]
        if isinstance(kind, T.DoubleType):
            numbers = [float(v) for v in values]
            return numbers if all(n and isfinite(n) for n in numbers) else None
        if isinstance(kind, T.DateType) and all(re.fullmatch(r"\d{4}-\d\d-\d\d", v, re.A) for v in values):
            return [date.fromisoformat(v) for v in values]
        whole = r"\d{4}-\d\d-\d\d \d\d:\d\d:\d\d(\.\d{1,6})?"
        if isinstance(kind, T.TimestampNTZType) and all(re.fullmatch(whole, v, re.A) for v in values):
            return [datetime.fromisoformat(v) for v in values]
    except (KeyError, ValueError):
        pass
    return None


def _literal(kind: T.DataType, value: object) -> Column:
    return F.lit(str(value)).cast(kind) if isinstance(value, date) else F.lit(value).cast(kind)


def is_one_of(field: T.StructField, values: list[str]) -> Column:
    """Whether a cell's text is one of ``values``.

    For whole numbers the values that are the text of a number become numbers and the others are left
    out, so that the test reaches the scan as it does for strings. For other types a test on typed values
    goes along with the one on texts for the same end.
    """
    cell, kind = col(field.name), field.dataType
    if not isinstance(kind, T.IntegralType):
        text, typed = as_text(cell, kind).isin(*values), _typed(kind, values)
        return text if typed is None else cell.isin(*[_literal(kind, v) for v in typed]) & text
    numbers = _numbers(kind, values)
    none = F.when(cell.isNotNull(), F.lit(False))
    return cell.isin(*[F.lit(n).cast(kind) for n in numbers]) if numbers else none


def _between(field: T.StructField, values: list[str]) -> Column | None:
    """Whether a cell lies between the least and the greatest value, which scans can tell; nothing if that is unclear."""
    cell, kind = col(field.name), field.dataType
    if kind == T.StringType():
        found = sorted(values, key=lambda v: v.encode("utf-8", "surrogatepass"))
    else:
        found = sorted((_numbers(kind, values) if isinstance(kind, T.IntegralType) else _typed(kind, values)) or ())
    return cell.between(_literal(kind, found[0]), _literal(kind, found[-1])) if found else None


def filter_in(
    df: DataFrame,
    column: str | None,
    values: Iterable[str] | DataFrame | None,
    short_rows: str = "drop",
    strict: bool = False,
) -> DataFrame:
    """Keep rows whose cell in ``column`` is one of ``values`` (exact text, case-sensitive, no trim).

    An empty value set or an unknown column means no filter. ``short_rows`` decides about rows in
    which the cell is absent (NULL): ``drop`` as the export does, ``keep`` as counting, distinct
    values and pivots do. ``values`` may be a one-column DataFrame for sets too big for the driver.
    """
    if short_rows not in ("drop", "keep"):
        raise ValueError("short_rows is 'drop' or 'keep'")
    if not column:
        return df
    field = find(df, column)
    if field is None:
        missing(f"filter column not found, filter skipped: {column!r}", strict)
        return df
    cell = as_text(col(field.name), field.dataType)
    keep_short = short_rows == "keep"

    if isinstance(values, DataFrame):
        if values.isEmpty():
            return df
        wanted = values.toDF("_wanted")
        if keep_short:
            wanted = wanted.unionByName(df.sparkSession.createDataFrame([(None,)], "_wanted string"))
        return _semi(df, cell, wanted, keep_short)

    listed = list(dict.fromkeys(values or ()))
    if not listed:
        return df
    if len(listed) <= LITERAL_VALUES:
        test = is_one_of(field, listed)
        return df.filter(test | cell.isNull() if keep_short else test)
    near = _between(field, listed)
    if near is not None:
        df = df.filter(near | cell.isNull() if keep_short else near)
    return _semi(df, cell, value_table(df.sparkSession, listed, "_wanted", keep_short), keep_short)


def mark_in(df: DataFrame, column: str | None, values: Iterable[str] | DataFrame | None, out: str) -> DataFrame:
    """Flag the rows the export filter keeps, for counting kept and dropped rows in one pass."""
    field = find(df, column) if column else None
    table = isinstance(values, DataFrame)
    listed = [] if table else list(dict.fromkeys(values or ()))
    if field is None or (values.isEmpty() if table else not listed):
        return df.withColumn(out, F.lit(True))
    cell = as_text(col(field.name), field.dataType)
    if not table and len(listed) <= LITERAL_VALUES:
        return df.withColumn(out, F.coalesce(is_one_of(field, listed), F.lit(False)))
    wanted = values.toDF("_wanted").distinct() if table else value_table(df.sparkSession, listed, "_wanted")
    joined = df.join(wanted, cell == F.col("_wanted"), "left")
    return joined.withColumn(out, F.col("_wanted").isNotNull()).drop("_wanted")


def _semi(df: DataFrame, cell: Column, wanted: DataFrame, null_matches: bool) -> DataFrame:
    key = F.col("_wanted")
    return df.join(wanted, cell.eqNullSafe(key) if null_matches else cell == key, "left_semi")


def drop_blank_rows(df: DataFrame) -> DataFrame:
    """Drop rows in which every data cell is blank."""
    blank = F.lit(True)
    for field in data_fields(df):
        blank = blank & is_blank(col(field.name), field.dataType)
    return df.filter(~blank)
