"""Column selection, order and padding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from ..columns import ENGINE_COLUMNS, col, data_fields, find, missing
from ..functions import pad_absent


def resolve_selection(df: DataFrame, selected: Sequence[str], strict: bool = False) -> list[T.StructField]:
    """Output fields of a selection: in the given order, each once, first match, unknown names skipped.

    An empty selection, or one with no known name, keeps all columns.
    """
    if not selected:
        return data_fields(df)
    found = [(name, find(df, name)) for name in dict.fromkeys(selected)]
    unknown = [name for name, field in found if field is None]
    if unknown:
        missing(f"selected columns not found: {', '.join(map(repr, unknown))}", strict)
    return [field for _, field in found if field is not None] or data_fields(df)


def output_cell(field: T.StructField) -> Column:
    """A cell as it is written: an absent text cell becomes an empty one."""
    cell = col(field.name)
    if isinstance(field.dataType, T.StringType):
        cell = pad_absent(cell)
    return cell.alias(field.name, metadata=field.metadata or {})


def select_columns(df: DataFrame, selected: Sequence[str] = (), strict: bool = False) -> DataFrame:
    """Keep and reorder columns; engine columns stay in front."""
    fields = resolve_selection(df, selected, strict)
    engine = [col(c) for c in df.columns if c in ENGINE_COLUMNS]
    return df.select(*engine, *map(output_cell, fields))
