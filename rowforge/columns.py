"""Column lookup by header label.

A table read from text may have duplicate header names. Spark needs unique column names, so the
reader renames later duplicates and keeps the header text in the column metadata. All operators look
columns up by that label: exact, case-sensitive, first match.
"""

from __future__ import annotations

import warnings
from collections import Counter
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns the engine adds beside the data columns.
SOURCE_FILE = "source_file"
ROW_ID = "row_id"
DEST_FILE = "dest_file"
DEST_SHEET = "dest_sheet"
ENGINE_COLUMNS = (SOURCE_FILE, ROW_ID, DEST_FILE, DEST_SHEET, "sheet_part", "sheet_row")
# Columns an export joins to the rows.
OUTPUT_COLUMNS = ("file_name", "sheet_no", "sheet_name")


def col(name: str) -> Column:
    """Column by its exact physical name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def label(field: T.StructField) -> str:
    return (field.metadata or {}).get("label", field.name)


def data_fields(df: DataFrame) -> list[T.StructField]:
    return [f for f in df.schema.fields if f.name not in ENGINE_COLUMNS]


def headers(df: DataFrame) -> list[str]:
    """Header labels of the data columns."""
    return [label(f) for f in data_fields(df)]


def numbered_labels(labels: Iterable[str]) -> list[tuple[str, int]]:
    """Each label with its number among equal ones."""
    seen: Counter = Counter()
    out = []
    for text in labels:
        out.append((text, seen[text]))
        seen[text] += 1
    return out


def without_output_names(df: DataFrame) -> DataFrame:
    """Data columns named like those the engine adds get another physical name and keep their label.

    A table without ``source_file`` was not read by the engine, so all of its columns are data.
    """
    taken = {*OUTPUT_COLUMNS, *(() if SOURCE_FILE in df.columns else ENGINE_COLUMNS)}
    if not any(c.lower() in taken for c in df.columns):
        return df
    fields = df.schema.fields
    return df.select(
        *[
            col(f.name).alias(f"{f.name}#", metadata={"label": label(f)}) if f.name.lower() in taken else col(f.name)
            for f in fields
        ]
    )


def find(df: DataFrame, name: str) -> T.StructField | None:
    """First data column with this label."""
    return next((f for f in data_fields(df) if label(f) == name), None)


def require(df: DataFrame, name: str) -> T.StructField:
    field = find(df, name)
    if field is None:
        raise ValueError(f"column not found: {name!r}")
    return field


def missing(what: str, strict: bool) -> None:
    """An unknown column is skipped with a warning, or refused when ``strict``."""
    if strict:
        raise ValueError(what)
    warnings.warn(what, stacklevel=3)


def unique_physical_names(labels: Iterable[str]) -> list[str]:
    """Physical names for header labels: unique without regard to case, first match keeps its label."""
    taken = {*ENGINE_COLUMNS, *OUTPUT_COLUMNS}
    names = []
    for i, text in enumerate(labels):
        name = text if text and text.lower() not in taken else f"{text or '_c'}#{i}"
        while name.lower() in taken:
            name += "#"
        taken.add(name.lower())
        names.append(name)
    return names

def merge_selection(selected: Sequence[str], available: Sequence[str]) -> list[str]:
    """Carry a selection over to another header: known names keep their order, new ones follow."""
    kept = [name for name in selected if name in available]
    return kept + [name for name in available if name not in kept]
