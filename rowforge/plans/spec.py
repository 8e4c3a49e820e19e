"""Job descriptions: what to export and how to pivot."""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass, replace

from ..columns import merge_selection
from ..labels import AGGREGATIONS, OTHERS_LABEL, PIVOT_LABEL, SHEET_LABEL, TOTAL_LABEL


def aggregation(name: str) -> str:
    """English name of an aggregation given in either language."""
    known = AGGREGATIONS.get(name, name)
    if known not in AGGREGATIONS.values():
        raise ValueError(f"unknown aggregation: {name!r}")
    return known


@dataclass(frozen=True)
class PivotSpec:
    """Row fields x column fields with one or more (field, aggregation) metrics."""

    rows: Sequence[str] = ()
    columns: Sequence[str] = ()
    values: Sequence[tuple[str, str]] = ()
    remove_duplicates: bool = False
    total_label: str = TOTAL_LABEL

    def __post_init__(self) -> None:
        if not self.rows and not self.columns:
            raise ValueError("a pivot needs at least one row or column field")
        if not self.values:
            raise ValueError("a pivot needs at least one value")
        for _, name in self.values:
            aggregation(name)

    @property
    def metrics(self) -> list[tuple[str, str]]:
        """Metrics in order, each once."""
        return list(dict.fromkeys((f, a) for f, a in self.values))


@dataclass(frozen=True)
class ExportSpec:
    """Filter, column selection, routing and format of one export job."""

    output_format: str = "xlsx"
    filter_column: str = ""
    filter_values: Sequence[str] = ()
    file_split_column: str = ""
    file_split_values: Sequence[str] = ()
    sheet_split_column: str = ""
    sheet_split_values: Sequence[str] = ()
    selected_columns: Sequence[str] = ()
    deduplicate_rows: bool = True
    pivot: PivotSpec | None = None
    others_label: str = OTHERS_LABEL
    sheet_label: str = SHEET_LABEL
    pivot_label: str = PIVOT_LABEL

    def __post_init__(self) -> None:
        if self.output_format not in ("xlsx", "csv", "parquet"):
            raise ValueError(f"unknown output format: {self.output_format!r}")

    def normalise(self, headers: Sequence[str], strict: bool = False) -> "ExportSpec":
        """The job as it applies to one header: unknown columns cancel their setting.

        Text and table outputs have no sheets. There the file split alone counts, and without one
        (or with its column missing) the sheet split decides the files.
        """

        def known(column: str, setting: str) -> str:
            if not column or column in headers:
                return column
            if strict:
                raise ValueError(f"{setting} column not found: {column!r}")
            warnings.warn(f"{setting} column not found, {setting} skipped: {column!r}", stacklevel=3)
            return ""

        spec = replace(
            self,
            filter_column=known(self.filter_column, "filter"),
            file_split_column=known(self.file_split_column, "file split"),
            sheet_split_column=known(self.sheet_split_column, "sheet split"),
        )
        if spec.output_format == "xlsx" or not spec.sheet_split_column:
            return spec
        if spec.file_split_column:
            warnings.warn("no sheets in this format, sheet split skipped", stacklevel=2)
            return replace(spec, sheet_split_column="", sheet_split_values=())
        return replace(
            spec,
            file_split_column=spec.sheet_split_column,
            file_split_values=spec.sheet_split_values,
            sheet_split_column="",
            sheet_split_values=(),
        )

    def removes_duplicates(self, headers: Sequence[str]) -> bool:
        """Duplicate removal applies only when the selection leaves columns out."""
        found = [c for c in self.selected_columns if c in headers]
        return self.deduplicate_rows and 0 < len(found) < len(headers)

    def select(self, columns: Sequence[str]) -> "ExportSpec":
        """Change the selection: settings on columns left out and the pivot are cleared."""
        return replace(self._limited_to(columns), selected_columns=tuple(columns), pivot=None)

    def carry_to(self, headers: Sequence[str]) -> "ExportSpec":
        """Carry the job over to another header."""
        if not headers:
            return replace(self._limited_to(()), selected_columns=(), pivot=None)
        merged = merge_selection(self.selected_columns, headers)
        return replace(self._limited_to(merged), selected_columns=tuple(merged))

    def _limited_to(self, columns: Sequence[str]) -> "ExportSpec":
        changes: dict[str, object] = {}
        for setting in ("filter", "file_split", "sheet_split"):
            if getattr(self, f"{setting}_column") not in columns:
                changes |= {f"{setting}_column": "", f"{setting}_values": ()}
        return replace(self, **changes)
