"""The export chain up to the sink: filter, route, project, remove duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..columns import DEST_FILE, DEST_SHEET, ENGINE_COLUMNS, ROW_ID, SOURCE_FILE, col, headers
from ..plans.spec import ExportSpec
from .dedup import drop_duplicate_rows
from .filters import filter_in, mark_in
from .projection import output_cell, resolve_selection, select_columns
from .routing import route

DESTINATION = (SOURCE_FILE, DEST_FILE, DEST_SHEET)


def routed(df: DataFrame, spec: ExportSpec) -> DataFrame:
    """Filtered rows with their destination; an unused level of it is the empty string."""
    df = with_destination(filter_in(df, spec.filter_column, spec.filter_values), spec)
    return df.withColumns({c: F.coalesce(col(c), F.lit("")) for c in (DEST_FILE, DEST_SHEET)})


def with_destination(df: DataFrame, spec: ExportSpec, drop: bool = True) -> DataFrame:
    """Add the destination of each row; without ``drop`` rows that have none stay, with NULL."""
    for column, values, out in (
        (spec.file_split_column, spec.file_split_values, DEST_FILE),
        (spec.sheet_split_column, spec.sheet_split_values, DEST_SHEET),
    ):
        if column:
            df = route(df, column, values, out, spec.others_label, drop)
        else:
            df = df.withColumn(out, F.lit(""))
    return df


def with_source(df: DataFrame) -> DataFrame:
    """Typed tables count as one unnamed source."""
    if SOURCE_FILE in df.columns:
        return df.withColumn(SOURCE_FILE, F.coalesce(col(SOURCE_FILE), F.lit("")))
    return df.withColumn(SOURCE_FILE, F.lit(""))


def shape(df: DataFrame, spec: ExportSpec, across_files: bool = False) -> DataFrame:
    """The rows of an export: destination columns, row id if there is one, output columns.

    Duplicates are removed per source file and destination; ``across_files`` joins all files into
    one scope, as the split forecast does.
    """
    labels = headers(df)
    spec = spec.normalise(labels)
    df = with_source(df)
    if across_files:
        df = df.withColumn(SOURCE_FILE, F.lit(""))
    out = select_columns(routed(df, spec), spec.selected_columns)
    if not spec.removes_duplicates(labels):
        return out
    fields = [f for f in out.schema.fields if f.name not in ENGINE_COLUMNS]
    unique = drop_duplicate_rows(out, [f.name for f in fields], DESTINATION)
    order = [c for c in ENGINE_COLUMNS if c in unique.columns]
    return unique.select(*order, *[col(f.name).alias(f.name, metadata=f.metadata or {}) for f in fields])


def destinations(shaped: DataFrame) -> DataFrame:
    """One row per destination: rows and, for ordered input, the id of its first row."""
    aggregates = [F.count(F.lit(1)).alias("n_rows")]
    if ROW_ID in shaped.columns:
        aggregates.append(F.min(ROW_ID).alias("first_row_id"))
    return shaped.groupBy(*DESTINATION).agg(*aggregates)


def export_metrics(df: DataFrame, spec: ExportSpec, run_id: str = "") -> DataFrame:
    """One row of counters for a job, from a single pass over the input."""
    labels = headers(df)
    spec = spec.normalise(labels)
    unique = spec.removes_duplicates(labels)
    marked = mark_in(with_source(df), spec.filter_column, spec.filter_values, "_kept")
    marked = with_destination(marked, spec, drop=False)
    placed = F.col("_kept") & col(DEST_FILE).isNotNull() & col(DEST_SHEET).isNotNull()
    keys = {c: F.when(F.col("_routed"), col(c)) for c in DESTINATION}
    if unique:
        keys |= {f.name: F.when(F.col("_routed"), output_cell(f)) for f in resolve_selection(df, spec.selected_columns)}
    # Rows without a destination share one group per flag; copies of output rows collapse map-side.
    by = [value.alias(f"_k{i}") for i, value in enumerate(keys.values())]
    per_row = marked.withColumn("_routed", placed).groupBy("_kept", "_routed", *by).agg(F.count(F.lit(1)).alias("n"))
    removed = F.col("n") - 1 if unique else F.lit(0)
    per_output = per_row.groupBy("_kept", "_routed", *[f"_k{i}" for i in range(len(DESTINATION))]).agg(
        F.sum("n").alias("n"), F.sum(removed).alias("removed")
    )

    def total(value: Column, flag: str | None = None) -> Column:
        return F.coalesce(F.sum(F.when(F.col(flag), value) if flag else value), F.lit(0))

    return per_output.agg(
        F.lit(run_id).alias("run_id"),
        total(F.col("n")).alias("rows_in"),
        total(F.col("n"), "_kept").alias("rows_kept"),
        total(F.col("n"), "_routed").alias("rows_routed"),
        total(F.col("removed"), "_routed").alias("duplicates_removed"),
        F.count_if("_routed").alias("outputs"),
    )
