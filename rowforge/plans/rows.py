"""Rows of sheets and pivots in the form the sinks take."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..columns import DEST_FILE, DEST_SHEET, ROW_ID, SOURCE_FILE, col, unique_physical_names
from ..functions import float_text
from ..labels import PIVOT_COLUMN_HEADER, PIVOT_METRIC_HEADER, PIVOT_VALUE_HEADER
from ..operators.layout import place_rows
from ..operators.numbering import number_rows, with_row_id
from ..operators.pivot import metric_name, pivot_grid, pivot_long
from ..runtime import materialize
from .spec import ExportSpec, PivotSpec, aggregation


def placed_cells(rows: DataFrame, plan: DataFrame, cap: int) -> DataFrame:
    """Rows of ``cells`` with their place: ``file_name, sheet_no, sheet_name, sheet_row, text_cells, cells``."""
    keys = [SOURCE_FILE, DEST_FILE, DEST_SHEET]
    if plan.filter("sheet_part > 1").isEmpty():
        # No sheet is full: the row ids put the rows in order, and the writer counts them.
        placed = rows.withColumn("sheet_row", col(ROW_ID) + 2)
    else:
        keys.append("sheet_part")
        placed = place_rows(materialize(rows, "rows"), cap)
    where = ["file_name", "sheet_no", "sheet_name"]
    placed = placed.join(plan.select(*keys, *where), keys)
    return placed.select(*where, "sheet_row", F.lit(None).cast("int").alias("text_cells"), "cells")


def pivot_rows(source: DataFrame, spec: ExportSpec, cap: int) -> DataFrame:
    """Header and body rows of each source's pivot: ``source_file, _part, sheet_row, text_cells, cells``."""
    header, rows = pivot_grid(source, spec.pivot, spec.filter_column, spec.filter_values)
    rows = number_rows(with_row_id(rows, [SOURCE_FILE, "row_key"]), "_n", [SOURCE_FILE])
    part = F.floor((F.col("_n") - 1) / cap)
    texts = F.transform(
        "cells",
        lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit("")).otherwise(float_text(F.round(x, 2))),
    )
    body = rows.select(
        SOURCE_FILE,
        part.alias("_part"),
        ((F.col("_n") - 1) % cap + 2).cast("long").alias("sheet_row"),
        F.size("row_key").alias("text_cells"),
        F.concat("row_key", texts).alias("cells"),
    )
    parts = body.select(SOURCE_FILE, "_part").distinct()
    tops = parts.join(header, SOURCE_FILE).select(
        SOURCE_FILE, "_part", F.lit(1).cast("long").alias("sheet_row"), F.lit(None).cast("int").alias("text_cells"),
        F.col("header").alias("cells"),
    )
    return tops.unionByName(body)


def pivot_sheets(
    source: DataFrame, plan: DataFrame, spec: ExportSpec, bases: DataFrame, cap: int, workbook_rows: int
) -> DataFrame:
    """The pivot of each source: a further sheet of its workbook, or a workbook when split to files.

    Sheets past ``workbook_rows`` rows of a pivot go on in workbooks of their own.
    """
    title = spec.pivot_label
    rows = pivot_rows(source, spec, cap)
    if spec.file_split_column:
        place = bases.select(
            SOURCE_FILE,
            "base_name",
            F.concat("base_name", F.lit(f"_{title}.xlsx")).alias("file_name"),
            F.lit(0).cast("long").alias("_last"),
            F.lit(0).cast("long").alias("_taken"),
        )
    else:
        # The sheet follows the last one; if its name is taken it gets the next free number.
        like = F.regexp_extract(F.lower("sheet_name"), f"^{title.lower()}(?:_([0-9]{{1,9}}))?$", 1)
        number = F.when(F.lower("sheet_name") == title.lower(), 1).otherwise(like.try_cast("long") + 1)
        place = plan.groupBy(SOURCE_FILE).agg(
            F.max_by("file_name", "sheet_no").alias("file_name"),
            F.max("sheet_no").alias("_last"),
            F.coalesce(F.max(number), F.lit(0)).cast("long").alias("_taken"),
        )
        # A source whose rows were all filtered out has no workbook yet; the pivot opens it.
        empty = F.concat("base_name", F.lit(".xlsx"))
        place = bases.join(place, SOURCE_FILE, "left").select(
            SOURCE_FILE,
            "base_name",
            F.coalesce("file_name", empty).alias("file_name"),
            F.coalesce("_last", F.lit(0)).alias("_last"),
            F.coalesce("_taken", F.lit(0)).alias("_taken"),
        )
    index = F.col("_taken") + F.col("_part")
    book = F.floor(F.col("_part") * (cap + 1) / workbook_rows) + 1
    next_book = F.concat("base_name", F.lit(".part"), book, F.lit(f"_{title}.xlsx"))
    return (
        rows.join(place, SOURCE_FILE)
        .select(
            F.when(book > 1, next_book).otherwise(F.col("file_name")).alias("file_name"),
            (F.col("_last") + F.col("_part") + 1).alias("sheet_no"),
            F.when(index == 0, title).otherwise(F.concat(F.lit(f"{title}_"), index)).alias("sheet_name"),
            "sheet_row",
            "text_cells",
            "cells",
        )
    )


def pivot_csv(source: DataFrame, spec: ExportSpec, bases: DataFrame) -> DataFrame:
    """The long pivot of each source as rows of its own file, sorted by key."""
    pivot: PivotSpec = spec.pivot
    long = pivot_long(source, pivot, spec.filter_column, spec.filter_values, by=[SOURCE_FILE])
    counts = [metric_name(f, a) for f, a in pivot.metrics if aggregation(a) == "count"]
    value = F.when(F.col("metric").isin(*counts), F.col("value").cast("long").cast("string"))
    value = value.otherwise(float_text(F.col("value")))
    row_names = list(pivot.rows) or [pivot.total_label]
    names = [*row_names, PIVOT_COLUMN_HEADER, PIVOT_METRIC_HEADER, PIVOT_VALUE_HEADER]
    flat = long.select(SOURCE_FILE, *map(col, row_names), "col_key", "metric", value.alias("value"))
    flat = flat.toDF(SOURCE_FILE, *unique_physical_names(names))
    ordered = with_row_id(flat, [col(c) for c in flat.columns[:-1]])
    file_name = F.concat("base_name", F.lit(f"_{spec.pivot_label}.{spec.output_format}")).alias("file_name")
    return ordered.join(bases.select(SOURCE_FILE, file_name), SOURCE_FILE)
