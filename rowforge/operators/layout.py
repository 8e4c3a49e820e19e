"""Places of rows in sheets, and the manifest of outputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..columns import DEST_FILE, DEST_SHEET, ROW_ID, SOURCE_FILE
from ..labels import SHEET_LABEL
from .naming import clean_file_stem, clean_sheet_name, unique_file_stems, unique_sheet_names
from .numbering import number_rows, running, with_row_id
from .shape import DESTINATION

# Fixed value: rows of a full sheet, the header row included.
SHEET_ROWS = 1_000_000
DATA_ROWS = SHEET_ROWS - 1
# Base name of the outputs of a typed table.
DEFAULT_STEM = "export"
# Rows of one workbook before the next one is started. A workbook is written by one task.
WORKBOOK_ROWS = 10 * SHEET_ROWS


def place_rows(shaped: DataFrame, cap: int = DATA_ROWS, keys: Sequence[str] = DESTINATION) -> DataFrame:
    """Add ``sheet_part`` (from 1) and ``sheet_row`` (from 2, below the header) per destination."""
    number = F.col("_n") - 1
    return (
        number_rows(shaped, "_n", keys)
        .withColumn("sheet_part", (F.floor(number / cap) + 1).cast("int"))
        .withColumn("sheet_row", (number % cap + 2).cast("long"))
        .drop("_n")
    )


def sheet_parts(destinations: DataFrame, cap: int = DATA_ROWS) -> DataFrame:
    """One row per sheet: destinations rolled over after ``cap`` data rows, by arithmetic on their counts."""
    last = F.greatest(F.lit(1), F.ceil(F.col("n_rows") / cap)).cast("int")
    parts = destinations.withColumn("sheet_part", F.explode(F.sequence(F.lit(1), last)))
    rows = F.least(F.lit(cap), F.col("n_rows") - (F.col("sheet_part") - 1) * cap).cast("long")
    return parts.withColumn("n_rows", rows)


def file_stem(source_file: Column) -> Column:
    """Name of a source file without folders and extension."""
    name = F.url_decode(F.replace(F.regexp_extract(source_file, r"([^/\\]*)$", 1), F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(name, r"(?s)(?<=.)\.[^.]*$", "")


def base_names(sources: DataFrame, run_id: str) -> DataFrame:
    """``source_file, base_name``: stem, ``_2``, ``_3`` .. for later files in path order, run id."""
    ordered = number_rows(with_row_id(sources.select(SOURCE_FILE).distinct(), [SOURCE_FILE]), "_i")
    return _base_name(ordered, run_id)


def single_base_name(spark: SparkSession, run_id: str) -> DataFrame:
    """The same for a typed table, which is one unnamed source."""
    return _base_name(spark.range(1).select(F.lit("").alias(SOURCE_FILE), F.lit(1).alias("_i")), run_id)


def _base_name(ordered: DataFrame, run_id: str) -> DataFrame:
    stem = F.when(F.col(SOURCE_FILE) == "", DEFAULT_STEM).otherwise(file_stem(F.col(SOURCE_FILE)))
    later = F.when(F.col("_i") > 1, F.concat(F.lit("_"), F.col("_i").cast("string"))).otherwise("")
    return ordered.select(SOURCE_FILE, F.concat(stem, later, F.lit(f" (conver_{run_id})")).alias("base_name"))


def manifest(
    destinations: DataFrame,
    run_id: str,
    extension: str = "xlsx",
    cap: int = DATA_ROWS,
    workbook_rows: int = WORKBOOK_ROWS,
    sheet_label: str = SHEET_LABEL,
    bases: DataFrame | None = None,
) -> DataFrame:
    """One row per sheet with file name, sheet name, number of the sheet in its workbook and rows.

    ``destinations`` holds one row per destination with ``n_rows`` and ``first_row_id``; it is read
    several times, so pass a stored one. Names are
    given in the order in which outputs first get a row; rolled-over sheets come after the first
    sheets. A workbook past ``workbook_rows`` rows goes on in a next one, so a destination of any
    size is spread over tasks of bounded size.
    """
    files = destinations.groupBy(SOURCE_FILE, DEST_FILE).agg(F.min("first_row_id").alias(ROW_ID))
    files = unique_file_stems(
        files.withColumn("_clean", clean_file_stem(F.col(DEST_FILE))), "_clean", "file_stem", [SOURCE_FILE]
    )
    if bases is None:
        bases = base_names(destinations, run_id)
    files = files.select(SOURCE_FILE, DEST_FILE, "file_stem").join(bases, SOURCE_FILE)

    parts = sheet_parts(destinations, cap)
    order = [SOURCE_FILE, DEST_FILE, F.col("sheet_part") > 1, "first_row_id", DEST_SHEET, "sheet_part"]
    parts = with_row_id(parts, order).join(files, [SOURCE_FILE, DEST_FILE])
    title = (
        F.when(F.col(DEST_SHEET) != "", F.col(DEST_SHEET))
        .when(F.col(DEST_FILE) != "", F.col("file_stem"))
        .otherwise(F.lit(sheet_label))
    )
    numbered = F.when(F.col("sheet_part") > 1, F.concat(title, F.lit("_"), F.col("sheet_part").cast("string")))
    parts = parts.withColumn("_title", clean_sheet_name(F.coalesce(numbered, title)))
    workbook = [SOURCE_FILE, DEST_FILE]
    parts = unique_sheet_names(parts, "_title", "sheet_name", workbook)
    parts = running(parts, F.col("n_rows") + 1, "_rows", workbook)
    book = (F.floor((F.col("_rows") - F.col("n_rows") - 1) / workbook_rows) + 1).cast("int")
    suffix = F.when(F.col(DEST_FILE) != "", F.concat(F.lit("_"), F.col("file_stem"))).otherwise("")
    part = F.when(F.col("workbook_part") > 1, F.concat(F.lit(".part"), F.col("workbook_part"))).otherwise("")
    parts = (
        parts.withColumn("workbook_part", book)
        .withColumn("file_name", F.concat("base_name", part, suffix, F.lit(f".{extension}")))
        .withColumn("sheet_no", F.col(ROW_ID))
    )
    return parts.select(
        *DESTINATION, "sheet_part", "workbook_part", "file_name", "sheet_no", "sheet_name", "n_rows"
    )
