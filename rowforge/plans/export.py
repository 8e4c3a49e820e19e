"""The export job: shape, name, place, write."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..columns import DEST_FILE, DEST_SHEET, ENGINE_COLUMNS, SOURCE_FILE, col, find, headers, label, without_output_names
from ..functions import as_text, pad_absent
from ..operators.filters import filter_in
from ..operators.layout import DATA_ROWS, WORKBOOK_ROWS, base_names, manifest, single_base_name
from ..operators.numbering import with_row_id
from ..operators.shape import destinations, shape, with_source
from ..runtime import materialize
from ..sinks.csv import write_csv, write_csv_headers, write_parquet
from ..sinks.workbook import write_workbooks
from ..sources.delimited import read_batch
from ..sources.profile import escape_glob, profile_files, text_lines
from .rows import pivot_csv, pivot_rows, pivot_sheets, placed_cells
from .spec import ExportSpec, PivotSpec
from .together import COUNTERS, ENDLESS, export_together

MANIFEST = "source_file string, dest_file string, dest_sheet string, sheet_part int, file_name string, sheet_name string, n_rows long, error string"


def export(
    df: DataFrame,
    spec: ExportSpec,
    path: str,
    run_id: str,
    order_by: Sequence[str] = (),
    cap: int = DATA_ROWS,
    workbook_rows: int = WORKBOOK_ROWS,
    bases: DataFrame | None = None,
    mode: str = "append",
) -> DataFrame:
    """Write all outputs of a job below ``path`` and return the manifest, one row per sheet or file.

    Rows keep input order, or the order of ``order_by``. ``bases`` gives the base name per source
    file, those without rows included; without it the names follow from the sources at hand. With ``mode="overwrite"`` CSV and
    parquet outputs replace what ``path`` holds; workbooks replace those of the same name.
    """
    df = without_output_names(df)
    labels = headers(df)
    order_by = [col(find(df, c).name) if isinstance(c, str) and find(df, c) else c for c in order_by]
    spec = spec.normalise(labels)
    typed = SOURCE_FILE not in df.columns
    source = with_source(df)
    # The filter comes first: row ids would keep it from the scan, and dropped rows need not be sorted.
    kept = filter_in(source, spec.filter_column, spec.filter_values)
    rows = shape(with_row_id(kept, order_by), replace(spec, filter_column="", filter_values=()))
    if spec.removes_duplicates(labels):
        # Naming and writing both start from here; the duplicates are removed once.
        rows = materialize(rows, "rows")
    counts = materialize(destinations(rows), "destinations")
    # Without a split, a source of which no row is left has an output of its header alone.
    bare = spec.output_format == "csv" and not spec.file_split_column
    if bases is None and typed:
        bases = single_base_name(df.sparkSession, run_id)
    elif bases is None:
        bare = False
        # A pivot also needs the sources of which no row is left.
        bases = materialize(base_names(source if spec.pivot else counts, run_id), "bases")
    sheets = spec.output_format == "xlsx"
    extension = spec.output_format
    plan = manifest(
        counts, run_id, extension, cap if sheets else ENDLESS, workbook_rows, spec.sheet_label, bases
    )
    plan = materialize(plan, "manifest")

    if sheets:
        write_workbooks(_sheet_rows(rows, plan, source, spec, bases, cap, workbook_rows), path)
    else:
        names = plan.select(SOURCE_FILE, DEST_FILE, "file_name")
        named = rows.join(names, [SOURCE_FILE, DEST_FILE])
        write = write_csv if extension == "csv" else write_parquet
        write(named, path, mode=mode)
        if bare:
            empty = bases.join(plan, SOURCE_FILE, "left_anti").select(SOURCE_FILE, F.concat("base_name", F.lit(".csv")).alias("file_name"))
            write_csv_headers(empty.select("file_name"), rows, path)
            nothing = [F.lit("").alias(DEST_FILE), F.lit("").alias(DEST_SHEET), F.lit(1).alias("sheet_part"), F.lit(0).cast("long").alias("n_rows")]
            plan = plan.unionByName(empty.select("*", *nothing), allowMissingColumns=True)
        if spec.pivot:
            write(pivot_csv(source, spec, bases), path, mode="append")
    name = F.col("sheet_name") if sheets else F.lit(None).cast("string")
    return plan.select(
        SOURCE_FILE,
        DEST_FILE,
        DEST_SHEET,
        "sheet_part",
        "file_name",
        name.alias("sheet_name"),
        "n_rows",
        F.lit(None).cast("string").alias("error"),
    )


def _sheet_rows(
    rows: DataFrame,
    plan: DataFrame,
    source: DataFrame,
    spec: ExportSpec,
    bases: DataFrame,
    cap: int,
    workbook_rows: int,
) -> DataFrame:
    """Header and data rows of all sheets, the pivot's included."""
    fields = [f for f in rows.schema.fields if f.name not in ENGINE_COLUMNS]
    cells = F.array(*[pad_absent(as_text(col(f.name), f.dataType)) for f in fields])
    where = ["file_name", "sheet_no", "sheet_name"]
    text = F.lit(None).cast("int").alias("text_cells")
    top = F.lit(1).cast("long").alias("sheet_row")
    header = F.array(*[F.lit(label(f)) for f in fields])
    out = plan.select(*where, top, text, header.alias("cells"))

    engine = [c for c in rows.columns if c in ENGINE_COLUMNS]
    out = out.unionByName(placed_cells(rows.select(*engine, cells.alias("cells")), plan, cap))
    if spec.pivot:
        out = out.unionByName(pivot_sheets(source, plan, spec, bases, cap, workbook_rows))
    return out


def write_pivot(
    df: DataFrame,
    pivot: PivotSpec,
    path: str,
    file_name: str,
    filter_column: str = "",
    filter_values: Sequence[str] = (),
    cap: int = DATA_ROWS,
) -> None:
    """Write the pivot of a table as a workbook of its own below ``path``.

    The wide form, or the long one where it has too many columns; further sheets after ``cap`` rows.
    """
    spec = ExportSpec(pivot=pivot, filter_column=filter_column, filter_values=filter_values)
    rows = pivot_rows(df.withColumn(SOURCE_FILE, F.lit("")), spec, cap)
    further = F.concat(F.lit(f"{spec.pivot_label}_"), F.col("_part"))
    sheets = rows.select(
        F.lit(file_name).alias("file_name"),
        (F.col("_part") + 1).alias("sheet_no"),
        F.when(F.col("_part") == 0, spec.pivot_label).otherwise(further).alias("sheet_name"),
        "sheet_row",
        "text_cells",
        "cells",
    )
    write_workbooks(sheets, path)


def _cause(failure: Exception) -> str:
    """The innermost cause that the message names, else its first line."""
    lines = str(failure).splitlines() or [""]
    causes = [x.removeprefix("Caused by: ") for x in lines if x.startswith("Caused by: ")]
    return (causes or lines)[-1 if causes else 0] or type(failure).__name__


def _unreadable(spark: SparkSession, files: Sequence[str]) -> dict[str, str]:
    """Files that cannot be read to their end, with the cause. Only failed jobs come here."""
    found = {}
    for file in files:
        try:
            text_lines(spark, [escape_glob(file)]).agg(F.max("seq"), F.sum(F.length("value"))).first()
        except Exception as failure:  # whatever the storage raises is the cause to report
            found[file] = _cause(failure)
    return found


def run_batch(
    spark: SparkSession,
    paths: str | Sequence[str],
    spec: ExportSpec,
    path: str,
    run_id: str,
    keep_blank_rows: bool = True,
    skip_unreadable: bool = False,
    mode: str = "append",
    **options: int,
) -> tuple[DataFrame, DataFrame]:
    """Export many text files with one spec; returns the manifest and one row of counters of this run.

    All files are exported together, whatever their headers. If that fails, or one header's outputs cannot be
    written, the headers go one by one; of one that fails its files are read one by one: those that cannot be
    read get an error row with the cause in the manifest, and the others are exported again. If all can be
    read, every file of that header gets an error row. The other headers go on in any case. Files with an error
    count for nothing but ``files_failed``.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    profile = profile_files(spark, paths, skip_unreadable)
    bases = materialize(base_names(profile.filter("error IS NULL"), run_id), "bases")
    empty = [F.lit(None).cast(t).alias(n) for n, t in (f.split() for f in MANIFEST.split(", ")[1:-1])]
    result = profile.filter("error IS NOT NULL").select(SOURCE_FILE, *empty, "error")
    tables = read_batch(spark, paths, keep_blank_rows, profile=profile)
    groups = [tables] if tables else []
    counters = []
    while groups:
        group = groups.pop(0)
        own = spark.createDataFrame([(f,) for table in group for f in table.files], f"{SOURCE_FILE} string")
        try:
            run = export_together(group, spec, path, run_id, bases.join(own, SOURCE_FILE, "left_semi"), mode=mode, **options)
        except Exception as failure:  # one table must not stop the others
            if len(group) > 1:
                groups = [[table] for table in group] + groups
                continue
            failures = {0: failure}
        else:
            failures = run.failures
            result = result.unionByName(run.manifest)
            counters.append(run.counters)
            mode = "append" if len(failures) < len(group) else mode
        for number, failure in failures.items():
            files = group[number].files
            broken = _unreadable(spark, files)
            others = [f for f in files if f not in broken]
            if broken and others:
                again = read_batch(spark, paths, keep_blank_rows, profile=profile.filter(col(SOURCE_FILE).isin(others)))
                groups += [[table] for table in again]
            rows = list((broken or dict.fromkeys(files, _cause(failure))).items())
            part = spark.createDataFrame(rows, "source_file string, error string").select(SOURCE_FILE, *empty, "error")
            result = result.unionByName(part)
    names = [f.split()[0] for f in COUNTERS.split(", ")]
    total = reduce(DataFrame.unionByName, counters, spark.createDataFrame([], COUNTERS))
    failed = F.lit(result.filter("error IS NOT NULL").count()).alias("files_failed")
    sums = [F.coalesce(F.sum(c), F.lit(0).cast("long")).alias(c) for c in names]
    return result, total.agg(F.lit(run_id).alias("run_id"), *sums, failed)


def export_batch(spark: SparkSession, paths: str | Sequence[str], spec: ExportSpec, path: str, run_id: str, **options: object) -> DataFrame:
    """:func:`run_batch` without the counters: the manifest alone."""
    return run_batch(spark, paths, spec, path, run_id, **options)[0]
