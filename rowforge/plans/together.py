"""Exports of tables with unlike headers as one run, with the counters of that very run.

What the headers have in common is done once for all of them: one pass says what becomes of every row, one
table of destinations and one manifest follow from it. Only writing goes header by header, as the columns differ.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..columns import DEST_FILE, DEST_SHEET, ROW_ID, SOURCE_FILE, col, headers, label, without_output_names
from ..operators.filters import mark_in
from ..operators.layout import DATA_ROWS, WORKBOOK_ROWS, manifest
from ..operators.projection import output_cell, resolve_selection
from ..operators.shape import DESTINATION, with_destination, with_source
from ..runtime import materialize
from ..sinks.csv import write_csv, write_csv_headers, write_parquet
from ..sinks.workbook import write_workbooks
from ..sources.delimited import TextTable
from .rows import pivot_csv, pivot_sheets, placed_cells
from .spec import ExportSpec

COUNTERS = "rows_in long, rows_kept long, rows_routed long, duplicates_removed long, rows_written long, outputs long"
ENDLESS = 1 << 60


@dataclass(frozen=True)
class Member:
    """The files of one header within a run."""

    number: int
    files: tuple[str, ...]
    source: DataFrame
    spec: ExportSpec
    fields: tuple[T.StructField, ...]
    unique: bool

    @classmethod
    def of(cls, number: int, table: TextTable, spec: ExportSpec) -> "Member":
        df = without_output_names(table.df)
        labels = headers(df)
        spec = spec.normalise(labels)
        fields = tuple(resolve_selection(df, spec.selected_columns))
        return cls(number, table.files, with_source(df), spec, fields, spec.removes_duplicates(labels))

    @property
    def bare(self) -> bool:
        """Whether a source of which no row is left has an output of its header alone."""
        return self.spec.output_format == "csv" and not self.spec.file_split_column

    def outcome(self) -> DataFrame:
        """Every row with its flags; its destination and its cells, as far as it gets one."""
        marked = mark_in(self.source, self.spec.filter_column, self.spec.filter_values, "_kept")
        marked = with_destination(marked, self.spec, drop=False)
        routed = F.col("_kept") & col(DEST_FILE).isNotNull() & col(DEST_SHEET).isNotNull()
        cells = F.array(*[output_cell(f) for f in self.fields])
        return marked.withColumn("_routed", routed).select(
            F.lit(self.number).alias("_member"),
            SOURCE_FILE,
            *[F.when(F.col("_routed"), col(c)).alias(c) for c in (DEST_FILE, DEST_SHEET)],
            ROW_ID,
            "_kept",
            "_routed",
            F.lit(self.unique).alias("_unique"),
            F.when(F.col("_routed"), cells).alias("cells"),
        )

    def columns(self, rows: DataFrame) -> DataFrame:
        """The cells of rows as columns again."""
        cells = [
            F.get("cells", F.lit(i)).alias(f.name, metadata={"label": label(f)}) for i, f in enumerate(self.fields)
        ]
        return rows.select(*[c for c in rows.columns if c != "cells"], *cells)


@dataclass(frozen=True)
class Run:
    """What a run wrote: manifest, counters, and the members that failed with their cause."""

    manifest: DataFrame
    counters: DataFrame
    failures: dict[int, Exception]


def _outcomes(members: Sequence[Member]) -> tuple[DataFrame, dict[int, DataFrame]]:
    """Rows with their number of copies, those without a destination included, and the rows to write by member."""
    single = {m.number: m.outcome() for m in members}
    rows = reduce(DataFrame.unionByName, single.values())
    flags = ["_member", *DESTINATION, "_kept", "_routed"]
    # Rows are parsed once and stored: filters on what becomes of them would parse every line anew for each cell.
    # Copies collapse before the shuffle, rows without a destination to one group per source and flag. Rows of headers
    # that keep their duplicates stay as they are: as groups of one row each they would fill the memory of their tasks.
    stored = {}
    if any(m.unique for m in members):
        grouped = rows.filter("_unique").groupBy(*flags, "cells").agg(
            F.min(ROW_ID).alias(ROW_ID), F.count(F.lit(1)).alias("copies")
        )
        stored[True] = materialize(grouped, "outcomes", ["_member"])
    if not all(m.unique for m in members):
        kept = rows.filter("NOT _unique").select(*flags, "cells", ROW_ID, F.lit(1).cast("long").alias("copies"))
        stored[False] = materialize(kept, "outcomes")
    own = {m.number: stored[m.unique].filter(F.col("_member") == m.number).filter("_routed") for m in members}
    return reduce(DataFrame.unionByName, stored.values()), own


def export_together(
    tables: Sequence[TextTable],
    spec: ExportSpec,
    path: str,
    run_id: str,
    bases: DataFrame,
    cap: int = DATA_ROWS,
    workbook_rows: int = WORKBOOK_ROWS,
    mode: str = "append",
) -> Run:
    """Write the outputs of all ``tables`` with one spec, whatever their headers.

    The counters are those of the jobs that write, not of a further pass: rows read, kept by the filter, with a
    destination and removed as duplicates come from the pass that finds the destinations; rows written are observed
    in the stage that writes, whose repeated tasks count once. A table that cannot be written is named in
    ``failures``; the others are written all the same.
    """
    members = [Member.of(i, table, spec) for i, table in enumerate(tables)]
    spark = tables[0].df.sparkSession
    outcomes, rows = _outcomes(members)
    tally = outcomes.groupBy("_member", *DESTINATION, "_kept", "_routed").agg(
        F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("n_rows"), F.min(ROW_ID).alias("first_row_id")
    )
    tally = materialize(tally, "tally")
    counts = tally.filter("_routed").select(*DESTINATION, "n_rows", "first_row_id")
    sheets, extension = spec.output_format == "xlsx", spec.output_format
    plan = manifest(counts, run_id, extension, cap if sheets else ENDLESS, workbook_rows, spec.sheet_label, bases)
    owners = spark.createDataFrame([(f, m.number) for m in members for f in m.files], f"{SOURCE_FILE} string, _member int")
    plan = materialize(plan.join(owners, SOURCE_FILE), "manifest")

    failures: dict[int, Exception] = {}
    written = 0
    headed = []

    if sheets:
        parts = []
        for m in members:
            own, mine = _of(plan, m), bases.join(_of(owners, m), SOURCE_FILE, "left_semi")
            placed = placed_cells(rows[m.number], own, cap)
            titles = F.array(*[F.lit(label(f)) for f in m.fields])
            top = [F.lit(1).cast("long").alias("sheet_row"), F.lit(None).cast("int").alias("text_cells"), titles.alias("cells")]
            parts += [own.select("file_name", "sheet_no", "sheet_name", *top), placed]
            if m.spec.pivot:
                parts.append(pivot_sheets(m.source, own, m.spec, mine, cap, workbook_rows))
        # Below the header; the rows of a pivot say how many of their cells are text.
        watch = Observation()
        data = F.count_if(F.col("text_cells").isNull() & (F.col("sheet_row") > 1)).alias("n")
        write_workbooks(reduce(DataFrame.unionByName, parts), path, observed=lambda df: df.observe(watch, data))
        written = watch.get.get("n", 0)
    else:
        write = write_csv if extension == "csv" else write_parquet
        for m in members:
            try:
                own, mine = _of(plan, m), bases.join(_of(owners, m), SOURCE_FILE, "left_semi")
                named = rows[m.number].join(own.select(SOURCE_FILE, DEST_FILE, "file_name"), [SOURCE_FILE, DEST_FILE])
                named = m.columns(named.select(ROW_ID, "file_name", "cells"))
                watch = Observation()
                write(named, path, mode=mode, observed=lambda df, w=watch: df.observe(w, F.count(F.lit(1)).alias("n")))
                mode = "append"
                empty = None
                if m.bare:
                    empty = mine.join(own, SOURCE_FILE, "left_anti")
                    empty = empty.select(SOURCE_FILE, F.concat("base_name", F.lit(".csv")).alias("file_name"), F.lit(m.number).alias("_member"))
                    write_csv_headers(empty.select("file_name"), named.drop("file_name"), path)
                if m.spec.pivot:
                    write(pivot_csv(m.source, m.spec, mine), path, mode="append")
            except Exception as failure:  # one table must not stop the others
                failures[m.number] = failure
            else:
                written += watch.get.get("n", 0)
                headed += [empty] if empty is not None else []

    for empty in headed:
        nothing = [F.lit("").alias(DEST_FILE), F.lit("").alias(DEST_SHEET), F.lit(1).alias("sheet_part"), F.lit(0).cast("long").alias("n_rows")]
        plan = plan.unionByName(empty.select("*", *nothing), allowMissingColumns=True)
    done = ~F.col("_member").isin(*failures) if failures else F.lit(True)
    name = F.col("sheet_name") if sheets else F.lit(None).cast("string")
    out = plan.filter(done).select(
        *DESTINATION, "sheet_part", "file_name", name.alias("sheet_name"), "n_rows", F.lit(None).cast("string").alias("error")
    )
    return Run(out, _counters(tally.filter(done), written), failures)


def _of(df: DataFrame, member: Member) -> DataFrame:
    return df.filter(F.col("_member") == member.number)


def _counters(tally: DataFrame, written: int) -> DataFrame:
    """One row of counters from the table of destinations, which has the rows without one as well."""

    def total(value: str, flag: str = "true") -> Column:
        return F.coalesce(F.sum(F.when(F.expr(flag), F.col(value))), F.lit(0).cast("long"))

    return tally.agg(
        total("copies").alias("rows_in"),
        total("copies", "_kept").alias("rows_kept"),
        total("copies", "_routed").alias("rows_routed"),
        (total("copies", "_routed") - total("n_rows", "_routed")).alias("duplicates_removed"),
        F.lit(written).cast("long").alias("rows_written"),
        F.count_if("_routed").alias("outputs"),
    )
