"""Questions about the rows: distinct values, counts, split forecast, paging, search."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..columns import DEST_FILE, DEST_SHEET, ROW_ID, SOURCE_FILE, col, data_fields, find, headers, label, missing
from ..functions import as_text, contains_ci, is_blank
from ..plans.spec import ExportSpec
from ..runtime import materialize
from .filters import filter_in
from .numbering import number_rows, position_rows, ranks, running, slice_of, with_row_id
from .shape import shape

# Pages that end by this row come from a top-k, a cheaper way to the same order.
TOP_ROWS = 5_000


def distinct_values(
    df: DataFrame, column: str, filter_column: str = "", filter_values: Iterable[str] | DataFrame = ()
) -> DataFrame:
    """Distinct non-blank values of a column in code-point order; column ``value``."""
    field = find(df, column)
    if field is None:
        missing(f"column not found, no values: {column!r}", strict=False)
        return df.select(F.lit("").alias("value")).filter(F.lit(False))
    df = filter_in(df, filter_column, filter_values, short_rows="keep")
    value = as_text(col(field.name), field.dataType)
    return df.filter(~is_blank(col(field.name), field.dataType)).select(value.alias("value")).distinct().orderBy("value")


def search_values(values: DataFrame, text: str) -> DataFrame:
    """Distinct values that contain ``text``, without regard to case."""
    return values.filter(contains_ci(F.col("value"), text)) if text else values


def count_values(values: DataFrame, text: str) -> DataFrame:
    """One row: how many of how many values match."""
    hit = contains_ci(F.col("value"), text) if text else F.lit(True)
    return values.agg(F.count_if(hit).alias("n_found"), F.count(F.lit(1)).alias("n_values"))


def count_rows(df: DataFrame, filter_column: str = "", filter_values: Iterable[str] | DataFrame = ()) -> DataFrame:
    """Plain row count; rows too short for the filter column count."""
    kept = filter_in(df, filter_column, filter_values, short_rows="keep")
    return kept.agg(F.count(F.lit(1)).alias("n_rows"))


def export_count(df: DataFrame, spec: ExportSpec) -> DataFrame:
    """Rows an export will write, per source file."""
    return shape(df.drop(ROW_ID), spec).groupBy(SOURCE_FILE).agg(F.count(F.lit(1)).alias("n_rows"))


def forecast(df: DataFrame, spec: ExportSpec) -> DataFrame:
    """Rows per file and sheet over all source files together.

    Files whose header lacks a split column take no part: their table must not be passed here.
    """
    for column in (spec.file_split_column, spec.sheet_split_column):
        if column and column not in headers(df):
            raise ValueError(f"split column not found: {column!r}")
    rows = shape(df.drop(ROW_ID), spec, across_files=True)
    return rows.groupBy(DEST_FILE, DEST_SHEET).agg(F.count(F.lit(1)).alias("n_rows"))


def rank_forecast(counts: DataFrame) -> DataFrame:
    """Add file totals and 1-based ranks: files by total, sheets by rows, ties by name."""
    counts = materialize(counts, "counts")  # small; its total must not read the input again
    totals = counts.groupBy(DEST_FILE).agg(F.sum("n_rows").alias("file_total"))
    joined = counts.join(totals, DEST_FILE)
    order = [F.desc("file_total"), F.asc(DEST_FILE), F.desc("n_rows"), F.asc(DEST_SHEET)]
    ordered = with_row_id(joined, order)
    ranked = number_rows(ordered, "sheet_rank", [DEST_FILE])
    ranked = running(ranked, (F.col("sheet_rank") == 1).cast("long"), "file_rank")
    return ranked.select(
        DEST_FILE,
        DEST_SHEET,
        "n_rows",
        "file_total",
        F.col("file_rank").cast("int").alias("file_rank"),
        F.col("sheet_rank").cast("int").alias("sheet_rank"),
    )


def forecast_totals(counts: DataFrame) -> DataFrame:
    """One row: number of files, of sheets in them, of rows."""
    per_file = counts.groupBy(DEST_FILE).agg(F.count(F.lit(1)).alias("s"), F.sum("n_rows").alias("n"))
    return per_file.agg(
        F.count(F.lit(1)).alias("n_files"),
        F.coalesce(F.sum("s"), F.lit(0)).alias("n_sheets"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
    )


def page(df: DataFrame, number: int, size: int, order_by: Sequence[str] = ()) -> DataFrame:
    """Page ``number`` (from 1) of ``size`` rows, in input order or by ``order_by``.

    In input order every source file has pages of its own, as a search counts positions; by keys the table has.
    However deep the page is, only counts or keys are looked at for the whole table; whole rows are read
    once and only those of the page go on. Ties of ``order_by`` come in input order where rows have ids,
    else by a hash of the row, so that pages never repeat or skip a row.
    """
    start = (number - 1) * size
    if order_by:
        return _page_by_keys(df, start, size, order_by)
    rows = with_row_id(df)
    by = [c for c in (SOURCE_FILE,) if c in rows.columns]
    if not by and start + size <= TOP_ROWS:
        return rows.orderBy(ROW_ID).offset(start).limit(size).select(*map(col, df.columns))
    blocks = rows.groupBy(*map(col, by), slice_of().alias("_slice")).agg(F.count(F.lit(1)).alias("_n"))
    # One row per block of the input, so the window stays small.
    earlier = Window.partitionBy(*map(col, by)).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    blocks = blocks.filter((F.col("_before") < start + size) & (F.col("_before") + F.col("_n") > start))
    blocks = blocks.select(*[col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col("_slice").alias("_s"), "_before")
    match = slice_of() == F.col("_s")
    for i, c in enumerate(by):
        match = match & col(c).eqNullSafe(F.col(f"_k{i}"))
    # Blocks that overlap the page: for each source no more than rows of the page.
    near = rows.join(blocks, match)
    place = Window.partitionBy(*[f"_k{i}" for i in range(len(by))], "_s").orderBy(ROW_ID)
    placed = near.withColumn("_pos", F.col("_before") + F.row_number().over(place) - 1)
    placed = placed.filter(F.col("_pos").between(start, start + size - 1))
    return placed.orderBy(*map(col, by), "_pos").select(*map(col, df.columns))


def _page_by_keys(df: DataFrame, start: int, size: int, order_by: Sequence[str]) -> DataFrame:
    """The page from a sort of keys alone; equal keys and hash mean rows that may stand for each other."""
    hashed = [col(f.name) for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    keys = dict.fromkeys([*order_by, *(c for c in (SOURCE_FILE, ROW_ID) if c in df.columns)])
    named = {f"_k{i}": col(c) for i, c in enumerate(keys)} | {"_hash": F.xxhash64(*hashed)}
    if start + size <= TOP_ROWS:
        return df.orderBy(*named.values()).offset(start).limit(size)
    narrow = df.select(*[c.alias(n) for n, c in named.items()])
    placed = position_rows(narrow, list(named), "_pos").filter(F.col("_pos").between(start, start + size - 1))
    wanted = placed.groupBy(*named).agg(F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_first"))
    match = F.lit(True)
    for name, value in named.items():
        match = match & value.eqNullSafe(F.col(name))
    found = df.join(F.broadcast(wanted), match)  # at most ``size`` rows
    copies = Window.partitionBy("_first").orderBy(F.lit(0))
    found = found.withColumn("_copy", F.row_number().over(copies)).filter(F.col("_copy") <= size)
    found = found.filter(F.col("_copy") <= F.col("_n"))
    return found.orderBy("_first", "_copy").select(*map(col, df.columns))


def page_info(df: DataFrame, size: int) -> DataFrame:
    """One row: total rows and number of pages, at least one."""
    return df.agg(F.count(F.lit(1)).alias("total_rows")).withColumn(
        "n_pages", F.greatest(F.lit(1), F.ceil(F.col("total_rows") / size)).cast("long")
    )


def row_matches(df: DataFrame, text: str, column: str | None = None) -> Column:
    """Whether a row has the text in one column, or in any if none is given or it is unknown."""
    field = find(df, column) if column else None
    hit = F.lit(False)
    for f in [field] if field is not None else data_fields(df):
        hit = hit | contains_ci(as_text(col(f.name), f.dataType), text)
    return hit


def search_rows(
    df: DataFrame, text: str, column: str | None = None, order_by: Sequence[str] = ()
) -> DataFrame:
    """0-based positions of the matching rows with their ``order_by`` columns.

    Without ``order_by`` positions are those of the input order, counted in each source file, of the rows that
    are there, whatever filters left out. They need no sort: see :func:`ranks`. For another order, the order
    columns and one flag are stored first, so that sampling and sorting never touch the searched texts again.
    """
    order = list(order_by) or [c for c in (SOURCE_FILE, ROW_ID) if c in df.columns]
    hit = row_matches(df, text, column)
    if not order_by:
        return ranks(with_row_id(df), hit).select("row_pos", *map(col, order))
    narrow = materialize(df.select(*map(col, order), hit.alias("_hit")), "search")
    return position_rows(narrow, order).filter("_hit").select("row_pos", *map(col, order))


def search_summary(
    df: DataFrame, text: str, size: int, column: str | None = None, order_by: str = "", per_source: bool = False
) -> DataFrame:
    """One row: number of matches and the page of the first one (NULL without matches).

    ``per_source`` gives a row for each source file instead, with pages as :func:`page` counts them.

    ``order_by`` names one unique column. The first match is the smallest key among the matches, and
    its position is the number of smaller keys, so one pass over the texts and one over the keys do;
    nothing is sorted or shuffled. Without it, positions are those of the input order.
    """
    if order_by:
        key = col(order_by)
        hits = df.filter(row_matches(df, text, column)).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first"))
        before = df.select(key.alias("_key")).filter(F.col("_key") < hits.select("first").scalar())
        found = before.agg(F.count(F.lit(1)).alias("_at")).select(hits.select("n").scalar().alias("n_matches"), "_at")
    else:
        found = search_rows(df, text, column).agg(F.count(F.lit(1)).alias("n_matches"), F.min("row_pos").alias("_at"))
    first = F.when(F.col("n_matches") > 0, F.floor(F.col("_at") / size) + 1)
    if per_source:
        found = search_rows(df, text, column).groupBy(SOURCE_FILE)
        found = found.agg(F.count(F.lit(1)).alias("_m"), F.min("row_pos").alias("_at"))
        found = df.select(SOURCE_FILE).distinct().join(found, SOURCE_FILE, "left")
        found = found.withColumn("n_matches", F.coalesce("_m", F.lit(0)))
        return found.select(SOURCE_FILE, "n_matches", first.cast("long").alias("first_page"))
    return found.select("n_matches", first.cast("long").alias("first_page"))


def mark_cells(rows: DataFrame, text: str) -> DataFrame:
    """Add ``matched_columns``: labels of the cells that contain the text, whatever column was searched."""
    marks = [
        F.when(contains_ci(as_text(col(f.name), f.dataType), text), F.lit(label(f))) for f in data_fields(rows)
    ]
    return rows.withColumn("matched_columns", F.array_compact(F.array(*marks)))
