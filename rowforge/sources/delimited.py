"""Delimited text files as all-string tables."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..columns import ROW_ID, SOURCE_FILE, col, numbered_labels, unique_physical_names
from ..operators.numbering import SLICE_BITS
from ..runtime import pin_splits
from .profile import (
    FALLBACK_ENCODING,
    escape_glob,
    from_fallback,
    profile_files,
    text_lines,
    whole_cells,
)
from .records import batch_records, header_places, header_records

# Row ids keep the block start in units of this many bits; blocks of a scan are far larger.
BLOCK_BITS = 14
_RAW = "_raw_record"


@dataclass(frozen=True)
class TextTable:
    """Files that share dialect and header, as one table with ``source_file`` and ``row_id``."""

    df: DataFrame
    headers: tuple[str, ...]
    files: tuple[str, ...]
    encoding: str
    delimiter: str
    splittable: bool


def _row_id(block: Column, seq: Column) -> Column:
    """Row id in file order: block of the file in the high bits, place in the scan task in the low ones."""
    place = seq.bitwiseAND(F.lit((1 << SLICE_BITS) - 1))
    return F.shiftleft(F.shiftright(block, BLOCK_BITS), SLICE_BITS).bitwiseOR(place)


def _repaired(width: int, delimiter: str, fallback: bool) -> list[Column]:
    """Cells with absent (NULL) and empty ('') told apart.

    The reader gives NULL for both. A record of the wrong length carries its text, from which the
    number of its cells follows; every other record is full.
    """
    raw = F.col(_RAW)
    outside = F.regexp_replace(raw, f'(^|{delimiter})"(?:[^"]|"")*+(?:"|\\z)', "$1")
    present = F.length(outside) - F.length(F.replace(outside, F.lit(delimiter), F.lit(""))) + 1
    n_cells = F.when(raw.isNull(), F.lit(width)).otherwise(present)
    cells = []
    for i in range(width):
        cell = F.coalesce(F.col(f"_c{i}"), F.lit(""))
        cells.append(F.when(F.lit(i) < n_cells, from_fallback(cell) if fallback else cell))
    return cells


def read_dialect(
    spark: SparkSession,
    files: Sequence[str],
    encoding: str,
    delimiter: str,
    headers: Sequence[str],
    splittable: bool,
    keep_blank_rows: bool = True,
    mark_ragged: bool = False,
    records: DataFrame | None = None,
) -> DataFrame:
    """Files of a known dialect and header, without a profile pass over them.

    ``splittable`` promises that no quoted cell holds a line end; such files are read line by line. Other files
    are split among tasks as well, and lines that a quoted cell spans are put together. Either way empty lines
    outside quotes are rows of absent cells, unless ``keep_blank_rows`` is off, and rows of empty cells stay.
    A cell must fit into memory; one that is never closed takes the rest of its file. ``records`` may hand in
    the records of those other files.
    """
    pin_splits(spark)
    width = len(headers)
    schema = ", ".join([*(f"_c{i} string" for i in range(width)), f"{_RAW} string"])
    options = {
        "sep": delimiter,
        "quote": '"',
        "escape": '"',
        "mode": "PERMISSIVE",
        "columnNameOfCorruptRecord": _RAW,
        "maxColumns": str(max(20480, 4 * width)),
    }
    fallback = encoding == FALLBACK_ENCODING
    if splittable:
        lines = text_lines(spark, [escape_glob(f) for f in files])
        text = F.decode(F.col("value").cast("binary"), "ISO-8859-1") if fallback else F.make_valid_utf8("value")
        first = lines.filter("block = 0").groupBy(SOURCE_FILE).agg(F.min("seq").alias("_first"))
        # One row per file: without the broadcast all lines of a file would meet in one task.
        body = lines.join(F.broadcast(first), SOURCE_FILE).filter(F.col("seq") != F.col("_first"))
    else:
        text = F.col("value")
        if records is None:
            dialect = [F.lit(encoding).alias("encoding"), F.lit(delimiter).alias("delimiter")]
            named = spark.createDataFrame([(f,) for f in files], f"{SOURCE_FILE} string").select(SOURCE_FILE, *dialect)
            records = batch_records(spark, named)
        own = records.filter(F.col(SOURCE_FILE).isin(*files))
        body = own.join(F.broadcast(header_places(own)), SOURCE_FILE).filter(F.struct("block", "seq") > F.col("_first"))
    if not keep_blank_rows:
        body = body.filter(F.col("value") != "")
    record = F.from_csv(text, F.lit(schema), options)
    blank = F.col("value") == ""
    rows = body.select(SOURCE_FILE, "block", "seq", blank.alias("_blank"), record.alias("_r"))
    raw = F.when(F.col("_blank"), F.lit("")).otherwise(F.col(f"_r.{_RAW}"))
    rows = rows.select(
        SOURCE_FILE, "block", "seq", *[F.col(f"_r._c{i}").alias(f"_c{i}") for i in range(width)], raw.alias(_RAW)
    )
    blank = F.col(_RAW) == ""
    names = unique_physical_names(headers)
    cells = [F.when(~F.coalesce(blank, F.lit(False)), c) for c in _repaired(width, delimiter, fallback)]
    return rows.select(
        SOURCE_FILE,
        _row_id(F.col("block"), F.col("seq")).alias(ROW_ID),
        *[c.alias(n, metadata={"label": h}) for c, n, h in zip(cells, names, headers)],
        *([(F.col(_RAW).isNotNull() & (F.length(F.coalesce(F.col("_c0"), F.lit(""))) >= 0)).alias("_ragged")] if mark_ragged else []),
    )


def read_batch(
    spark: SparkSession,
    paths: str | Sequence[str],
    keep_blank_rows: bool = True,
    skip_unreadable: bool = False,
    profile: DataFrame | None = None,
    mark_ragged: bool = False,
) -> list[TextTable]:
    """The tables of a batch, one per dialect and header.

    Empty lines outside quotes are rows of absent cells unless ``keep_blank_rows`` is off. All files are split
    among tasks; those with cells that span lines, and two- and four-byte encodings, take a shuffle for it.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    if profile is None:
        profile = profile_files(spark, paths, skip_unreadable)
    head = F.col("header_line")
    whole = F.lit(False)
    for d in ("\t", ";", ","):
        whole = F.when(F.col("delimiter") == d, whole_cells(head, d)).otherwise(whole)
    readable = profile.filter("error IS NULL").withColumn("_whole", whole)
    # A header that goes on in the next line is read file by file.
    readable = readable.withColumn("_alone", F.when(~F.col("_whole") | (head == ""), F.col(SOURCE_FILE)))
    groups = (
        readable.groupBy("encoding", "delimiter", "header_line", "splittable", "_alone")
        .agg(F.sort_array(F.collect_list(SOURCE_FILE)).alias("files"))
        .collect()
    )
    # What is not read line by line goes through one plan, whatever its dialects and headers.
    joined = [f for g in groups if not (g.splittable and g["_alone"] is None) for f in g.files]
    records = None
    starts: dict[str, str] = {}
    if joined:
        others = readable.filter(F.col(SOURCE_FILE).isin(*joined)).select(SOURCE_FILE, "encoding", "delimiter")
        records = batch_records(spark, others)
        alone = [g["_alone"] for g in groups if g["_alone"] is not None]
        if alone:
            heads = header_records(records.filter(F.col(SOURCE_FILE).isin(*alone)))
            starts = {r[SOURCE_FILE]: r["header_text"] for r in heads.collect()}
    tables = []
    for g in sorted(groups, key=lambda g: g.files[0]):
        line = g.header_line
        if g["_alone"] is not None:
            line = starts.get(g["_alone"], "")
            if g.encoding == FALLBACK_ENCODING:
                line = line.encode("latin-1").decode(FALLBACK_ENCODING, errors="replace")
        headers = next(csv.reader([line], delimiter=g.delimiter), [])
        if not headers:
            continue
        by_line = g.splittable and g["_alone"] is None
        df = read_dialect(
            spark, g.files, g.encoding, g.delimiter, headers, by_line, keep_blank_rows, mark_ragged, records
        )
        tables.append(TextTable(df, tuple(headers), tuple(g.files), g.encoding, g.delimiter, by_line))
    return tables


def read_delimited(spark: SparkSession, paths: str | Sequence[str], **options: bool) -> DataFrame:
    """A batch as one table: columns matched by exact header text, a column a file lacks is absent in its rows."""
    tables = read_batch(spark, paths, **options)
    if not tables:
        raise ValueError("no readable file")
    # A column is its header text and which of equal texts it is; names that differ in case stay apart.
    labelled = [numbered_labels(table.headers) for table in tables]
    labels = list(dict.fromkeys(x for own in labelled for x in own))
    names = dict(zip(labels, unique_physical_names([text for text, _ in labels]), strict=True))
    union = None
    for table, own in zip(tables, labelled, strict=True):
        engine = [c for c in table.df.columns if c in (SOURCE_FILE, ROW_ID, "_ragged")]
        physical = dict(zip(own, [c for c in table.df.columns if c not in engine], strict=True))
        cells = [
            (col(physical[x]) if x in physical else F.lit(None).cast("string")).alias(names[x], metadata={"label": x[0]})
            for x in labels
        ]
        part = table.df.select(*engine, *cells)
        union = part if union is None else union.union(part)
    return union


def profile_batch(spark: SparkSession, paths: str | Sequence[str], skip_unreadable: bool = False) -> DataFrame:
    """One row per file with data: dialect, headers, rows, ragged rows; files with an error keep a row too.

    Files with a header but no data row are left out.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    profile = profile_files(spark, paths, skip_unreadable)
    counted = None
    for table in read_batch(spark, paths, profile=profile, mark_ragged=True):
        counts = table.df.groupBy(SOURCE_FILE).agg(
            F.count(F.lit(1)).alias("n_rows"), F.count_if("_ragged").alias("n_ragged")
        )
        counts = counts.withColumn("headers", F.array(*[F.lit(h) for h in table.headers]))
        counted = counts if counted is None else counted.unionByName(counts)
    if counted is None:
        counted = spark.createDataFrame([], f"{SOURCE_FILE} string, n_rows long, n_ragged long, headers array<string>")
    joined = profile.join(counted, SOURCE_FILE, "left").filter("error IS NOT NULL OR n_rows > 0")
    return joined.select(SOURCE_FILE, "encoding", "delimiter", "headers", "n_rows", "n_ragged", "error")


def batch_total(profile: DataFrame) -> DataFrame:
    """One row: files with data, their rows, headers of the first file in path order."""
    good = profile.filter("error IS NULL")
    return good.agg(
        F.count(F.lit(1)).alias("n_files"),
        F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"),
        F.min_by("headers", SOURCE_FILE).alias("headers"),
    )
