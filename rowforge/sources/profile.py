"""Encoding, delimiter, header and quoting of many text files, found in one distributed pass."""

from __future__ import annotations

import re
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..columns import SOURCE_FILE
from ..runtime import materialize

# Accepted extensions (any case), delimiters in order of preference, the probe length,
# byte order marks and the code page of files that are not UTF-8.
FILE_GLOB = "*.{[tT][sS][vV],[cC][sS][vV],[tT][xX][tT]}"
DELIMITERS = ("\t", ";", ",")
BYTE_ORDER_MARKS = (
    ("fffe0000", "utf-32-le"),
    ("0000feff", "utf-32-be"),
    ("fffe", "utf-16-le"),
    ("feff", "utf-16-be"),
)
FALLBACK_ENCODING = "windows-1251"
WIDE_ENCODINGS = {"utf-16-le": "UTF-16LE", "utf-16-be": "UTF-16BE", "utf-32-le": "UTF-32LE", "utf-32-be": "UTF-32BE"}

# Upper half of the fallback code page, by rule from its codec; an unassigned byte is U+FFFD.
_HIGH_LATIN1 = bytes(range(128, 256)).decode("latin-1")
_HIGH_FALLBACK = bytes(range(128, 256)).decode(FALLBACK_ENCODING, errors="replace")


def from_fallback(latin1: Column) -> Column:
    """Text of the fallback code page from its bytes read as ISO-8859-1, which Spark can always split."""
    return F.translate(latin1, _HIGH_LATIN1, _HIGH_FALLBACK)


def file_path() -> Column:
    """Path of the scanned file, percent escapes undone."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def text_lines(spark: SparkSession, paths: Sequence[str], **options: str) -> DataFrame:
    """Raw lines with their file, the start of their block and a number growing within the block."""
    lines = spark.read.options(recursiveFileLookup="true", pathGlobFilter=FILE_GLOB, **options).text(list(paths))
    return lines.select(
        "value",
        file_path().alias(SOURCE_FILE),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
    )


def _first_line(value: Column) -> Column:
    """Aggregate: the first line of a file. Only its first block can hold it."""
    return F.min_by(value, F.when(F.col("block") == 0, F.col("seq")))


def whole_cells(value: Column, delimiter: str) -> Column:
    """Whether a line is a whole record: every quoted cell that opens in it also ends in it.

    True only for lines made of properly quoted cells and cells that do not begin with a quote (a quote
    further on is plain text there), so a file whose lines all pass can be split at line ends.
    """
    cell = f'(?:"(?:[^"]|"")*+"|(?:[^"{delimiter}][^{delimiter}]*+)?)'
    return ~value.contains('"') | value.rlike(f"^{cell}(?:{delimiter}{cell})*+$")


def profile_files(spark: SparkSession, paths: Sequence[str], skip_unreadable: bool = False) -> DataFrame:
    """One row per file: ``source_file, encoding, delimiter, header_line, splittable, error``.

    The whole file decides whether it is UTF-8: it is if no line speaks against it, or if fewer lines do than
    there are lines with well-formed characters of several bytes (a few broken bytes then become U+FFFD). A
    UTF-8 mark is taken off by the scan, so such files count as utf-8. Files without a line have an error
    instead of a header.
    """
    unreadable = {"ignoreCorruptFiles": "true"} if skip_unreadable else {}
    lines = text_lines(spark, paths, **unreadable)
    value = F.col("value")
    # What a line shows against its file: not UTF-8, or cells that go on in the next line.
    issues = F.when(F.is_valid_utf8(value), 0).otherwise(1)
    for i, d in enumerate(DELIMITERS):
        issues = issues + F.when(whole_cells(value, d), 0).otherwise(2 << i)
    # Most lines of a long file say nothing and end here. The set holds 16 numbers at most; it also
    # makes this a hash aggregate, where the first line as text alone would cost a sort of the lines.
    several = F.is_valid_utf8(value) & (F.octet_length(value) > F.length(value))
    telling = lines.withColumns({"_issues": issues, "_several": several}).filter("block = 0 OR _issues <> 0 OR _several")
    found = telling.groupBy(SOURCE_FILE).agg(
        _first_line(value.cast("binary")).alias("head"),
        F.collect_set("_issues").alias("_issues"),
        (F.count_if(F.col("_issues").bitwiseAND(F.lit(1)) != 0) < F.count_if("_several")).alias("_mostly"),
    )

    def free_of(bit: int) -> Column:
        return ~F.exists("_issues", lambda x: x.bitwiseAND(F.lit(bit)) != 0)

    found = found.select(
        SOURCE_FILE,
        "head",
        (free_of(1) | F.col("_mostly")).alias("valid"),
        *[free_of(2 << i).alias(f"whole{i}") for i in range(len(DELIMITERS))],
    )
    marks = F.lower(F.hex(F.substring("head", 1, 4)))
    encoding = F.lit(None).cast("string")
    for mark, name in reversed(BYTE_ORDER_MARKS):
        encoding = F.when(marks.startswith(mark), name).otherwise(encoding)
    plain = F.when(F.col("valid"), "utf-8").otherwise(FALLBACK_ENCODING)
    # The only full pass over the text ends here; all that follows works on one row per file.
    found = materialize(found.withColumn("encoding", F.coalesce(encoding, plain)), "profile")

    # A line end of two or four bytes cannot be found in the bytes of the first pass.
    wide = None
    for name, charset in WIDE_ENCODINGS.items():
        files = [r[0] for r in found.filter(F.col("encoding") == name).select(SOURCE_FILE).collect()]
        if files:
            part = text_lines(spark, [escape_glob(f) for f in files], encoding=charset, lineSep="\n")
            part = part.filter("block = 0").groupBy(SOURCE_FILE).agg(
                F.decode(_first_line(F.col("value").cast("binary")), name[:6].upper()).alias("wide_line")
            )
            wide = part if wide is None else wide.unionByName(part)
    if wide is None:
        found = found.withColumn("wide_line", F.lit(None).cast("string"))
    else:
        found = found.join(wide, SOURCE_FILE, "left")

    narrow = (
        F.when(F.col("encoding") == FALLBACK_ENCODING, from_fallback(F.decode("head", "ISO-8859-1")))
        .when(F.col("encoding") == "utf-8", F.decode("head", "UTF-8"))
    )
    header = F.regexp_replace(F.coalesce("wide_line", narrow), r"^\uFEFF|\r[\s\S]*$", "")
    found = found.withColumn("header_line", header)
    line = F.col("header_line")
    counts = [F.length(line) - F.length(F.replace(line, F.lit(d), F.lit(""))) for d in DELIMITERS]
    most = F.greatest(*counts)
    default = F.when(F.lower(SOURCE_FILE).endswith(".csv"), ",").otherwise("\t")
    delimiter = F.when(most == 0, default)
    for d, n in zip(DELIMITERS, counts):
        delimiter = delimiter.when(n == most, d)
    found = found.withColumn("delimiter", delimiter)
    splittable = F.lit(False)
    for i, d in enumerate(DELIMITERS):
        splittable = F.when(F.col("delimiter") == d, F.col(f"whole{i}")).otherwise(splittable)
    found = found.withColumn(
        "splittable", splittable & ~F.col("encoding").isin(*WIDE_ENCODINGS)
    )

    # A file without a line yields no row, so the list of files comes from the reader's own listing.
    listed = [(re.sub("^file:/+", "file:/", unquote(f)),) for f in lines.inputFiles()]
    files = spark.createDataFrame(listed, f"{SOURCE_FILE} string")
    error = F.when(F.col("encoding").isNull(), "no line read")
    return files.join(found, SOURCE_FILE, "left").select(
        SOURCE_FILE, "encoding", "delimiter", "header_line", "splittable", error.alias("error")
    )


def escape_glob(path: str) -> str:
    """A literal path for a reader that expands patterns."""
    return "".join("\\" + ch if ch in "\\*?[]{}" else ch for ch in path)
