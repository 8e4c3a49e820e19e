"""Records and lines that cross the line breaks a scan splits at, put together in a distributed way.

A line carries a state over to the next one: whether a quoted cell is open, or, in encodings of several bytes,
how far the break is off a character. What a line does to the state is known from its text alone: it sets the
state, or it adds to it modulo the number of states. Within a block the effects of its lines are put together
by running values that hold for every state the block may start in; a table with one row per block carries
the true state from block to block. So a file of any size is read by many tasks, and only the lines of
records that go over several lines are shuffled a second time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..columns import SOURCE_FILE
from ..runtime import materialize
from .profile import DELIMITERS, FALLBACK_ENCODING, WIDE_ENCODINGS, escape_glob, text_lines


def ends_open(line: Column, delimiter: Column) -> Column:
    """Whether a line that starts a record ends within a quoted cell.

    A quote opens a cell only where the cell begins; two quotes in a quoted cell are one of its characters, and
    what follows the closing quote, up to the delimiter, is plain text.
    """
    closed = F.lit(True)
    for d in DELIMITERS:
        cell = f'(?:"(?:[^"]|"")*+"[^{d}]*+|(?:[^"{d}][^{d}]*+)?)'
        closed = F.when(delimiter == d, line.rlike(f"\\A{cell}(?:{d}{cell})*+\\z")).otherwise(closed)
    return ~closed


def join_lines(lines: DataFrame, states: int, add: Column, put: Column, glue: str) -> DataFrame:
    """Lines put together until the state is back at 0.

    ``lines`` has ``source_file``, ``block``, ``seq`` and ``value``. A line that starts in state s ends in state
    ``put``, or ``(s + add) % states`` where that is null; a file starts in state 0. The result has the same
    columns, with ``block`` and ``seq`` of the first line and the values joined by ``glue``, and ``head``: whether
    this is the first line of its file. A line whose state never comes back to 0 takes the rest of its file.
    """
    within = Window.partitionBy(SOURCE_FILE, "block").orderBy("seq")
    earlier = within.rowsBetween(Window.unboundedPreceding, -1)
    every = range(states)

    def mod(x: Column) -> Column:
        return F.pmod(x, F.lit(states)).cast("int")

    def after(start: Column, total: Column, fixed: Column) -> Column:
        """State after lines that add ``total`` and last set the state to ``fixed`` less what came before."""
        return mod(F.coalesce(fixed, start) + total)

    # Sums of the block's lines before this one, and the state last set, reduced by the sum up to there.
    marked = lines.withColumns({"_add": F.when(put.isNull(), add).otherwise(0).cast("long"), "_put": put.cast("long")})
    marked = marked.withColumn("_total", F.coalesce(F.sum("_add").over(earlier), F.lit(0)))
    marked = marked.withColumn("_fixed", F.last(F.col("_put") - F.col("_total"), ignorenulls=True).over(earlier))

    def start_of(entry: Column) -> Column:
        return after(entry, F.col("_total"), F.col("_fixed"))

    def end_of(start: Column) -> Column:
        return mod(F.coalesce(F.col("_put"), start + F.col("_add")))

    def opens(entry: Column) -> Column:
        return (start_of(entry) == 0) & (end_of(start_of(entry)) != 0)

    # The line before this one in the block that opened a record, for every state the block may start in.
    marked = marked.withColumns(
        {f"_open{e}": F.last(F.when(opens(F.lit(e)), F.col("seq")), ignorenulls=True).over(earlier) for e in every}
        | {"head": F.lag("seq").over(within).isNull() & (F.col("block") == 0)}
    )
    marked = materialize(marked, "lines")

    # What a block does as a whole is what its last line knows.
    opened = [F.when(opens(F.lit(e)), F.col("seq")).otherwise(F.col(f"_open{e}")).alias(f"o{e}") for e in every]
    total = F.col("_total") + F.when(F.col("_put").isNull(), F.col("_add")).otherwise(0)
    last = F.struct(total.alias("total"), F.coalesce(F.col("_put") - F.col("_total"), "_fixed").alias("fixed"), *opened)
    blocks = marked.groupBy(SOURCE_FILE, "block").agg(F.max_by(last, "seq").alias("_b")).select(SOURCE_FILE, "block", "_b.*")
    # One row per block: a file has as many here as a scan splits it into.
    before = Window.partitionBy(SOURCE_FILE).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_sum", F.coalesce(F.sum("total").over(before), F.lit(0)))
    set_to = F.last(F.col("fixed") - F.col("_sum"), ignorenulls=True).over(before)
    blocks = blocks.withColumn("_entry", after(F.lit(0), F.col("_sum"), set_to))
    own = reduce(lambda rest, e: F.when(F.col("_entry") == e, F.col(f"o{e}")).otherwise(rest), every, F.lit(None).cast("long"))
    blocks = blocks.withColumn("_own", own)
    carried = F.last(F.when(F.col("_own").isNotNull(), F.struct("block", F.col("_own").alias("seq"))), ignorenulls=True)
    blocks = blocks.withColumn("_carried", carried.over(before))
    blocks = materialize(blocks.select(SOURCE_FILE, "block", "_entry", "_carried"), "blocks")

    placed = marked.join(blocks, [SOURCE_FILE, "block"]).withColumn("_start", start_of(F.col("_entry")))
    placed = placed.withColumn("_end", end_of(F.col("_start")))
    columns = [SOURCE_FILE, "block", "seq", "value", "head"]
    whole = placed.filter("_start = 0 AND _end = 0").select(*columns)
    parts = placed.filter("_start <> 0 OR _end <> 0")
    opener = reduce(
        lambda rest, e: F.when(F.col("_entry") == e, F.col(f"_open{e}")).otherwise(rest), every, F.lit(None).cast("long")
    )
    here = F.when(opener.isNotNull(), F.struct("block", opener.alias("seq"))).otherwise(F.col("_carried"))
    record = F.when(F.col("_start") == 0, F.struct("block", "seq")).otherwise(here)
    pieces = parts.select(SOURCE_FILE, record.alias("_r"), F.struct("block", "seq", "value").alias("_p"), "head")
    joined = pieces.groupBy(SOURCE_FILE, "_r").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("_p")), lambda p: p["value"]), glue).alias("value"),
        F.max("head").alias("head"),
    )
    return whole.unionByName(joined.select(SOURCE_FILE, "_r.block", "_r.seq", "value", "head"))


def quoted_records(lines: DataFrame) -> DataFrame:
    """Lines of text put together to records; line breaks inside quoted cells become ``\\n``.

    ``lines`` has ``delimiter`` besides the columns of :func:`join_lines`.
    """
    value, delimiter = F.col("value"), F.col("delimiter")
    plain = ~value.contains('"')
    flagged = lines.withColumns(
        {
            "_o": F.when(plain, 0).when(ends_open(value, delimiter), 1).otherwise(0),
            "_i": F.when(plain, 1).when(ends_open(F.concat(F.lit('"'), value), delimiter), 1).otherwise(0),
        }
    )
    put = F.when(F.col("_o") == F.col("_i"), F.col("_o"))
    return join_lines(flagged, 2, F.when(F.col("_o") == 1, 1).otherwise(0), put, "\n")


def wide_lines(spark: SparkSession, files: list[str], encoding: str) -> DataFrame:
    """Decoded lines of files in UTF-16 or UTF-32, byte order marks and carriage returns at line ends taken off.

    The scan breaks wherever the bytes of a line feed stand, also across two characters; such breaks are
    undone by how far they are off a whole character.
    """
    charset = WIDE_ENCODINGS[encoding]
    unit = 2 if "16" in charset else 4
    raw = text_lines(spark, [escape_glob(f) for f in files], encoding=charset, lineSep="\n")
    # Bytes as characters, which can be joined as text.
    bytes_ = F.col("value").cast("binary")
    raw = raw.withColumns({"value": F.decode(bytes_, "ISO-8859-1"), "_size": F.octet_length(bytes_)})
    feed = "\n".encode(charset.replace("UTF-", "utf-")).decode("latin-1")
    lines = join_lines(raw, unit, F.col("_size"), F.lit(None).cast("int"), feed)
    mark = "\ufeff".encode(charset.replace("UTF-", "utf-"))
    text = F.decode(F.concat(F.lit(mark), F.encode("value", "ISO-8859-1")), charset[:6])
    text = F.when(F.col("head"), F.regexp_replace(text, "\\A\ufeff", "")).otherwise(text)
    return lines.withColumn("value", F.regexp_replace(text, "\r\\z", ""))


def batch_records(spark: SparkSession, files: DataFrame) -> DataFrame:
    """``source_file, block, seq, value`` of the records of all ``files`` (``source_file, encoding, delimiter``).

    All files of one byte per line feed share a scan, and so do those of each wide encoding; their lines are put
    together to records in one go. Text in the older code page is still in ISO-8859-1.
    """
    known = {r[SOURCE_FILE]: r["encoding"] for r in files.select(SOURCE_FILE, "encoding").collect()}
    narrow = [escape_glob(f) for f, e in known.items() if e not in WIDE_ENCODINGS]
    parts = []
    if narrow:
        raw = text_lines(spark, narrow).join(F.broadcast(files.select(SOURCE_FILE, "encoding", "delimiter")), SOURCE_FILE)
        latin1 = F.decode(F.col("value").cast("binary"), "ISO-8859-1")
        text = F.when(F.col("encoding") == FALLBACK_ENCODING, latin1).otherwise(F.make_valid_utf8("value"))
        parts.append(raw.withColumn("value", text).select(SOURCE_FILE, "block", "seq", "value", "delimiter"))
    for encoding in sorted(set(known.values()) & set(WIDE_ENCODINGS)):
        lines = wide_lines(spark, [f for f, e in known.items() if e == encoding], encoding)
        lines = lines.join(F.broadcast(files.select(SOURCE_FILE, "delimiter")), SOURCE_FILE)
        parts.append(lines.select(SOURCE_FILE, "block", "seq", "value", "delimiter"))
    return quoted_records(reduce(DataFrame.unionByName, parts)).select(SOURCE_FILE, "block", "seq", "value")


def header_places(records: DataFrame) -> DataFrame:
    """``source_file, _first``: place of each file's first record that is not an empty line, found block by block."""
    blocks = records.filter("value <> ''").groupBy(SOURCE_FILE, "block").agg(F.min("seq").alias("seq"))
    return blocks.groupBy(SOURCE_FILE).agg(F.min(F.struct("block", "seq")).alias("_first"))


def header_records(records: DataFrame) -> DataFrame:
    """``source_file, _first, header_text``: place and text of each file's first record that is not an empty line."""
    place = F.struct("block", "seq")
    found = records.filter("value <> ''").groupBy(SOURCE_FILE)
    return found.agg(F.min(place).alias("_first"), F.min_by("value", place).alias("header_text"))
