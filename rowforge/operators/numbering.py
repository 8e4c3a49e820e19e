"""Distributed row ids, running totals and row numbers.

A row id is a long: the high bits name a slice of the input (a scan partition, a file block or a
range of a global sort), the low 33 bits the position inside the slice. Row ids grow in row order.
Running values are computed per (key, slice), so no key, however large, is handled by one task; a
small table with one row per (key, slice) carries the totals of the slices before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..columns import ROW_ID, SOURCE_FILE, col
from ..runtime import materialize, pin_splits

SLICE_BITS = 33
# Rows of a typed file that share a slice, and places that share a word of a rank table, as powers of two.
CHUNK_BITS = 20
WORD_BITS = 6
_PLAIN = ("Project", "Filter", "SubqueryAlias", "View", "LogicalRelation")


def slice_of(row_id: str = ROW_ID) -> Column:
    return F.shiftright(F.col(row_id), SLICE_BITS)


def with_row_id(df: DataFrame, order_by: Sequence[Column | str] = (), name: str = ROW_ID) -> DataFrame:
    """Add row ids in scan order, or in the order of ``order_by``.

    The scan order of typed files is that of their paths and of the rows in them, whatever tasks read them;
    several files cost a pass over their row indexes. Other scans are numbered by task; they may have
    filters and projections on them, which give the same ids whenever they run. An explicit order is one
    global sort, stored so that every later branch sees the same ids.
    """
    if not order_by:
        if name in df.columns:
            return df
        if _has_row_index(df):
            return _by_row_index(df, name)
        pin_splits(df.sparkSession)
        return df.withColumn(name, F.monotonically_increasing_id())
    return materialize(df.orderBy(*order_by).withColumn(name, F.monotonically_increasing_id()), "ordered")


def _has_row_index(df: DataFrame) -> bool:
    """Whether the rows are those of one scan of files that know the place of a row, each once."""
    if "_metadata" in df.columns:
        return False
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in _PLAIN and plan.children().size() == 1:
        plan = plan.children().apply(0)
    if plan.nodeName() not in _PLAIN or plan.children().size():
        return False
    try:
        df.select("_metadata.file_path", "_metadata.row_index")
    except AnalysisException:
        return False
    return True


def _by_row_index(df: DataFrame, name: str) -> DataFrame:
    """Ids from the place of a file among the paths and the place of a row in its file."""
    index = F.col("_metadata.row_index")
    chunk, place = F.shiftright(index, CHUNK_BITS), index.bitwiseAND(F.lit((1 << CHUNK_BITS) - 1))
    if len(df.inputFiles()) <= 1:
        return df.withColumn(name, F.shiftleft(chunk, SLICE_BITS).bitwiseOR(place))
    path = F.col("_metadata.file_path")
    files = df.select(path.alias("_path"), chunk.alias("_chunk")).groupBy("_path").agg(F.max("_chunk").alias("_last"))
    # One row per file.
    earlier = Window.orderBy("_path").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("_path", F.coalesce(F.sum(F.col("_last") + 1).over(earlier), F.lit(0)).alias("_first"))
    files = materialize(files, "files")
    placed = df.select("*", path.alias("_path"), chunk.alias("_chunk"), place.alias("_row"))
    row_id = F.shiftleft(F.col("_first") + F.col("_chunk"), SLICE_BITS).bitwiseOR(F.col("_row"))
    return placed.join(files, "_path").select(*map(col, df.columns), row_id.alias(name))


def ranks(df: DataFrame, flag: Column, out: str = "row_pos") -> DataFrame:
    """0-based positions of the flagged rows among all rows of their source: ``source_file`` (if there), ``row_id``, ``out``.

    Row ids may have gaps. The rows of 64 neighbouring ids become one word with a bit for each row that is there
    and one with a bit for each flagged row, before anything is shuffled. A position is the number of bits in
    earlier slices, in earlier words of the slice, and below the row's own bit.
    """
    by = [c for c in (SOURCE_FILE,) if c in df.columns]
    place = col(ROW_ID).bitwiseAND(F.lit((1 << SLICE_BITS) - 1))
    marked = df.select(*map(col, by), slice_of().alias("_slice"), place.alias("_at"), flag.alias("_flag"))
    marked = marked.withColumns({"_word": F.shiftright("_at", WORD_BITS), "_bit": F.expr(f"shiftleft(1L, cast(_at & {(1 << WORD_BITS) - 1} AS int))")})
    words = marked.groupBy(*by, "_slice", "_word").agg(
        F.bit_or("_bit").alias("_rows"), F.bit_or(F.when(F.col("_flag"), F.col("_bit"))).alias("_hits")
    )
    words = materialize(words.withColumn("_n", F.bit_count("_rows").cast("long")), "words")
    before = Window.unboundedPreceding, -1
    slices = words.groupBy(*by, "_slice").agg(F.sum("_n").alias("_m"))
    # A few numbers per slice of the input.
    earlier = Window.partitionBy(*by).orderBy("_slice").rowsBetween(*before)
    slices = slices.withColumn("_before", F.coalesce(F.sum("_m").over(earlier), F.lit(0))).drop("_m")
    within = Window.partitionBy(*by, "_slice").orderBy("_word").rowsBetween(*before)
    words = words.withColumn("_in", F.coalesce(F.sum("_n").over(within), F.lit(0))).filter("_hits <> 0")
    found = words.join(slices, [*by, "_slice"]).withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit((1 << WORD_BITS) - 1))))
    found = found.filter("(shiftrightunsigned(_hits, _b) & 1L) = 1L")
    below = F.expr("bit_count(_rows & ~shiftleft(-1L, _b))").cast("long")
    at = F.shiftleft("_word", WORD_BITS).bitwiseOR(F.col("_b").cast("long"))
    return found.select(
        *map(col, by),
        F.shiftleft("_slice", SLICE_BITS).bitwiseOR(at).alias(ROW_ID),
        (F.col("_before") + F.col("_in") + below).alias(out),
    )


def running(
    df: DataFrame,
    value: Column,
    out: str,
    keys: Sequence[str] = (),
    row_id: str = ROW_ID,
    how: str = "sum",
) -> DataFrame:
    """Running sum or maximum of ``value`` in row-id order, overall or per key, this row included."""
    aggregate = {"sum": F.sum, "max": F.max}[how]
    by = [col(k) for k in keys]
    unbounded = Window.unboundedPreceding

    sliced = df.withColumn("_slice", slice_of(row_id)).withColumn("_value", value)
    totals = sliced.groupBy(*by, "_slice").agg(aggregate("_value").alias("_total"))
    earlier = Window.partitionBy(*by).orderBy("_slice").rowsBetween(unbounded, -1)
    before = (
        totals.withColumn("_before", aggregate("_total").over(earlier))
        .filter(F.col("_before").isNotNull())
        .select(*[col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_slice").alias("_s"), "_before")
    )

    window = Window.partitionBy(*by, "_slice").orderBy(row_id).rowsBetween(unbounded, Window.currentRow)
    local = sliced.withColumn("_local", aggregate("_value").over(window))
    match = F.col("_slice") == F.col("_s")
    nullable = {f.name: f.nullable for f in df.schema.fields}
    for i, k in enumerate(keys):
        other = F.col(f"_k{i}")
        match = match & (col(k).eqNullSafe(other) if nullable[k] else col(k) == other)
    if not keys:
        # One row per slice, so at most one per partition of the input.
        before = F.broadcast(before)
    joined = local.join(before, match, "left")
    if how == "sum":
        total = F.col("_local") + F.coalesce(F.col("_before"), F.lit(0))
    else:
        total = F.greatest("_local", "_before")
    return joined.select(*[col(c) for c in df.columns if c != out], total.alias(out))


def number_rows(df: DataFrame, out: str = "row_no", keys: Sequence[str] = (), row_id: str = ROW_ID) -> DataFrame:
    """1-based row number in row-id order, overall or per key."""
    return running(df, F.lit(1).cast("long"), out, keys, row_id)


def position_rows(df: DataFrame, order_by: Sequence[Column | str] = (), out: str = "row_pos") -> DataFrame:
    """0-based position of every row. Ids given by a sort have no gaps, so no window is needed for them."""
    if not order_by:
        numbered = number_rows(with_row_id(df, (), "_place"), out, (), "_place")
        return numbered.withColumn(out, F.col(out) - 1).drop("_place")
    numbered = with_row_id(df, order_by, "_place")
    counts = numbered.groupBy(slice_of("_place").alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition of the sorted input: the window and the broadcast stay that small.
    before = counts.select("_s", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    offset = F.col("_place").bitwiseAND(F.lit((1 << SLICE_BITS) - 1))
    return (
        numbered.join(F.broadcast(before), slice_of("_place") == F.col("_s"))
        .withColumn(out, F.col("_before") + offset)
        .drop("_place", "_s", "_before")
    )
