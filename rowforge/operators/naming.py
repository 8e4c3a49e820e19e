"""Sheet and file names: cleanup and case-insensitive uniqueness.

Names are worked out over the distinct destinations, one row per output, never over the data rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..columns import ROW_ID, col
from ..functions import strip
from ..functions.text import WHITESPACE
from ..runtime import materialize
from .numbering import running

# Length limits, refused characters and fallback names of outputs.
SHEET_LIMIT = 29
SHEET_REFUSED = ":\\/?*[]"
SHEET_FALLBACK = "Sheet"
FILE_LIMIT = 80
FILE_REFUSED = '<>:"/\\|?*'
FILE_FALLBACK = "Unknown"
FILE_CUT_FALLBACK = "File"
FILE_TAIL = ". "


def clean_sheet_name(c: Column) -> Column:
    """A value as a sheet name, not yet unique."""
    name = strip(F.btrim(strip(c), F.lit("'")))
    name = F.translate(name, SHEET_REFUSED, "_" * len(SHEET_REFUSED))
    name = F.substring(strip(name), 1, SHEET_LIMIT)
    return F.when(name == "", SHEET_FALLBACK).otherwise(name)


def clean_file_stem(c: Column) -> Column:
    """A value as a file name part, not yet unique."""
    refused = FILE_REFUSED + "".join(map(chr, range(32)))
    name = F.translate(c, refused, "_" * len(refused))
    spaces = "".join(ch for ch in WHITESPACE if ch > " ")
    name = F.regexp_replace(F.translate(name, spaces, " " * len(spaces)), " +", " ")
    name = F.rtrim(F.btrim(name, F.lit(" ")), F.lit(FILE_TAIL))
    name = F.rtrim(F.substring(name, 1, FILE_LIMIT), F.lit(FILE_TAIL))
    return F.when(name == "", FILE_FALLBACK).otherwise(name)


def _cut_sheet(c: Column, length: Column) -> Column:
    return c.substr(F.lit(1), length)


def _cut_file(c: Column, length: Column) -> Column:
    return F.rtrim(c.substr(F.lit(1), length), F.lit(FILE_TAIL))


def unique_sheet_names(df: DataFrame, base: str, out: str, scope: Sequence[str] = ()) -> DataFrame:
    """Sheet names made unique in row-id order within ``scope`` (one workbook)."""
    return _unique(df, base, out, scope, SHEET_LIMIT, _cut_sheet, "")


def unique_file_stems(df: DataFrame, base: str, out: str, scope: Sequence[str] = ()) -> DataFrame:
    """File stems made unique in row-id order within ``scope`` (one source file)."""
    return _unique(df, base, out, scope, FILE_LIMIT, _cut_file, FILE_CUT_FALLBACK)


def _unique(
    df: DataFrame,
    base: str,
    out: str,
    scope: Sequence[str],
    limit: int,
    cut: Callable[[Column, Column], Column],
    cut_fallback: str,
) -> DataFrame:
    """Give each name, in row-id order, the first free one of ``base, base_1, base_2, ...``.

    The suffix is fitted into the limit. ``_pos`` is a lower bound for the index of the name a row
    will get. Rows that share the rest of their candidate list must get strictly growing indexes, so
    each pass spreads them with a running maximum, over the numbers that no row before all of them
    holds; then a row that still meets an earlier row at the same name moves on, past the whole run of
    numbers that earlier rows hold. A name an earlier row holds stays with an earlier row in later
    passes, so no free name is passed over. Without values that look like another value's suffixed name
    the first pass is the answer; such values before the rows they stand in the way of, however many,
    take no more. Only chains, of values among the rows they stand in the way of, take further passes.
    """
    name = col(base)
    pos = F.col("_pos")

    def cut_for(digits: Column | int) -> Column:
        part = cut(name, F.lit(limit - 1) - digits)
        return F.when(part == "", F.lit(cut_fallback)).otherwise(part) if cut_fallback else part

    by = [col(s) for s in scope]
    numbered = r"^(.*)_([1-9][0-9]{0,17})$"
    # Values that read like a numbered name. An earlier row holds that name whatever becomes of this one.
    alike = df.select(
        *by,
        F.regexp_extract(F.lower(name), numbered, 1).alias("_list"),
        F.regexp_extract(F.lower(name), numbered, 2).try_cast("long").alias("_pos"),
        F.col(ROW_ID).alias("_holder"),
    ).filter(F.col("_pos").isNotNull())
    alike = alike.groupBy(*by, "_list", "_pos").agg(F.min("_holder").alias("_holder"))

    def counted(state: DataFrame, keys: list[str], digits: int, gaps: bool) -> DataFrame:
        """``_pos`` of the members counted over the free numbers of their list alone; back again if not ``gaps``.

        Not free are the numbers held by rows before all members.
        """
        own = [col(k) for k in keys]
        first = F.min(F.when(F.col("_member"), F.col(ROW_ID))).over(Window.partitionBy(*own))
        taken = alike.filter(F.length(F.col("_pos").cast("string")) == digits)
        rows = state.withColumn("_held", F.lit(0)).unionByName(taken.withColumn("_held", F.lit(1)), allowMissingColumns=True)
        rows = rows.withColumn("_first", first).filter("_held = 0 OR _holder < _first")
        in_order = Window.partitionBy(*own)
        if gaps:
            below = F.sum("_held").over(in_order.orderBy("_pos", "_held").rowsBetween(Window.unboundedPreceding, 0))
            moved = pos - below
        else:
            # A held number lies below a free one if no more free numbers lie below it.
            rank = F.sum("_held").over(in_order.orderBy("_held", "_pos").rowsBetween(Window.unboundedPreceding, 0))
            rows = rows.withColumn("_free", F.when(F.col("_held") == 1, pos - rank + 1).otherwise(pos))
            last = in_order.orderBy("_free", F.col("_held").desc()).rowsBetween(Window.unboundedPreceding, 0)
            moved = pos + F.sum("_held").over(last)
        rows = rows.withColumn("_moved", moved).filter("_held = 0")
        return rows.withColumn("_pos", F.when(F.col("_member"), F.col("_moved")).otherwise(pos)).select(*map(col, state.columns))

    def spread(state: DataFrame) -> tuple[DataFrame, int]:
        """Apply the growing-index rule per candidate list; return the highest index too."""
        digits, top = 0, None
        while top is None or (digits and top >= 10 ** (digits - 1)):
            low = 10 ** (digits - 1) if digits else 0
            group = F.lower(cut_for(digits) if digits else name)
            keys = [*scope, "_list"]
            state = state.withColumns({"_list": group, "_member": pos >= low})
            member = F.col("_member")
            gaps = bool(digits) and some_alike
            if gaps:
                state = counted(state, keys, digits, True)
            state = running(state, F.when(member, 1).otherwise(0).cast("long"), "_rank", keys)
            ahead = F.when(member, pos - F.col("_rank"))
            state = running(state, ahead, "_shift", keys, how="max")
            state = state.withColumn("_pos", F.when(member, F.col("_rank") + F.col("_shift")).otherwise(pos))
            state = state.drop("_rank", "_shift")
            if gaps:
                state = counted(state, keys, digits, False)
            state = materialize(state.drop("_list", "_member"), "names")
            top = state.agg(F.coalesce(F.max("_pos"), F.lit(0)).alias("top")).first()["top"]
            digits += 1
        return state, top

    suffix = F.concat(F.lit("_"), pos.cast("string"))
    candidate = F.when(pos == 0, name).otherwise(F.concat(cut_for(F.length(suffix) - 1), suffix))
    at_name = Window.partitionBy(*[col(s) for s in scope], F.lower(candidate)).orderBy(ROW_ID)

    def moved_on(checked: DataFrame) -> DataFrame:
        """Late rows at their next number that no run of earlier rows holds."""
        at = F.regexp_extract(F.lower(candidate), numbered, 2).try_cast("long")
        stem = F.regexp_extract(F.lower(candidate), numbered, 1)
        held = checked.filter(~F.col("_late")).select(*by, stem.alias("_stem"), at.alias("_at"), F.col(ROW_ID).alias("_holder"))
        held = held.filter(F.col("_at").isNotNull())
        in_order = Window.partitionBy(*by, "_stem").orderBy("_at")
        held = held.withColumn("_run", F.col("_at") - F.row_number().over(in_order))
        run = Window.partitionBy(*by, "_stem", "_run")
        held = held.select(
            *[col(s).alias(f"_k{i}") for i, s in enumerate(scope)],
            "_stem",
            "_at",
            F.max("_at").over(run).alias("_end"),
            F.max("_holder").over(run).alias("_last"),
        )
        late = checked.withColumn("_pos", pos + F.col("_late").cast("long"))
        next_stem = F.lower(cut_for(F.length(pos.cast("string"))))
        match = F.col("_late") & (F.col("_at") == pos) & (F.col("_stem") == next_stem)
        for i, s in enumerate(scope):
            match = match & col(s).eqNullSafe(F.col(f"_k{i}"))
        # Longer numbers may leave less room for the base; then the run counts to the last number as long as this.
        same_cut = F.lower(cut_for(F.length(F.col("_end").cast("string")))) == next_stem
        longest = F.repeat(F.lit("9"), F.length(pos.cast("string"))).cast("long")
        end = F.when(same_cut, F.col("_end")).otherwise(F.least("_end", longest))
        step = F.when(F.col("_last") < F.col(ROW_ID), end + 1).otherwise(pos)
        return late.join(held, match, "left").select(
            *[col(c) for c in df.columns], F.coalesce(step, pos).alias("_pos")
        )

    repeated = df.groupBy(*[col(s) for s in scope], F.lower(name)).count().filter("count > 1")
    if repeated.isEmpty():
        return df.withColumn(out, name)
    some_alike = not alike.isEmpty()
    state, top = spread(df.withColumn("_pos", F.lit(0).cast("long")))
    while top:
        checked = state.withColumn("_late", F.row_number().over(at_name) > 1)
        if checked.filter("_late").isEmpty():
            break
        state, top = spread(moved_on(checked))
    return state.withColumn(out, candidate).drop("_pos")
