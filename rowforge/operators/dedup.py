"""Duplicate removal on output rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..columns import ROW_ID, col


def drop_duplicate_rows(df: DataFrame, columns: Sequence[str], scope: Sequence[str] = ()) -> DataFrame:
    """One row per distinct ``columns`` within ``scope``.

    Equal output rows differ only in their row id, so the smallest id stands for the first of them.
    Both forms are hash aggregates with map-side combine: copies collapse before the shuffle, which
    also disarms a value that holds a large share of the rows.
    """
    keys = [col(c) for c in (*scope, *columns)]
    if ROW_ID in df.columns:
        return df.groupBy(*keys).agg(F.min(ROW_ID).alias(ROW_ID))
    return df.select(*keys).distinct()


def count_duplicates(df: DataFrame, columns: Sequence[str], scope: Sequence[str] = ()) -> DataFrame:
    """One row: rows in, rows left after duplicate removal, rows removed."""
    per_row = df.groupBy(*[col(c) for c in (*scope, *columns)]).agg(F.count(F.lit(1)).alias("n"))
    return per_row.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows_in"),
        F.count(F.lit(1)).alias("rows_kept"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates_removed"),
    )
