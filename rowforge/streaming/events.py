"""Duplicate removal and windowed pivot counts on streams of rows with an event time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..columns import col

OTHERS = "others"


def drop_stream_duplicates(stream: DataFrame, keys: Sequence[str], time: str, delay: str) -> DataFrame:
    """The first row of each key; rows of the same key within ``delay`` of it in event time are dropped.

    State is held per key and leaves with the watermark, ``delay`` behind the latest event time, so it is
    bounded by the keys of that time. Rows later than the watermark are dropped, whatever their key.
    """
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def window_pivot(
    stream: DataFrame, time: str, width: str, delay: str, column: str, values: Sequence[str], slide: str | None = None
) -> DataFrame:
    """Rows per window of event time, one column for each of ``values`` and ``others`` for the rest, nulls included.

    In append mode a window comes out once, when the watermark has passed its end. The state is one row of
    counts for each open window; partial counts are made before the shuffle, so no window is one task's burden.
    """
    value = col(column)
    counts = [F.count_if(value == v).alias(v) for v in values]
    rest = F.count_if(~F.coalesce(value.isin(list(values)), F.lit(False))).alias(OTHERS)
    windows = stream.withWatermark(time, delay).groupBy(F.window(col(time), width, slide))
    return windows.agg(*counts, rest).select("window.start", "window.end", *map(col, [*values, OTHERS]))
