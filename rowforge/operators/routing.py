"""Routing of rows to destinations by column value."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..columns import col, require
from ..functions import as_text, is_blank
from ..labels import OTHERS_LABEL
from .filters import LITERAL_VALUES, value_table


def route(
    df: DataFrame,
    column: str,
    selected: Iterable[str] | DataFrame = (),
    out: str = "dest_file",
    others_label: str = OTHERS_LABEL,
    drop: bool = True,
) -> DataFrame:
    """Add the destination of each row; rows with a blank or absent value have none and are dropped.

    With ``drop=False`` they stay, with a NULL destination. ``selected`` may be a one-column
    DataFrame for sets too big for the driver.

    With a chosen set, values outside it share the others label. A data value equal to that label
    falls into the same destination. Values are not trimmed.
    """
    field = require(df, column)
    cell = as_text(col(field.name), field.dataType)
    filled = ~is_blank(col(field.name), field.dataType)
    if drop:
        df = df.filter(filled)
    table = None
    if isinstance(selected, DataFrame):
        chosen = []
        table = None if selected.isEmpty() else selected.toDF("_chosen").distinct()
    else:
        chosen = list(dict.fromkeys(selected or ()))
        if len(chosen) > LITERAL_VALUES:
            table = value_table(df.sparkSession, chosen, "_chosen")
    value = cell
    if table is not None:
        df = df.join(table, cell == F.col("_chosen"), "left")
        value = F.coalesce(F.col("_chosen"), F.lit(others_label))
    elif chosen:
        value = F.when(cell.isin(*chosen), cell).otherwise(F.lit(others_label))
    return df.withColumn(out, value if drop else F.when(filled, value)).drop("_chosen")
