"""CSV and parquet outputs, one folder per output file name."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..columns import ENGINE_COLUMNS, ROW_ID, col, label
from ..functions import as_text

FILE_NAME = "file_name"
BOM = "\ufeff"


def csv_options(width: int, crlf: bool = False) -> dict[str, str]:
    """Semicolons, minimal quoting, cells exactly as they are.

    A row of one empty cell is written as a quoted one, or it would read back as a blank line.
    """
    empty = '""' if width == 1 else ""
    return {
        "sep": ";",
        "header": "true",
        "quote": '"',
        "escape": '"',
        "emptyValue": empty,
        "nullValue": empty,
        "ignoreLeadingWhiteSpace": "false",
        "ignoreTrailingWhiteSpace": "false",
        "lineSep": "\r\n" if crlf else "\n",
    }


def output_names(df: DataFrame) -> dict[str, str]:
    """Header text per data column. A repeated text keeps its physical name, as names must differ."""
    fields = [f for f in df.schema.fields if f.name not in (*ENGINE_COLUMNS, FILE_NAME)]
    seen = Counter([FILE_NAME, *(label(f).lower() for f in fields)])
    return {f.name: label(f) if seen[label(f).lower()] == 1 else f.name for f in fields}


def _in_order(df: DataFrame, observed: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Rows of a file side by side and in input order; ``observed`` is put to the rows of the stage that writes.

    The ranges run over file name and row id, so a file of any size is spread over many tasks and
    small files share one. Part files of an output carry its rows in order.
    """
    keys = [c for c in (FILE_NAME, ROW_ID) if c in df.columns]
    placed = df.repartitionByRange(*keys) if keys else df
    placed = observed(placed) if observed else placed
    return placed.sortWithinPartitions(*keys) if keys else placed


def write_csv(
    df: DataFrame,
    path: str,
    crlf: bool = False,
    mode: str = "errorifexists",
    observed: Callable[[DataFrame], DataFrame] | None = None,
) -> None:
    """Write a table as CSV with a byte order mark, below ``file_name=...`` folders if it names files."""
    names = output_names(df)
    # Cells are the text that filters, routes and workbooks use, whatever their type.
    cells = [as_text(col(c), df.schema[c].dataType) for c in names]
    titles = [BOM + text if i == 0 else text for i, text in enumerate(names.values())]
    out = _in_order(df, observed).select(
        *[c for c in (FILE_NAME,) if c in df.columns], *[c.alias(t) for c, t in zip(cells, titles, strict=True)]
    )
    writer = out.write.mode(mode).options(**csv_options(len(names), crlf))
    if FILE_NAME in df.columns:
        writer = writer.partitionBy(FILE_NAME)
    writer.csv(path)


def write_csv_headers(files: DataFrame, like: DataFrame, path: str, crlf: bool = False) -> None:
    """Outputs of header alone for ``files`` (``file_name``), with the columns of ``like``."""
    names = list(output_names(like).values())
    titles = [F.lit(BOM + text if i == 0 else text).alias(f"_c{i}") for i, text in enumerate(names)]
    options = csv_options(len(names), crlf) | {"header": "false"}
    files.select(FILE_NAME, *titles).write.mode("append").options(**options).partitionBy(FILE_NAME).csv(path)


def write_parquet(
    df: DataFrame,
    path: str,
    mode: str = "errorifexists",
    observed: Callable[[DataFrame], DataFrame] | None = None,
) -> None:
    """The same outputs as parquet, for further processing at scale."""
    names = [col(c).alias(text) for c, text in output_names(df).items()]
    out = _in_order(df, observed).select(*[c for c in (FILE_NAME,) if c in df.columns], *names)
    writer = out.write.mode(mode)
    if FILE_NAME in df.columns:
        writer = writer.partitionBy(FILE_NAME)
    writer.parquet(path)
