"""Pivot tables in long and wide form."""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..columns import ROW_ID, SOURCE_FILE, col, find, require
from ..functions import as_text, to_number
from ..labels import PIVOT_COLUMN_HEADER, PIVOT_METRIC_HEADER, PIVOT_VALUE_HEADER
from ..plans.spec import PivotSpec, aggregation
from ..runtime import materialize
from .filters import drop_blank_rows, filter_in

KEY_SEPARATOR = " / "
MAX_PIVOT_COLUMNS = 10_000


def metric_name(field: str, agg: str) -> str:
    return f"{field}_{agg}"


def _aggregate(agg: str, x: Column) -> Column:
    """NaN never wins a maximum or minimum; every row counts, whatever its cell holds."""
    rows = F.count(F.lit(1))
    number = F.when(~F.isnan(x), x)
    return {
        "sum": F.sum(x),
        "avg": F.sum(x) / rows,
        "count": rows.cast("double"),
        "max": F.coalesce(F.max(number), F.lit(float("-inf"))),
        "min": F.coalesce(F.min(number), F.lit(float("inf"))),
    }[agg]


def pivot_groups(
    df: DataFrame,
    spec: PivotSpec,
    filter_column: str = "",
    filter_values: Iterable[str] | DataFrame = (),
    by: Sequence[str] = (),
    skip_blank_rows: bool | None = None,
) -> DataFrame:
    """One row per (row key, column key): ``by``, ``_r0..``, ``_c0..`` and one double ``_m0..`` per metric.

    Order of steps: blank-row skip, filter (rows too short for the filter column pass), duplicate
    removal on the fields in use, then one hash aggregate. A row lacking a key cell belongs to no
    group. The blank-row skip reads every column, so by default only text tables, which are
    recognised by their row id, go through it.
    """
    if skip_blank_rows is None:
        skip_blank_rows = ROW_ID in df.columns
    if skip_blank_rows:
        df = drop_blank_rows(df)
    df = filter_in(df, filter_column, filter_values, short_rows="keep")

    row_fields = [require(df, name) for name in spec.rows]
    column_fields = [require(df, name) for name in spec.columns]
    value_fields = {name: find(df, name) for name, _ in spec.metrics}
    for name, field in value_fields.items():
        if field is None:
            warnings.warn(f"pivot value column not found, metric is 0: {name!r}", stacklevel=2)

    if spec.remove_duplicates:
        used = [*row_fields, *column_fields, *(f for f in value_fields.values() if f is not None)]
        keys = list(dict.fromkeys([*by, *(f.name for f in used)]))
        df = df.select(*map(col, keys)).distinct()

    def key_columns(fields: list[T.StructField], prefix: str) -> list[Column]:
        if not fields:
            return [F.lit(spec.total_label).alias(f"{prefix}0")]
        return [as_text(col(f.name), f.dataType).alias(f"{prefix}{i}") for i, f in enumerate(fields)]

    for field in {f.name: f for f in (*row_fields, *column_fields)}.values():
        df = df.filter(col(field.name).isNotNull())

    # Each cell is turned into a number once, below the aggregate, however many metrics use it.
    metrics = [(value_fields[name], aggregation(agg)) for name, agg in spec.metrics]
    numeric = {f.name: f for f, agg in metrics if f is not None and agg != "count"}
    numbers = {name: f"_x{i}" for i, name in enumerate(numeric)}
    aggregates = []
    for i, (field, agg) in enumerate(metrics):
        if field is None:
            value = F.max(F.lit(0.0))
        else:
            value = _aggregate(agg, F.col(numbers[field.name]) if agg != "count" else F.lit(0.0))
        aggregates.append(value.alias(f"_m{i}"))
    keys = [*key_columns(row_fields, "_r"), *key_columns(column_fields, "_c")]
    names = [*by, *(f"_r{i}" for i in range(max(1, len(row_fields)))), *_column_keys(spec)]
    values = [to_number(col(f.name), f.dataType).alias(numbers[f.name]) for f in numeric.values()]
    return df.select(*map(col, by), *keys, *values).groupBy(*map(col, names)).agg(*aggregates)


def _row_names(spec: PivotSpec) -> list[str]:
    return list(spec.rows) or [spec.total_label]


def _column_keys(spec: PivotSpec) -> list[str]:
    return [f"_c{i}" for i in range(max(1, len(spec.columns)))]


def pivot_long(
    df: DataFrame,
    spec: PivotSpec,
    filter_column: str = "",
    filter_values: Iterable[str] | DataFrame = (),
    by: Sequence[str] = (),
    skip_blank_rows: bool | None = None,
) -> DataFrame:
    """Row fields, ``col_key``, ``metric``, ``value``."""
    groups = pivot_groups(df, spec, filter_column, filter_values, by, skip_blank_rows)
    cells = F.explode(
        F.array(
            *[
                F.struct(F.lit(metric_name(f, a)).alias("metric"), F.col(f"_m{i}").alias("value"))
                for i, (f, a) in enumerate(spec.metrics)
            ]
        )
    )
    rows = [F.col(f"_r{i}").alias(name) for i, name in enumerate(_row_names(spec))]
    key = F.concat_ws(KEY_SEPARATOR, *_column_keys(spec)).alias("col_key")
    return groups.select(*map(col, by), *rows, key, cells.alias("_cell")).select(
        *map(col, by), *[col(n) for n in _row_names(spec)], "col_key", "_cell.metric", "_cell.value"
    )


def wide_name(column_key: Sequence[str], field: str, agg: str) -> str:
    return f"{KEY_SEPARATOR.join(column_key)} - {field} ({agg})"


def pivot_wide(
    df: DataFrame,
    spec: PivotSpec,
    filter_column: str = "",
    filter_values: Iterable[str] | DataFrame = (),
    column_keys: Sequence[Sequence[str]] | None = None,
    max_columns: int = MAX_PIVOT_COLUMNS,
    skip_blank_rows: bool | None = None,
    unlisted: str = "raise",
) -> DataFrame:
    """One row per row key, one column per (column key, metric), missing cells 0.

    A column key that given ``column_keys`` leave out fails the job; ``unlisted="drop"`` leaves its cells out.

    Without given ``column_keys`` the aggregated groups are stored once: the keys are read from them
    (refused beyond ``max_columns``) and the wide table is built from them, so the input is scanned
    a single time.
    """
    if unlisted not in ("raise", "drop"):
        raise ValueError("unlisted is 'raise' or 'drop'")
    groups = pivot_groups(df, spec, filter_column, filter_values, skip_blank_rows=skip_blank_rows)
    names, given = _column_keys(spec), column_keys is not None
    if column_keys is None:
        groups = materialize(groups, "pivot")
        found = groups.select(*names).distinct().limit(max_columns + 1).collect()
        if len(found) > max_columns:
            raise ValueError(f"pivot has more than {max_columns} column keys; use the long form")
        column_keys = sorted(tuple(row) for row in found)
    else:
        column_keys = sorted(tuple(key) for key in column_keys)

    metrics = spec.metrics
    rows = [f"_r{i}" for i in range(len(_row_names(spec)))]
    # Distinct keys may read the same once joined, so cells are matched on the key as a tuple.
    keyed = groups.withColumn("_key", F.concat(*[F.concat(F.length(n), F.lit(":"), F.col(n)) for n in names]))
    encoded = ["".join(f"{len(part)}:{part}" for part in key) for key in column_keys]
    if given and unlisted == "raise":
        known = F.col("_key").isin(*encoded) if encoded else F.lit(False)
        unknown = F.raise_error(F.concat(F.lit("column key not listed: "), F.concat_ws(KEY_SEPARATOR, *names)))
        keyed = keyed.withColumn("_key", F.when(known, F.col("_key")).otherwise(unknown.cast("string")))
        groups = keyed if encoded else keyed.filter("_key is not null")
    if not encoded:
        return groups.select(*rows).distinct().toDF(*_row_names(spec))
    wide = (
        keyed.groupBy(*rows)
        .pivot("_key", encoded)
        .agg(*[F.first(f"_m{i}").alias(f"_m{i}") for i in range(len(metrics))])
    )
    labels = [wide_name(key, f, a) for key in column_keys for f, a in metrics]
    wide = wide.toDF(*_row_names(spec), *[f"_w{i}" for i in range(len(labels))])
    return wide.select(
        *[col(name) for name in _row_names(spec)],
        *[F.coalesce(F.col(f"_w{i}"), F.lit(0.0)).alias(text) for i, text in enumerate(labels)],
    )


def pivot_preview(
    df: DataFrame,
    spec: PivotSpec,
    n: int = 100,
    filter_column: str = "",
    filter_values: Iterable[str] | DataFrame = (),
    **options,
) -> DataFrame:
    """The first ``n`` rows of the wide form in order of their row keys; options as for ``pivot_wide``."""
    wide = pivot_wide(df, spec, filter_column, filter_values, **options)
    return wide.orderBy(*map(col, wide.columns[: len(_row_names(spec))])).limit(n)


def pivot_grid(
    df: DataFrame,
    spec: PivotSpec,
    filter_column: str = "",
    filter_values: Iterable[str] | DataFrame = (),
    by: Sequence[str] = (SOURCE_FILE,),
    max_columns: int = MAX_PIVOT_COLUMNS,
) -> tuple[DataFrame, DataFrame]:
    """The wide form as arrays, so that every ``by`` group has its own columns.

    Returns (headers, rows): ``by, header array<string>`` and ``by, row_key array<string>,
    cells array<double>``. A group with more than ``max_columns`` column keys comes in the long form, with
    a warning: column key and metric end its row keys, and each row has one cell.
    """
    groups = materialize(pivot_groups(df, spec, filter_column, filter_values, by), "pivot")
    names, metrics = _column_keys(spec), spec.metrics
    by_cols = [col(b) for b in by]
    row_key = F.array(*[f"_r{i}" for i in range(len(_row_names(spec)))])
    column_key = F.array(*names)

    distinct = groups.select(*by_cols, column_key.alias("_key")).distinct()
    counted = distinct.groupBy(*by_cols).agg(F.count(F.lit(1)).alias("_n"))
    broad = materialize(counted.filter(F.col("_n") > max_columns).select(*by_cols), "pivot-broad")
    some_broad = not broad.isEmpty()
    every, on = groups, list(by)
    if some_broad:
        warnings.warn(f"pivots with more than {max_columns} column keys are written in the long form", stacklevel=2)
        groups = groups.join(broad, on, "left_anti")
        distinct = distinct.join(broad, on, "left_anti")
    keys = distinct.groupBy(*by_cols).agg(F.sort_array(F.collect_list("_key")).alias("_keys"))

    text = F.transform(
        "_keys",
        lambda k: F.array(
            *[F.concat(F.array_join(k, KEY_SEPARATOR), F.lit(f" - {f} ({a})")) for f, a in metrics]
        ),
    )
    row_headers = F.array(*[F.lit(name) for name in _row_names(spec)])
    headers = keys.select(*by_cols, F.concat(row_headers, F.flatten(text)).alias("header"))

    cell = F.struct(column_key.alias("k"), F.array(*[f"_m{i}" for i in range(len(metrics))]).alias("v"))
    rows = groups.groupBy(*by_cols, row_key.alias("row_key")).agg(F.map_from_entries(F.collect_list(cell)).alias("_m"))
    rows = rows.join(keys, on)
    zero = F.array(*[F.lit(0.0)] * len(metrics))
    cells = F.flatten(F.transform("_keys", lambda k: F.coalesce(F.try_element_at("_m", k), zero)))
    rows = rows.select(*by_cols, "row_key", cells.alias("cells"))
    if not some_broad:
        return headers, rows
    long = every.join(broad, on, "left_semi")
    key = F.array_join(column_key, KEY_SEPARATOR)
    each = [
        F.struct(F.concat(row_key, F.array(key, F.lit(metric_name(f, a)))).alias("row_key"), F.array(f"_m{i}").alias("cells"))
        for i, (f, a) in enumerate(metrics)
    ]
    long = long.select(*by_cols, F.explode(F.array(*each)).alias("_row")).select(*by_cols, "_row.row_key", "_row.cells")
    titles = [*_row_names(spec), PIVOT_COLUMN_HEADER, PIVOT_METRIC_HEADER, PIVOT_VALUE_HEADER]
    long_headers = broad.select(*by_cols, F.array(*[F.lit(t) for t in titles]).alias("header"))
    return headers.unionByName(long_headers), rows.unionByName(long)
