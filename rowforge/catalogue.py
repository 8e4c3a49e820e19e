"""Registered queries over the test tables, each with the SQL that gives the same result."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import is_blank, strip
from .labels import (
    OTHERS_LABEL,
    PIVOT_COLUMN_HEADER,
    PIVOT_LABEL,
    PIVOT_METRIC_HEADER,
    PIVOT_VALUE_HEADER,
    TOTAL_LABEL,
)
from .operators import (
    clean_file_stem,
    clean_sheet_name,
    count_duplicates,
    count_rows,
    count_values,
    destinations,
    distinct_values,
    drop_blank_rows,
    export_count,
    export_metrics,
    filter_in,
    forecast,
    forecast_totals,
    manifest,
    mark_cells,
    number_rows,
    page,
    page_info,
    pivot_grid,
    pivot_long,
    pivot_preview,
    pivot_wide,
    place_rows,
    position_rows,
    rank_forecast,
    route,
    search_rows,
    search_summary,
    search_values,
    select_columns,
    shape,
    unique_file_stems,
    unique_sheet_names,
    with_row_id,
    with_source,
)
from .operators.layout import file_stem
from .plans.export import export, export_batch, run_batch
from .plans.spec import ExportSpec, PivotSpec
from .runtime import materialize, scratch_dir
from .sinks.csv import write_csv
from .sources.delimited import profile_batch, read_delimited
from .sources.tables import read_table
from .streaming.events import drop_stream_duplicates, window_pivot
from .streaming.landing import export_arrivals

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name, with its SQL if there is one."""

    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return register


def _q(*values: str) -> str:
    return ", ".join(f"'{v}'" for v in values)


LINE_ORDER = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate"]
LINE_ORDER_SQL = ", ".join(LINE_ORDER)


# ---------------------------------------------------------------- filters and projections


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def flt_in(spark: SparkSession, sf: str) -> DataFrame:
    orders = read_table(spark, sf, "orders")
    return filter_in(orders, "o_orderpriority", ["1-URGENT", "2-HIGH"]).select("o_orderkey", "o_orderpriority")


@query("SELECT o_orderkey, o_orderpriority FROM orders")
def flt_empty_set(spark: SparkSession, sf: str) -> DataFrame:
    return filter_in(read_table(spark, sf, "orders"), "o_orderpriority", []).select("o_orderkey", "o_orderpriority")


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def flt_unknown_column(spark: SparkSession, sf: str) -> DataFrame:
    return filter_in(read_table(spark, sf, "orders"), "O_ORDERSTATUS", ["F"]).select("o_orderkey", "o_orderstatus")


_PRIORITY = "NULLIF(o_orderpriority, '5-LOW')"


@query(
    f"SELECT o_orderkey, {_PRIORITY} AS priority FROM orders "
    f"WHERE {_PRIORITY} IN ('1-URGENT', '2-HIGH') OR {_PRIORITY} IS NULL"
)
def flt_keep_short(spark: SparkSession, sf: str) -> DataFrame:
    orders = _orders_with_gaps(spark, sf)
    return filter_in(orders, "priority", ["1-URGENT", "2-HIGH"], short_rows="keep")


def _orders_with_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "orders").select("o_orderkey", F.expr(_PRIORITY).alias("priority"))


@query(
    "SELECT l_orderkey, l_linenumber FROM lineitem "
    "WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')"
)
def flt_value_table(spark: SparkSession, sf: str) -> DataFrame:
    wanted = read_table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string"))
    return filter_in(read_table(spark, sf, "lineitem"), "l_orderkey", wanted).select("l_orderkey", "l_linenumber")


@query("SELECT o_orderpriority, o_orderkey, o_custkey FROM orders")
def prj_reorder(spark: SparkSession, sf: str) -> DataFrame:
    return select_columns(read_table(spark, sf, "orders"), ["o_orderpriority", "o_orderkey", "unknown", "o_custkey"])


@query(f"SELECT coalesce({_PRIORITY}, '') AS priority, o_orderkey FROM orders")
def prj_pad(spark: SparkSession, sf: str) -> DataFrame:
    return select_columns(_orders_with_gaps(spark, sf), ["priority", "o_orderkey"])


@query("SELECT o_orderkey, o_orderpriority FROM orders")
def prj_nothing_known(spark: SparkSession, sf: str) -> DataFrame:
    return select_columns(read_table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), ["a", "b"])


@query(f"SELECT {_PRIORITY} AS priority FROM orders WHERE {_PRIORITY} IS NOT NULL")
def flt_blank_rows(spark: SparkSession, sf: str) -> DataFrame:
    return drop_blank_rows(_orders_with_gaps(spark, sf).select("priority"))


_SPACES = "'\\x09-\\x0d\\x1c-\\x20\\x85\\xa0\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}'"


@query(
    f"SELECT lang, count(*) AS n_docs, CAST(sum(CASE WHEN regexp_full_match(text, '[' || {_SPACES} || ']*') "
    f"THEN 1 ELSE 0 END) AS BIGINT) AS n_blank, CAST(sum(length(regexp_replace(text, '^[' || {_SPACES} || "
    f"']+|[' || {_SPACES} || ']+$', '', 'g'))) AS BIGINT) AS n_chars FROM documents GROUP BY lang"
)
def flt_blank_test(spark: SparkSession, sf: str) -> DataFrame:
    text = F.col("text")
    return (
        read_table(spark, sf, "documents")
        .groupBy("lang")
        .agg(
            F.count(F.lit(1)).alias("n_docs"),
            F.count_if(is_blank(text)).alias("n_blank"),
            F.sum(F.length(strip(text))).alias("n_chars"),
        )
    )


# ---------------------------------------------------------------- duplicates

_DEDUP = ExportSpec(selected_columns=("l_returnflag", "l_quantity", "l_discount"))


@query("SELECT DISTINCT l_returnflag, l_quantity, l_discount FROM lineitem")
def dd_projected(spark: SparkSession, sf: str) -> DataFrame:
    return shape(read_table(spark, sf, "lineitem"), _DEDUP).drop("source_file", "dest_file", "dest_sheet")


@query("SELECT l_returnflag, l_quantity, l_discount FROM lineitem")
def dd_switched_off(spark: SparkSession, sf: str) -> DataFrame:
    spec = ExportSpec(selected_columns=_DEDUP.selected_columns, deduplicate_rows=False)
    return shape(read_table(spark, sf, "lineitem"), spec).drop("source_file", "dest_file", "dest_sheet")


@query(
    "SELECT count(*) AS rows_in, (SELECT count(*) FROM (SELECT DISTINCT l_returnflag, l_quantity FROM lineitem)) "
    "AS rows_kept, count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_returnflag, l_quantity FROM lineitem)) "
    "AS duplicates_removed FROM lineitem"
)
def dd_removed_count(spark: SparkSession, sf: str) -> DataFrame:
    return count_duplicates(read_table(spark, sf, "lineitem"), ["l_returnflag", "l_quantity"])


def _others(column: str, values: str) -> str:
    return f"CASE WHEN {column} IN ({values}) THEN {column} ELSE '{OTHERS_LABEL}' END"


@query(
    f"SELECT DISTINCT {_others('l_returnflag', _q('A'))} AS dest_file, l_linestatus AS dest_sheet, "
    "l_quantity, l_linestatus FROM lineitem"
)
def dd_per_destination(spark: SparkSession, sf: str) -> DataFrame:
    spec = ExportSpec(
        file_split_column="l_returnflag",
        file_split_values=("A",),
        sheet_split_column="l_linestatus",
        selected_columns=("l_quantity", "l_linestatus"),
    )
    return shape(read_table(spark, sf, "lineitem"), spec).drop("source_file")


# ---------------------------------------------------------------- routing


@query(f"SELECT o_orderkey, {_others('o_orderpriority', _q('1-URGENT', '5-LOW'))} AS dest_file FROM orders")
def rt_others(spark: SparkSession, sf: str) -> DataFrame:
    orders = read_table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return route(orders, "o_orderpriority", ["1-URGENT", "5-LOW"]).select("o_orderkey", "dest_file")


@query(f"SELECT o_orderkey, {_PRIORITY} AS dest_file FROM orders WHERE trim({_PRIORITY}) <> ''")
def rt_blank_dropped(spark: SparkSession, sf: str) -> DataFrame:
    return route(_orders_with_gaps(spark, sf), "priority").select("o_orderkey", "dest_file")


@query(
    f"SELECT l_orderkey, l_linenumber, {_others('l_returnflag', _q('A', 'R'))} AS dest_file, "
    f"{_others('l_linestatus', _q('F'))} AS dest_sheet FROM lineitem"
)
def rt_two_level(spark: SparkSession, sf: str) -> DataFrame:
    lineitem = read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    spec = ExportSpec(
        file_split_column="l_returnflag",
        file_split_values=("A", "R"),
        sheet_split_column="l_linestatus",
        sheet_split_values=("F",),
    )
    return shape(lineitem, spec).select("l_orderkey", "l_linenumber", "dest_file", "dest_sheet")


@query("SELECT o_orderkey, o_orderpriority AS dest_file FROM orders")
def rt_csv_sheet_split_makes_files(spark: SparkSession, sf: str) -> DataFrame:
    spec = ExportSpec(output_format="csv", sheet_split_column="o_orderpriority")
    orders = read_table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return shape(orders, spec).select("o_orderkey", "dest_file")


@query("SELECT o_orderkey, o_orderstatus AS dest_file, '' AS dest_sheet FROM orders")
def rt_missing_column(spark: SparkSession, sf: str) -> DataFrame:
    spec = ExportSpec(file_split_column="o_orderstatus", sheet_split_column="unknown", filter_column="unknown")
    orders = read_table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return shape(orders, spec).select("o_orderkey", "dest_file", "dest_sheet")


@query(
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 30) THEN "
    f"CAST(l_partkey AS VARCHAR) ELSE '{OTHERS_LABEL}' END AS dest_file FROM lineitem"
)
def rt_many_chosen(spark: SparkSession, sf: str) -> DataFrame:
    """A chosen set too long for a literal list is a table of its own."""
    parts = read_table(spark, sf, "part").filter("p_size <= 30").select(F.col("p_partkey").cast("string"))
    lineitem = read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return route(lineitem, "l_partkey", parts).select("l_orderkey", "l_linenumber", "dest_file")


# ---------------------------------------------------------------- inspection

_FORECAST = ExportSpec(
    filter_column="l_returnflag",
    filter_values=("A", "R"),
    file_split_column="l_returnflag",
    file_split_values=("A",),
    sheet_split_column="l_linenumber",
    selected_columns=("l_linestatus", "l_quantity", "l_tax"),
)
_FORECAST_SQL = (
    f"SELECT dest_file, dest_sheet, count(*) AS n_rows FROM (SELECT DISTINCT {_others('l_returnflag', _q('A'))} "
    "AS dest_file, CAST(l_linenumber AS VARCHAR) AS dest_sheet, l_linestatus, l_quantity, l_tax FROM lineitem "
    "WHERE l_returnflag IN ('A', 'R')) GROUP BY dest_file, dest_sheet"
)


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return forecast(read_table(spark, sf, "lineitem"), _FORECAST)


@query("SELECT DISTINCT c_mktsegment AS value FROM customer")
def ins_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return distinct_values(read_table(spark, sf, "customer"), "c_mktsegment")


@query("SELECT DISTINCT c_name AS value FROM customer WHERE c_mktsegment = 'BUILDING' AND trim(c_name) <> ''")
def ins_distinct_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return distinct_values(read_table(spark, sf, "customer"), "c_name", "c_mktsegment", ["BUILDING"])


@query("SELECT DISTINCT p_name AS value FROM part WHERE contains(lower(p_name), 'ing')")
def ins_distinct_search(spark: SparkSession, sf: str) -> DataFrame:
    return search_values(distinct_values(read_table(spark, sf, "part"), "p_name"), "ING")


@query(
    "SELECT count(*) FILTER (WHERE contains(lower(p_name), 'ing')) AS n_found, count(*) AS n_values "
    "FROM (SELECT DISTINCT p_name FROM part)"
)
def ins_distinct_count(spark: SparkSession, sf: str) -> DataFrame:
    return count_values(distinct_values(read_table(spark, sf, "part"), "p_name"), "Ing")


@query(f"SELECT '' AS source_file, CAST(sum(n_rows) AS BIGINT) AS n_rows FROM ({_FORECAST_SQL})")
def ins_export_count(spark: SparkSession, sf: str) -> DataFrame:
    return export_count(read_table(spark, sf, "lineitem"), _FORECAST)


@query(f"SELECT count(*) AS n_rows FROM orders WHERE {_PRIORITY} = '2-HIGH' OR {_PRIORITY} IS NULL")
def ins_count_rows(spark: SparkSession, sf: str) -> DataFrame:
    return count_rows(_orders_with_gaps(spark, sf), "priority", ["2-HIGH"])


@query(_FORECAST_SQL)
def ins_forecast(spark: SparkSession, sf: str) -> DataFrame:
    return flagship(spark, sf)


@query(
    f"WITH f AS ({_FORECAST_SQL}), t AS (SELECT *, CAST(sum(n_rows) OVER (PARTITION BY dest_file) AS BIGINT) "
    "AS file_total FROM f) SELECT dest_file, dest_sheet, n_rows, file_total, CAST(dense_rank() OVER (ORDER BY "
    "file_total DESC, dest_file) AS INTEGER) AS file_rank, CAST(row_number() OVER (PARTITION BY dest_file "
    "ORDER BY n_rows DESC, dest_sheet) AS INTEGER) AS sheet_rank FROM t"
)
def ins_forecast_ranked(spark: SparkSession, sf: str) -> DataFrame:
    return rank_forecast(flagship(spark, sf))


@query(
    f"SELECT count(DISTINCT dest_file) AS n_files, count(*) AS n_sheets, CAST(sum(n_rows) AS BIGINT) AS n_rows "
    f"FROM ({_FORECAST_SQL})"
)
def ins_forecast_totals(spark: SparkSession, sf: str) -> DataFrame:
    return forecast_totals(flagship(spark, sf))


_EVENT_COLUMNS = "event_id, user_id, event_type, value, props"


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "events").select(*_EVENT_COLUMNS.split(", "))


@query(f"SELECT {_EVENT_COLUMNS} FROM events ORDER BY event_id LIMIT 100 OFFSET 200")
def ins_page(spark: SparkSession, sf: str) -> DataFrame:
    return page(_events(spark, sf), 3, 100, ["event_id"])


@query("SELECT * FROM events ORDER BY ts, event_id LIMIT 100 OFFSET 200")
def ins_page_all_columns(spark: SparkSession, sf: str) -> DataFrame:
    return page(read_table(spark, sf, "events"), 3, 100, ["ts", "event_id"])


_DAYS = [f"{date(1995, 1, 1) + timedelta(days=i)} 00:00:00" for i in range(365)]


@query(f"SELECT * FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') IN ({_q(*_DAYS)})")
def flt_timestamps(spark: SparkSession, sf: str) -> DataFrame:
    """Timestamps by their text; the scan gets them as timestamps."""
    return filter_in(read_table(spark, sf, "orders"), "o_orderdate", _DAYS)


_NAMES = [f"Customer#{i:09d}" for i in range(0, 6000, 2)]


@query(f"SELECT * FROM customer WHERE c_name IN ({_q(*_NAMES)})")
def flt_long_list(spark: SparkSession, sf: str) -> DataFrame:
    """A list too long for a literal: a semi join behind a range that the scan knows."""
    return filter_in(read_table(spark, sf, "customer"), "c_name", _NAMES)


_LINE_KEYS = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate"


@query(f"SELECT * FROM lineitem ORDER BY {_LINE_KEYS} LIMIT 100 OFFSET 5700")
def ins_page_deep(spark: SparkSession, sf: str) -> DataFrame:
    return page(read_table(spark, sf, "lineitem"), 58, 100, _LINE_KEYS.split(", "))


@query("SELECT count(*) AS total_rows, CAST(greatest(1, ceil(count(*) / 100.0)) AS BIGINT) AS n_pages FROM events")
def ins_page_info(spark: SparkSession, sf: str) -> DataFrame:
    return page_info(read_table(spark, sf, "events"), 100)


_DOCUMENT_HIT = " OR ".join(
    f"contains(lower(CAST({c} AS VARCHAR)), 'elle')" for c in ("doc_id", "text", "lang", "source", "n_chars")
)


@query(
    "SELECT row_pos, doc_id FROM (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_pos, * FROM documents) "
    f"WHERE {_DOCUMENT_HIT}"
)
def ins_search_any(spark: SparkSession, sf: str) -> DataFrame:
    return search_rows(read_table(spark, sf, "documents"), "Elle", order_by=["doc_id"])


@query(
    "SELECT row_pos, doc_id FROM (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_pos, * FROM documents) "
    "WHERE contains(lower(text), 'elle')"
)
def ins_search_column(spark: SparkSession, sf: str) -> DataFrame:
    return search_rows(read_table(spark, sf, "documents"), "elle", "text", order_by=["doc_id"])


@query(
    "SELECT count(*) AS n_matches, CAST(min(row_pos) // 50 + 1 AS BIGINT) AS first_page FROM (SELECT row_number() "
    "OVER (ORDER BY doc_id) - 1 AS row_pos, text FROM documents) WHERE contains(lower(text), 'elle')"
)
def ins_search_first_page(spark: SparkSession, sf: str) -> DataFrame:
    return search_summary(read_table(spark, sf, "documents"), "elle", 50, "text", "doc_id")


@query(
    f"SELECT {_EVENT_COLUMNS}, concat_ws(',', CASE WHEN "
    "contains(CAST(event_id AS VARCHAR), '12') THEN 'event_id' END, CASE WHEN contains(CAST(user_id AS VARCHAR), "
    "'12') THEN 'user_id' END, CASE WHEN contains(event_type, '12') THEN 'event_type' END, CASE WHEN "
    "contains(CAST(value AS VARCHAR), '12') THEN 'value' END, CASE WHEN contains(props, '12') THEN 'props' END) "
    "AS matched_columns FROM events ORDER BY event_id LIMIT 200 OFFSET 200"
)
def ins_cell_matches(spark: SparkSession, sf: str) -> DataFrame:
    marked = mark_cells(page(_events(spark, sf), 2, 200, ["event_id"]), "12")
    return marked.withColumn("matched_columns", F.array_join("matched_columns", ","))


@query("SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS row_pos FROM events")
def ins_positions(spark: SparkSession, sf: str) -> DataFrame:
    positions = position_rows(read_table(spark, sf, "events").select("event_id"), ["event_id"])
    return positions.select("event_id", "row_pos")


# ---------------------------------------------------------------- pivot

_PIVOT = PivotSpec(
    rows=("l_returnflag",),
    columns=("l_linestatus", "l_linenumber"),
    values=(("l_quantity", "Сумма"), ("l_quantity", "avg"), ("l_tax", "Количество")),
)


def _long(row: str, key: str, source: str, metrics: dict[str, str]) -> str:
    """SQL of a long pivot: one grouped SELECT per metric."""
    grouped = f"FROM {source} GROUP BY ALL"
    return " UNION ALL ".join(
        f"SELECT {row}, {key} AS col_key, '{name}' AS metric, CAST({value} AS DOUBLE) AS value {grouped}"
        for name, value in metrics.items()
    )


@query(
    _long(
        "l_returnflag",
        "l_linestatus || ' / ' || l_linenumber",
        "lineitem",
        {
            "l_quantity_Сумма": "sum(l_quantity)",
            "l_quantity_avg": "sum(l_quantity) / count(*)",
            "l_tax_Количество": "count(*)",
        },
    )
)
def pv_long(spark: SparkSession, sf: str) -> DataFrame:
    return pivot_long(read_table(spark, sf, "lineitem"), _PIVOT)


_ALL_AGGS = {
    "l_quantity_sum": "sum(l_quantity)",
    "l_quantity_avg": "sum(l_quantity) / count(*)",
    "l_quantity_count": "count(*)",
    "l_quantity_max": "max(l_quantity)",
    "l_quantity_min": "min(l_quantity)",
}


@query(_long("l_returnflag", "l_linestatus", "lineitem", _ALL_AGGS))
def pv_all_aggs(spark: SparkSession, sf: str) -> DataFrame:
    values = tuple(("l_quantity", a) for a in ("sum", "avg", "count", "max", "min"))
    return pivot_long(read_table(spark, sf, "lineitem"), PivotSpec(("l_returnflag",), ("l_linestatus",), values))


@query(
    "SELECT l_returnflag, "
    + ", ".join(
        f"coalesce(sum(CASE WHEN l_linestatus = '{s}' THEN l_quantity END), 0.0) AS \"{s} - l_quantity (sum)\", "
        f"coalesce(max(CASE WHEN l_linestatus = '{s}' THEN l_tax END), 0.0) AS \"{s} - l_tax (max)\""
        for s in ("F", "O")
    )
    + " FROM lineitem GROUP BY l_returnflag"
)
def pv_wide(spark: SparkSession, sf: str) -> DataFrame:
    values = (("l_quantity", "sum"), ("l_tax", "max"))
    return pivot_wide(read_table(spark, sf, "lineitem"), PivotSpec(("l_returnflag",), ("l_linestatus",), values))


@query(
    "SELECT p_brand, "
    + ", ".join(
        f"CAST(count(*) FILTER (WHERE p_size = {s}) AS DOUBLE) AS \"{s} - p_partkey (Количество)\"" for s in (1, 2, 50)
    )
    + " FROM part GROUP BY p_brand"
)
def pv_wide_given_keys(spark: SparkSession, sf: str) -> DataFrame:
    spec = PivotSpec(("p_brand",), ("p_size",), (("p_partkey", "Количество"),))
    return pivot_wide(read_table(spark, sf, "part"), spec, column_keys=[("1",), ("2",), ("50",)], unlisted="drop")


@query(_long(f"'{TOTAL_LABEL}' AS \"{TOTAL_LABEL}\"", "o_orderstatus", "orders", {"o_custkey_sum": "sum(o_custkey)"}))
def pv_total_rows(spark: SparkSession, sf: str) -> DataFrame:
    return pivot_long(read_table(spark, sf, "orders"), PivotSpec((), ("o_orderstatus",), (("o_custkey", "sum"),)))


@query(_long("o_orderstatus", f"'{TOTAL_LABEL}'", "orders", {"o_custkey_max": "max(o_custkey)"}))
def pv_total_cols(spark: SparkSession, sf: str) -> DataFrame:
    return pivot_long(read_table(spark, sf, "orders"), PivotSpec(("o_orderstatus",), (), (("o_custkey", "max"),)))


@query(
    _long(
        "l_returnflag",
        "l_linestatus",
        "(SELECT DISTINCT l_returnflag, l_linestatus, l_quantity FROM lineitem)",
        {"l_quantity_sum": "sum(l_quantity)", "l_quantity_count": "count(*)"},
    )
)
def pv_dedup(spark: SparkSession, sf: str) -> DataFrame:
    values = (("l_quantity", "sum"), ("l_quantity", "count"))
    spec = PivotSpec(("l_returnflag",), ("l_linestatus",), values, remove_duplicates=True)
    return pivot_long(read_table(spark, sf, "lineitem"), spec)


@query(
    _long(
        "l_returnflag",
        "l_linestatus",
        "(SELECT * FROM lineitem WHERE l_linenumber IN (1, 3))",
        {"l_quantity_sum": "sum(l_quantity)"},
    )
)
def pv_filtered(spark: SparkSession, sf: str) -> DataFrame:
    spec = PivotSpec(("l_returnflag",), ("l_linestatus",), (("l_quantity", "sum"),))
    return pivot_long(read_table(spark, sf, "lineitem"), spec, "l_linenumber", ["1", "3"])


_COERCED = "CASE WHEN event_type = 'error' THEN 'n/a' WHEN user_id = 7 THEN '' ELSE CAST(user_id AS {}) END"


@query(
    _long(
        "event_type",
        f"'{TOTAL_LABEL}'",
        f"(SELECT event_type, coalesce(TRY_CAST({_COERCED.format('VARCHAR')} AS DOUBLE), 0) AS x FROM events)",
        {"cell_sum": "sum(x)", "cell_avg": "sum(x) / count(*)", "cell_min": "min(x)", "cell_count": "count(*)"},
    )
)
def pv_text_coercion(spark: SparkSession, sf: str) -> DataFrame:
    events = read_table(spark, sf, "events").withColumn("cell", F.expr(_COERCED.format("STRING")))
    values = tuple(("cell", a) for a in ("sum", "avg", "min", "count"))
    return pivot_long(events.select("event_type", "cell"), PivotSpec(("event_type",), (), values))


_NAN_TAX = "CASE WHEN l_tax = 0 THEN 'nan' WHEN l_tax > 0.07 THEN 'inf' ELSE CAST(l_tax AS {}) END"


@query(
    _long(
        "l_returnflag",
        "l_linestatus",
        f"(SELECT *, CAST({_NAN_TAX.format('VARCHAR')} AS DOUBLE) AS x FROM lineitem)",
        {
            "cell_max": "max(x) FILTER (NOT isnan(x))",
            "cell_min": "min(x) FILTER (NOT isnan(x))",
            "cell_sum": "sum(x)",
            "cell_count": "count(*)",
        },
    )
)
def pv_nan(spark: SparkSession, sf: str) -> DataFrame:
    """NaN takes over sums, never a maximum or minimum."""
    lineitem = read_table(spark, sf, "lineitem")
    cells = lineitem.select("l_returnflag", "l_linestatus", F.expr(_NAN_TAX.format("STRING")).alias("cell"))
    values = tuple(("cell", a) for a in ("max", "min", "sum", "count"))
    return pivot_long(cells, PivotSpec(("l_returnflag",), ("l_linestatus",), values))


@query(
    _long(
        f"{_PRIORITY} AS priority",
        f"'{TOTAL_LABEL}'",
        f"orders WHERE {_PRIORITY} IS NOT NULL",
        {"priority_count": "count(*)", "unknown_sum": "0"},
    )
)
def pv_absent_key(spark: SparkSession, sf: str) -> DataFrame:
    """Rows without a key cell belong to no group; an unknown value column gives 0."""
    spec = PivotSpec(("priority",), (), (("priority", "count"), ("unknown", "sum")))
    return pivot_long(_orders_with_gaps(spark, sf), spec)


@query(
    _long(
        "o_orderstatus",
        f"'{TOTAL_LABEL}'",
        f"orders WHERE {_PRIORITY} = '2-HIGH' OR {_PRIORITY} IS NULL",
        {"o_custkey_sum": "sum(o_custkey)"},
    )
)
def pv_filter_keeps_short(spark: SparkSession, sf: str) -> DataFrame:
    orders = read_table(spark, sf, "orders").withColumn("priority", F.expr(_PRIORITY))
    return pivot_long(orders, PivotSpec(("o_orderstatus",), (), (("o_custkey", "sum"),)), "priority", ["2-HIGH"])


@query(
    "SELECT l_returnflag AS row_key, i AS idx, CASE i WHEN 0 THEN sum(l_quantity) FILTER (WHERE l_linestatus = 'F') "
    "WHEN 1 THEN CAST(count(*) FILTER (WHERE l_linestatus = 'F') AS DOUBLE) WHEN 2 THEN sum(l_quantity) FILTER "
    "(WHERE l_linestatus = 'O') ELSE CAST(count(*) FILTER (WHERE l_linestatus = 'O') AS DOUBLE) END AS value "
    "FROM lineitem, (SELECT unnest([0, 1, 2, 3]) AS i) GROUP BY l_returnflag, i"
)
def pv_grid(spark: SparkSession, sf: str) -> DataFrame:
    values = (("l_quantity", "sum"), ("l_quantity", "count"))
    spec = PivotSpec(("l_returnflag",), ("l_linestatus",), values)
    _, rows = pivot_grid(with_source(read_table(spark, sf, "lineitem")), spec)
    return rows.select(F.col("row_key")[0].alias("row_key"), F.posexplode("cells").alias("idx", "value"))


@query(
    "SELECT CAST(l_linenumber AS VARCHAR) AS l_linenumber, sum(l_quantity) FILTER (WHERE l_linestatus = 'F') AS \"F - l_quantity (sum)\", sum(l_quantity) "
    "FILTER (WHERE l_linestatus = 'O') AS \"O - l_quantity (sum)\" FROM lineitem GROUP BY 1 ORDER BY 1 LIMIT 3"
)
def pv_preview(spark: SparkSession, sf: str) -> DataFrame:
    """The first rows of the wide form."""
    spec = PivotSpec(("l_linenumber",), ("l_linestatus",), (("l_quantity", "sum"),))
    return pivot_preview(read_table(spark, sf, "lineitem"), spec, 3)


@query(
    "SELECT l_returnflag AS row_key, CAST(l_partkey AS VARCHAR) AS col_key, 'l_quantity_' || m AS metric, CASE m WHEN "
    "'sum' THEN sum(l_quantity) ELSE CAST(count(*) AS DOUBLE) END AS value FROM lineitem, (SELECT unnest(['sum', "
    "'count']) AS m) GROUP BY l_returnflag, l_partkey, m"
)
def pv_many_columns(spark: SparkSession, sf: str) -> DataFrame:
    """A pivot with more columns than a sheet shall have comes in the long form."""
    spec = PivotSpec(("l_returnflag",), ("l_partkey",), (("l_quantity", "sum"), ("l_quantity", "count")))
    _, rows = pivot_grid(with_source(read_table(spark, sf, "lineitem")), spec, max_columns=100)
    key = F.col("row_key")
    cells = [key[0].alias("row_key"), key[1].alias("col_key"), key[2].alias("metric"), F.col("cells")[0].alias("value")]
    return rows.select(*cells)


# ---------------------------------------------------------------- layout and names

_LAYOUT = ExportSpec(
    file_split_column="l_returnflag", selected_columns=("l_orderkey", "l_quantity"), deduplicate_rows=False
)


def _ordered_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    columns = [*LINE_ORDER, "l_returnflag", "l_linestatus", "l_quantity"]
    return with_row_id(read_table(spark, sf, "lineitem").select(*columns), LINE_ORDER)


@query(
    "SELECT l_returnflag AS dest_file, l_orderkey, l_quantity, CAST((n - 1) // 999 + 1 AS INTEGER) AS sheet_part, "
    "(n - 1) % 999 + 2 AS sheet_row FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY "
    f"{LINE_ORDER_SQL}) AS n FROM lineitem)"
)
def lay_rollover(spark: SparkSession, sf: str) -> DataFrame:
    placed = place_rows(shape(_ordered_lineitem(spark, sf), _LAYOUT), cap=999)
    return placed.select("dest_file", "l_orderkey", "l_quantity", "sheet_part", "sheet_row")


@query(f"SELECT l_orderkey, row_number() OVER (ORDER BY {LINE_ORDER_SQL}) AS row_no FROM lineitem")
def lay_row_number(spark: SparkSession, sf: str) -> DataFrame:
    return number_rows(_ordered_lineitem(spark, sf)).select("l_orderkey", "row_no")


_MANIFEST_SQL = (
    "WITH d AS (SELECT l_returnflag AS dest_file, l_linestatus AS dest_sheet, count(*) AS n FROM lineitem GROUP BY "
    "ALL), p AS (SELECT *, unnest(range(1, CAST(ceil(n / 999.0) AS BIGINT) + 1)) AS part FROM d) SELECT '' AS "
    "source_file, dest_file, dest_sheet, CAST(part AS INTEGER) AS sheet_part, 'export (conver_run)_' || dest_file || "
    "'.xlsx' AS file_name, dest_sheet || CASE WHEN part > 1 THEN '_' || part ELSE '' END AS sheet_name, "
    "least(999, n - (part - 1) * 999) AS n_rows FROM p"
)


@query(_MANIFEST_SQL)
def lay_manifest(spark: SparkSession, sf: str) -> DataFrame:
    spec = ExportSpec(file_split_column="l_returnflag", sheet_split_column="l_linestatus")
    counts = materialize(destinations(shape(_ordered_lineitem(spark, sf), spec)))
    return manifest(counts, "run", cap=999).drop("workbook_part", "sheet_no")


def _unique_sql(items: str, limit: int, cut: str) -> str:
    """SQL that names row after row, keeping the list of names already used."""
    suffix = "('_' || CAST(k AS VARCHAR))"
    tries = (
        f"list_concat([t.base], list_transform(range(1, len(s.used) + 2), "
        f"lambda k: {cut.format(text=f'left(t.base, {limit} - length({suffix}))')} || {suffix}))"
    )
    pick = f"list_filter({tries}, lambda c: NOT list_contains(s.used, lower(c)))[1]"
    return (
        f"WITH RECURSIVE items AS ({items}), step AS (SELECT CAST(0 AS BIGINT) AS i, CAST('' AS VARCHAR) AS value, "
        "CAST('' AS VARCHAR) AS name, CAST([] AS VARCHAR[]) AS used UNION ALL SELECT i, value, name, "
        "list_append(used, lower(name)) FROM (SELECT t.i, t.value, s.used, "
        f"{pick} AS name FROM step s JOIN items t ON t.i = s.i + 1)) SELECT value, name FROM step WHERE i > 0"
    )


@query(
    _unique_sql(
        "SELECT row_number() OVER (ORDER BY min(page_id)) AS i, url AS value, left(trim(regexp_replace(trim(url), "
        "'[:\\\\/?*\\[\\]]', '_', 'g')), 29) AS base FROM pages GROUP BY url",
        29,
        "{text}",
    )
)
def nm_sheet(spark: SparkSession, sf: str) -> DataFrame:
    values = read_table(spark, sf, "pages").groupBy(F.col("url").alias("value")).agg(F.min("page_id").alias("row_id"))
    named = unique_sheet_names(values.withColumn("base", clean_sheet_name(F.col("value"))), "base", "name")
    return named.select("value", "name")


@query(
    _unique_sql(
        "SELECT row_number() OVER (ORDER BY min(page_id)) AS i, url AS value, rtrim(left(rtrim(regexp_replace(url, "
        "'[<>:\"/\\\\|?*]', '_', 'g'), '. '), 80), '. ') AS base FROM pages GROUP BY url",
        80,
        "rtrim({text}, '. ')",
    )
)
def nm_file(spark: SparkSession, sf: str) -> DataFrame:
    values = read_table(spark, sf, "pages").groupBy(F.col("url").alias("value")).agg(F.min("page_id").alias("row_id"))
    named = unique_file_stems(values.withColumn("base", clean_file_stem(F.col("value"))), "base", "name")
    return named.select("value", "name")


_NUMBERED_SQL = (
    "SELECT row_number() OVER (ORDER BY p_partkey) AS i, value, value AS base FROM (SELECT p_partkey, 'x_' || p_partkey AS "
    "value FROM part WHERE p_partkey % 3 > 0 UNION ALL SELECT p_partkey + 1000000, 'X' FROM part WHERE p_partkey % 10 = 0)"
)


@query(_unique_sql(_NUMBERED_SQL, 29, "{text}"))
def nm_sheet_numbered(spark: SparkSession, sf: str) -> DataFrame:
    """Values that read like the numbered names of another value."""
    part = read_table(spark, sf, "part")
    numbered = part.filter("p_partkey % 3 > 0").select(
        F.concat(F.lit("x_"), F.col("p_partkey").cast("string")).alias("value"), F.col("p_partkey").cast("long").alias("row_id")
    )
    same = part.filter("p_partkey % 10 = 0").select(F.lit("X").alias("value"), (F.col("p_partkey") + 1000000).cast("long").alias("row_id"))
    values = numbered.unionByName(same)
    return unique_sheet_names(values.withColumn("base", clean_sheet_name(F.col("value"))), "base", "name").select("value", "name")


# ---------------------------------------------------------------- run metrics


@query(
    "SELECT 'run' AS run_id, (SELECT count(*) FROM lineitem) AS rows_in, (SELECT count(*) FROM lineitem WHERE "
    "l_returnflag IN ('A', 'R')) AS rows_kept, (SELECT count(*) FROM lineitem WHERE l_returnflag IN ('A', 'R')) AS "
    "rows_routed, (SELECT count(*) FROM lineitem WHERE l_returnflag IN ('A', 'R')) - CAST(sum(n_rows) AS BIGINT) AS "
    f"duplicates_removed, count(*) AS outputs FROM ({_FORECAST_SQL})"
)
def bt_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return export_metrics(read_table(spark, sf, "lineitem"), _FORECAST, "run")


# ---------------------------------------------------------------- text files and outputs

_ORDER_COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
_ORDERS_AS_TEXT = (
    "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus, "
    "o_orderpriority FROM orders"
)


def _orders_as_csv(spark: SparkSession, sf: str) -> str:
    """The orders as a folder of CSV files."""
    folder = scratch_dir(spark, "orders")
    write_csv(read_table(spark, sf, "orders").select(*_ORDER_COLUMNS), folder)
    return folder


@query(
    "SELECT 'utf-8' AS encoding, ';' AS delimiter, 'o_orderkey|o_custkey|o_orderstatus|o_orderpriority' AS headers, "
    "count(*) AS n_rows, CAST(0 AS BIGINT) AS n_ragged FROM orders"
)
def src_profile(spark: SparkSession, sf: str) -> DataFrame:
    profile = profile_batch(spark, _orders_as_csv(spark, sf)).filter("error IS NULL")
    return profile.groupBy("encoding", "delimiter", F.array_join("headers", "|").alias("headers")).agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_ragged").alias("n_ragged")
    )


@query(_ORDERS_AS_TEXT)
def snk_csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    return read_delimited(spark, _orders_as_csv(spark, sf)).select(*_ORDER_COLUMNS)


@query(
    "SELECT CAST(doc_id AS VARCHAR) AS doc_id, replace(text, chr(13) || chr(10), chr(10)) AS text, lang FROM documents"
)
def src_quoted_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Whole multi-line texts through CSV and back."""
    folder = scratch_dir(spark, "documents")
    write_csv(read_table(spark, sf, "documents").select("doc_id", "text", "lang"), folder)
    return read_delimited(spark, folder).select("doc_id", "text", "lang")


@query(_ORDERS_AS_TEXT.replace("SELECT", "SELECT o_orderpriority AS dest_file,", 1))
def snk_split_csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    folder = scratch_dir(spark, "split")
    spec = ExportSpec(output_format="csv", file_split_column="o_orderpriority")
    export(read_table(spark, sf, "orders").select(*_ORDER_COLUMNS), spec, folder, "run")
    back = read_delimited(spark, folder)
    dest = F.regexp_extract("source_file", r"file_name=export \(conver_run\)_(.*)\.csv/", 1)
    return back.select(dest.alias("dest_file"), *_ORDER_COLUMNS)


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus IN ('F', 'O')")
def snk_parquet(spark: SparkSession, sf: str) -> DataFrame:
    folder = scratch_dir(spark, "parquet")
    spec = ExportSpec(
        output_format="parquet",
        filter_column="o_orderstatus",
        filter_values=("F", "O"),
        file_split_column="o_orderstatus",
    )
    export(read_table(spark, sf, "orders").select(*_ORDER_COLUMNS), spec, folder, "run")
    return spark.read.parquet(folder).select(*_ORDER_COLUMNS)


@query(
    "SELECT '' AS source_file, o_orderstatus AS dest_file, o_orderpriority AS dest_sheet, CAST(1 AS INTEGER) AS "
    "sheet_part, 'export (conver_run)_' || o_orderstatus || '.xlsx' AS file_name, o_orderpriority AS sheet_name, "
    "count(*) AS n_rows, CAST(NULL AS VARCHAR) AS error FROM orders GROUP BY o_orderstatus, o_orderpriority"
)
def snk_workbook(spark: SparkSession, sf: str) -> DataFrame:
    spec = ExportSpec(file_split_column="o_orderstatus", sheet_split_column="o_orderpriority")
    orders = read_table(spark, sf, "orders").select(*_ORDER_COLUMNS)
    return export(orders, spec, scratch_dir(spark, "books"), "run")


@query(
    f"SELECT l_returnflag, l_linestatus AS \"{PIVOT_COLUMN_HEADER}\", 'l_quantity_sum' AS \"{PIVOT_METRIC_HEADER}\", "
    f"printf('%.1f', sum(l_quantity)) AS \"{PIVOT_VALUE_HEADER}\" FROM lineitem GROUP BY ALL UNION ALL SELECT "
    f"l_returnflag, l_linestatus, 'l_quantity_count', CAST(count(*) AS VARCHAR) FROM lineitem GROUP BY ALL"
)
def snk_pivot_csv(spark: SparkSession, sf: str) -> DataFrame:
    folder = scratch_dir(spark, "pivot")
    values = (("l_quantity", "sum"), ("l_quantity", "count"))
    spec = ExportSpec(output_format="csv", pivot=PivotSpec(("l_returnflag",), ("l_linestatus",), values))
    lineitem = read_table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity")
    export(lineitem, spec, folder, "run")
    back = read_delimited(spark, f"{folder}/file_name=export (conver_run)_{PIVOT_LABEL}.csv")
    return back.drop("source_file", "row_id")


def _split_back(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of a split CSV output with the destination taken from its file names."""
    back = read_delimited(spark, folder)
    name = F.regexp_extract("source_file", r"file_name=([^/]*)\.csv/", 1)
    return back.select(
        F.regexp_extract(name, r" \(conver_[^)]*\)_(.*)$", 1).alias("dest_file"),
        *_ORDER_COLUMNS,
    )


def _typed_back(back: DataFrame, like: DataFrame) -> list[Column]:
    return [F.col(f.name).cast(f.dataType).alias(f.name) for f in like.schema.fields]


@query("SELECT * FROM orders")
def snk_csv_all_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Every column of a typed table, doubles and timestamps too, through CSV and back into its type."""
    folder, orders = scratch_dir(spark, "orders"), read_table(spark, sf, "orders")
    write_csv(orders, folder)
    back = read_delimited(spark, folder)
    return back.select(*_typed_back(back, orders))


@query("SELECT event_type AS dest_file, * FROM events")
def snk_split_csv_events(spark: SparkSession, sf: str) -> DataFrame:
    """Every column of the events, fractions of seconds and quoted JSON too, through a split export and back."""
    folder, events = scratch_dir(spark, "events"), read_table(spark, sf, "events")
    export(events, ExportSpec(output_format="csv", file_split_column="event_type"), folder, "run")
    back = read_delimited(spark, folder)
    dest = F.regexp_extract("source_file", r"file_name=export \(conver_run\)_(.*)\.csv/", 1)
    return back.select(dest.alias("dest_file"), *_typed_back(back, events))


@query(_ORDERS_AS_TEXT.replace("SELECT", "SELECT o_orderpriority AS dest_file,", 1))
def bt_batch(spark: SparkSession, sf: str) -> DataFrame:
    """All rows of a batch, as its outputs hold them."""
    folder = scratch_dir(spark, "batch")
    spec = ExportSpec(output_format="csv", file_split_column="o_orderpriority")
    export_batch(spark, _orders_as_csv(spark, sf), spec, folder, "run")
    return _split_back(spark, folder)


@query(
    "SELECT DISTINCT 'part' || CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE '_2' END || ' (conver_run)_' || o_orderstatus || "
    "'.csv' AS file_name, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus, CAST(NULL AS VARCHAR) AS error FROM "
    "orders UNION ALL SELECT NULL, NULL, NULL, 'no line read'"
)
def bt_per_file(spark: SparkSession, sf: str) -> DataFrame:
    """Every file is a scope of its own for names and duplicates; a file without a line gets an error row."""
    folder, out = scratch_dir(spark, "files"), scratch_dir(spark, "batch")
    orders = read_table(spark, sf, "orders").select(*_ORDER_COLUMNS)
    for half in (0, 1):
        write_csv(orders.filter(F.col("o_orderkey") % 2 == half).coalesce(1), f"{folder}/{half}")
    orders.limit(0).select("o_orderstatus").coalesce(1).write.text(f"{folder}/empty")
    spec = ExportSpec(output_format="csv", file_split_column="o_orderstatus", selected_columns=("o_custkey", "o_orderstatus"))
    done = materialize(export_batch(spark, folder, spec, out, "run"))
    # The writer gives its files names of its own; what comes after them is to be seen.
    shown = F.replace("file_name", file_stem(F.col("source_file")), F.lit("part"))
    names = done.filter("error IS NULL").select("file_name", shown.alias("shown")).distinct()
    back = read_delimited(spark, out)
    back = back.withColumn("file_name", F.regexp_extract("source_file", r"file_name=([^/]*)/", 1)).join(names, "file_name")
    none = F.lit(None).cast("string")
    rows = back.select(F.col("shown").alias("file_name"), "o_custkey", "o_orderstatus", none.alias("error"))
    failed = done.filter("error IS NOT NULL").select(none.alias("file_name"), none.alias("o_custkey"), none.alias("o_orderstatus"), "error")
    return rows.unionByName(failed)


@query(
    "WITH r AS (SELECT o_orderstatus AS k, o_orderpriority AS v, o_orderkey % 2 AS h FROM orders WHERE o_orderstatus IN ('F', 'O')), "
    "d AS (SELECT DISTINCT k, v, h FROM r WHERE h = 0) SELECT 'run' AS run_id, (SELECT count(*) FROM orders) AS rows_in, "
    "(SELECT count(*) FROM r) AS rows_kept, (SELECT count(*) FROM r) AS rows_routed, (SELECT count(*) FROM r WHERE h = 0) - "
    "(SELECT count(*) FROM d) AS duplicates_removed, (SELECT count(*) FROM d) + (SELECT count(*) FROM r WHERE h = 1) AS "
    "rows_written, (SELECT count(DISTINCT (k, h)) FROM r) AS outputs, CAST(1 AS BIGINT) AS files_failed"
)
def bt_export_counters(spark: SparkSession, sf: str) -> DataFrame:
    """Counters of one run over two headers and a file without a line, of which one header loses its duplicates."""
    folder = scratch_dir(spark, "headers")
    orders = read_table(spark, sf, "orders")
    even, odd = (orders.filter(F.col("o_orderkey") % 2 == half).coalesce(1) for half in (0, 1))
    write_csv(even.select("o_orderstatus", "o_orderpriority", "o_orderkey"), f"{folder}/even")
    write_csv(odd.select("o_orderpriority", "o_orderstatus"), f"{folder}/odd")
    orders.limit(0).select("o_orderstatus").coalesce(1).write.text(f"{folder}/empty")
    spec = ExportSpec(
        output_format="csv",
        filter_column="o_orderstatus",
        filter_values=("F", "O"),
        file_split_column="o_orderstatus",
        selected_columns=("o_orderstatus", "o_orderpriority"),
    )
    return run_batch(spark, folder, spec, scratch_dir(spark, "batch"), "run")[1]


@query(_ORDERS_AS_TEXT.replace("SELECT", "SELECT o_orderpriority AS dest_file,", 1))
def st_arrivals(spark: SparkSession, sf: str) -> DataFrame:
    """All rows of the files that arrived, as the outputs hold them."""
    spec = ExportSpec(output_format="csv", file_split_column="o_orderpriority")
    out = scratch_dir(spark, "arrivals")
    export_arrivals(spark, _orders_as_csv(spark, sf), spec, out, scratch_dir(spark, "progress")).awaitTermination()
    return _split_back(spark, out)


_NOTE = "Заказ "


@query(
    "SELECT encoding, delimiter, CAST(o_orderkey AS VARCHAR) AS o_orderkey, '" + _NOTE + "' || o_orderpriority AS note FROM "
    "orders, (VALUES ('utf-8', ';'), ('windows-1251', chr(9)), ('utf-16-be', ',')) AS d(encoding, delimiter)"
)
def src_encodings(spark: SparkSession, sf: str) -> DataFrame:
    """Files of several encodings, delimiters and extensions, found out and read; others are passed over."""
    folder = scratch_dir(spark, "encodings")
    orders = read_table(spark, sf, "orders")

    def write(name: str, note: str, **options: str) -> None:
        table = orders.select("o_orderkey", F.concat(F.lit(note), "o_orderpriority").alias("note"))
        table.write.options(header="true", **options).csv(f"{folder}/{name}")

    write("one", _NOTE, sep=";")
    # The bytes of the older code page, written as the characters that have these bytes in ISO-8859-1.
    write("two", _NOTE.encode("windows-1251").decode("latin-1"), sep="\t", encoding="ISO-8859-1", extension="tsv")
    write("three", _NOTE, sep=",", encoding="UTF-16")
    write("four", _NOTE, sep=",", extension="log")
    found = profile_batch(spark, folder).select("source_file", "encoding", "delimiter")
    return read_delimited(spark, folder).join(F.broadcast(found), "source_file").select("encoding", "delimiter", "o_orderkey", "note")


@query(
    "SELECT o_orderpriority AS dest_file, o_orderpriority, o_orderkey, o_custkey, o_orderstatus FROM orders WHERE "
    "o_orderstatus = 'F'"
)
def prj_carried_over(spark: SparkSession, sf: str) -> DataFrame:
    """A job carried to another header: known columns keep their order, new ones follow, settings on columns
    that are gone are cleared."""
    orders = read_table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    spec = ExportSpec(
        filter_column="o_orderstatus",
        filter_values=("F",),
        file_split_column="o_orderpriority",
        sheet_split_column="o_comment",
        selected_columns=("o_orderpriority", "o_comment", "o_orderkey"),
        deduplicate_rows=False,
    ).carry_to(orders.columns)
    return shape(orders, spec).drop("source_file", "dest_sheet")


@query("SELECT o_custkey, o_orderkey FROM orders")
def prj_dependent_settings(spark: SparkSession, sf: str) -> DataFrame:
    """A new selection clears filter and splits on columns it leaves out."""
    spec = ExportSpec(
        filter_column="o_orderstatus",
        filter_values=("F",),
        file_split_column="o_orderpriority",
        selected_columns=("o_orderstatus", "o_orderpriority"),
        deduplicate_rows=False,
    ).select(("o_custkey", "o_orderkey"))
    return shape(read_table(spark, sf, "orders"), spec).drop("source_file", "dest_file", "dest_sheet")


# ---------------------------------------------------------------- blank rows, order and positions of text files


def _notes_as_text(spark: SparkSession, sf: str, note: str) -> str:
    """One-column text files of the orders, a folder of them for each of four parts; an absent note is an empty line."""
    folder = scratch_dir(spark, "notes")
    line = F.coalesce(F.expr(note), F.lit(""))
    rows = read_table(spark, sf, "orders").select((F.col("o_orderkey") % 4).alias("part"), F.lit(1).alias("rank"), line.alias("line"))
    headers = spark.range(4).select(F.col("id").alias("part"), F.lit(0).alias("rank"), F.lit("note").alias("line"))
    dealt = rows.unionByName(headers).repartition(4, "part").sortWithinPartitions("part", "rank")
    dealt.select("part", "line").write.partitionBy("part").text(folder)
    return folder


_NOTE_SQL = "CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus || '-' || o_orderkey END"


@query(f"SELECT {_NOTE_SQL} AS note FROM orders")
def src_blank_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Empty lines of files without a cell over lines are rows of absent cells."""
    return read_delimited(spark, _notes_as_text(spark, sf, _NOTE_SQL)).select("note")


_KEY_SQL = "CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE CAST(o_orderkey AS {text}) END"
_CELL_SQL = (
    "CASE WHEN o_orderkey % 4 = 0 THEN '' WHEN o_orderkey % 5 = 0 THEN o_orderstatus || {feed} || {feed} || "
    "o_orderpriority ELSE o_orderstatus END"
)


@query(f"SELECT {_KEY_SQL.format(text='VARCHAR')} AS k, {_CELL_SQL.format(feed='chr(10)')} AS cell FROM orders")
def src_empty_rows_multiline(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of empty cells stay in files with cells over several lines, empty ones among them."""
    cells = read_table(spark, sf, "orders").select(
        F.expr(_KEY_SQL.format(text="STRING")).alias("k"), F.expr(_CELL_SQL.format(feed="char(10)")).alias("cell")
    )
    folder = scratch_dir(spark, "cells")
    write_csv(cells, folder)
    return read_delimited(spark, folder).select("k", "cell")


_LONG_NOTE_SQL = "CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN 'a' || {feed} || {feed} || 'b' ELSE o_orderstatus END"


@query(
    "SELECT count(*) AS n_rows, count(note) AS n_notes, count(*) FILTER (contains(note, chr(10))) AS n_long FROM "
    f"(SELECT {_LONG_NOTE_SQL.format(feed='chr(10)')} AS note FROM orders)"
)
def ins_count_rows_text(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of text files with empty lines between records and inside quoted cells."""
    note = _LONG_NOTE_SQL.replace("'a'", "'\"a'").replace("'b'", "'b\"'").format(feed="char(10)")
    back = read_delimited(spark, _notes_as_text(spark, sf, note))
    rest = back.agg(F.count("note").alias("n_notes"), F.count_if(F.col("note").contains("\n")).alias("n_long"))
    return count_rows(back).join(rest)


@query("SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) AS row_no FROM orders")
def lay_scan_order(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of several typed files are numbered by path and place, whatever tasks read them."""
    folder = scratch_dir(spark, "typed")
    orders = read_table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    orders.repartitionByRange(7, "o_orderkey").sortWithinPartitions("o_orderkey").write.parquet(folder)
    return number_rows(with_row_id(spark.read.parquet(folder))).select("o_orderkey", "o_totalprice", "row_no")


def _events_as_csv(spark: SparkSession, sf: str) -> DataFrame:
    """The events as text, a folder of files for each type, and each type's rows in the order of their ids."""
    folder = scratch_dir(spark, "events")
    events = read_table(spark, sf, "events").repartition(5, "event_type").sortWithinPartitions("event_type", "event_id")
    events.write.partitionBy("event_type").options(header="true", escape='"').csv(folder)
    return read_delimited(spark, folder)


_EVENT_TYPE = "regexp_extract(source_file, 'event_type=([^/]*)/', 1) AS event_type"
_PLACED_EVENTS = "SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS row_pos FROM events"


@query(
    f"SELECT event_type, row_pos, CAST(event_id AS VARCHAR) AS event_id FROM ({_PLACED_EVENTS}) WHERE contains(CAST(event_id AS "
    "VARCHAR), '77') AND event_id % 2 = 1"
)
def ins_search_many_files(spark: SparkSession, sf: str) -> DataFrame:
    """Positions are counted in each file, over all of its rows."""
    events = _events_as_csv(spark, sf)
    found = search_rows(events, "77", "event_id").join(events.select("source_file", "row_id", "event_id"), ["source_file", "row_id"])
    return found.filter("try_cast(event_id AS bigint) % 2 = 1").selectExpr(_EVENT_TYPE, "row_pos", "event_id")


@query(
    "SELECT event_type, CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS user_id, props FROM "
    "(SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS row_pos FROM events WHERE event_id % 3 <> 1) "
    "WHERE row_pos BETWEEN 10 AND 19"
)
def ins_page_text(spark: SparkSession, sf: str) -> DataFrame:
    """The second page of each file, of the rows that a filter left."""
    kept = _events_as_csv(spark, sf).filter("try_cast(event_id AS bigint) % 3 <> 1")
    return page(kept, 2, 10).selectExpr(_EVENT_TYPE, "event_id", "user_id", "props")


# ---------------------------------------------------------------- streams of events


def _event_stream(spark: SparkSession, folder: str, **options: int) -> DataFrame:
    events = spark.readStream.schema(spark.read.parquet(folder).schema).options(**options).parquet(folder)
    return events.withColumn("ts", F.col("ts").cast("timestamp"))  # a watermark needs an instant


def _arrived(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """What a stream gives in append mode until its files are done."""
    out = scratch_dir(spark, "stream")
    writer = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch_dir(spark, "progress"))
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query("SELECT event_id, ts, user_id, event_type, value FROM events")
def st_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """All events arrive again in a second micro-batch: what the watermark has passed is late, the rest duplicates."""
    folder = scratch_dir(spark, "sent")
    events = read_table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value")
    for _ in range(2):
        events.repartition(4).write.mode("append").parquet(folder)
    sent = _event_stream(spark, folder, maxFilesPerTrigger=4)
    once = _arrived(spark, drop_stream_duplicates(sent, ["event_id"], "ts", "1 day"))
    return once.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


_STREAM_TYPES = ("click", "error")


@query(
    "SELECT * FROM (SELECT time_bucket(INTERVAL '6 hours', ts) AS start, time_bucket(INTERVAL '6 hours', ts) + INTERVAL '6 hours' AS "
    "\"end\", "
    + ", ".join(f"count(*) FILTER (event_type = '{t}') AS {t}" for t in _STREAM_TYPES)
    + f", count(*) FILTER (event_type NOT IN ({_q(*_STREAM_TYPES)}) OR event_type IS NULL) AS others FROM events GROUP BY ALL) WHERE "
    "\"end\" <= (SELECT max(ts) - INTERVAL '1 hour' FROM events)"
)
def st_window_pivot(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of six-hour windows that the watermark has passed."""
    folder = scratch_dir(spark, "sent")
    read_table(spark, sf, "events").select("ts", "event_type").repartition(4).write.parquet(folder)
    counts = window_pivot(_event_stream(spark, folder), "ts", "6 hours", "1 hour", "event_type", _STREAM_TYPES)
    return _arrived(spark, counts).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})
