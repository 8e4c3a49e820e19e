"""DataFrame-to-DataFrame operators."""

from .dedup import count_duplicates, drop_duplicate_rows
from .filters import drop_blank_rows, filter_in
from .inspect import (
    count_rows,
    count_values,
    distinct_values,
    export_count,
    forecast,
    forecast_totals,
    mark_cells,
    page,
    page_info,
    rank_forecast,
    search_rows,
    search_summary,
    search_values,
)
from .layout import manifest, place_rows, sheet_parts
from .naming import clean_file_stem, clean_sheet_name, unique_file_stems, unique_sheet_names
from .numbering import number_rows, position_rows, running, with_row_id
from .pivot import pivot_grid, pivot_long, pivot_preview, pivot_wide
from .projection import select_columns
from .routing import route
from .shape import destinations, export_metrics, shape, with_source

__all__ = [name for name in dir() if not name.startswith("_")]
