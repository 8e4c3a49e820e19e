"""Labels and aggregation names that results must use as they are."""

OTHERS_LABEL = "Остальные"
TOTAL_LABEL = "Итого"
SHEET_LABEL = "Все проекты"
PIVOT_LABEL = "Сводная таблица"
PIVOT_COLUMN_HEADER = "Колонка"
PIVOT_METRIC_HEADER = "Метрика"
PIVOT_VALUE_HEADER = "Значение"
AGGREGATIONS = {
    "Сумма": "sum",
    "Среднее": "avg",
    "Количество": "count",
    "Максимум": "max",
    "Минимум": "min",
}
