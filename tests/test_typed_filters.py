"""Value lists on typed columns: the rows are those of the text, the scan gets the typed values."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from rowforge.functions import as_text
from rowforge.operators import filter_in, pivot_wide
from rowforge.plans.spec import PivotSpec

ROWS = [
    (date(2024, 2, 29), datetime(2024, 2, 29, 1, 2, 3, 450000), True, 0.1, "a"),
    (date(1, 1, 1), datetime(1999, 12, 31, 23, 59, 59), False, -0.0, "é"),
    (date(9999, 12, 31), datetime(2024, 2, 29, 1, 2, 3), None, 0.0, "z"),
    (None, None, True, 1e10, "😀"),
    (date(2024, 3, 1), datetime(2024, 3, 1), False, float("nan"), None),
    (date(2024, 3, 1), datetime(2024, 3, 1), False, float("inf"), ""),
]
LISTS = {
    "d": [["2024-02-29"], ["2024-02-29", "9999-12-31"], ["2024-02-30"], ["2024-3-1", "2024-03-01"], ["x"]],
    "t": [["2024-02-29 01:02:03.45"], ["2024-02-29 01:02:03.450"], ["2024-03-01 00:00:00", "1999-12-31 23:59:59"]],
    "b": [["true"], ["false", "true"], ["TRUE"], ["1", "false"]],
    "x": [["0.1"], ["0.10"], ["0.0"], ["-0.0", "0.1"], ["NaN"], ["1.0E10", "0.1"], ["10000000000"], ["Infinity"], ["one"]],
    "s": [["a", "😀"], ["é"]],
}


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("typed") / "t")
    spark.createDataFrame(ROWS, "d date, t timestamp_ntz, b boolean, x double, s string").write.parquet(folder)
    return spark.read.parquet(folder)


@pytest.mark.parametrize("short_rows", ["drop", "keep"])
@pytest.mark.parametrize("filler", [0, 1200])
def test_rows_are_those_of_the_text(table, short_rows, filler):
    for name, lists in LISTS.items():
        text = as_text(F.col(name), table.schema[name].dataType).alias("text")
        texts = [r["text"] for r in table.select(text).collect()]
        for values in lists:
            more = [f"{2000 + i % 8000}-01-01" if name == "d" else f"{i}.5" for i in range(filler)]
            wanted = sorted((t or "") for t in texts if t in [*values, *more] or (t is None and short_rows == "keep"))
            made = filter_in(table, name, [*values, *more], short_rows).select(text).collect()
            assert sorted((r["text"] or "") for r in made) == wanted, (name, values)


@pytest.mark.parametrize("name, values", [("d", ["2024-02-29"]), ("t", ["2024-03-01 00:00:00"]), ("b", ["true"]), ("x", ["0.1"])])
def test_typed_values_reach_the_scan(table, name, values):
    plan = filter_in(table, name, values)._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters: [")[1].split("]")[0]
    assert f"EqualTo({name}," in pushed or f"In({name}," in pushed


def test_the_range_of_a_long_list_reaches_the_scan(table):
    plan = filter_in(table, "s", [f"v{i}" for i in range(1500)])._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters: [")[1].split("]")[0]
    assert "GreaterThanOrEqual(s,v0)" in pushed and "LessThanOrEqual(s,v999)" in pushed


def test_given_pivot_keys_lose_nothing(spark):
    df = spark.createDataFrame([("r", "a", "1"), ("r", "b", "2"), ("q", "a", "5")], "r string, c string, v string")
    spec = PivotSpec(rows=("r",), columns=("c",), values=(("v", "sum"),))
    assert pivot_wide(df, spec, column_keys=[("a",), ("b",)]).count() == 2
    for keys in ([("a",)], []):
        with pytest.raises(Exception, match="column key not listed: b|column key not listed: a"):
            pivot_wide(df, spec, column_keys=keys).collect()
    dropped = pivot_wide(df, spec, column_keys=[("a",)], unlisted="drop").collect()
    assert sorted(tuple(r) for r in dropped) == [("q", 5.0), ("r", 1.0)]
