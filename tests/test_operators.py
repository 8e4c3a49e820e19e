import json
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import model
from rowforge.columns import SOURCE_FILE
from rowforge.functions import contains_ci, float_text, is_blank, strip, to_number
from rowforge.operators import (
    clean_file_stem,
    clean_sheet_name,
    count_rows,
    distinct_values,
    export_metrics,
    filter_in,
    mark_cells,
    number_rows,
    page,
    page_info,
    pivot_long,
    pivot_wide,
    place_rows,
    position_rows,
    rank_forecast,
    route,
    running,
    search_rows,
    search_summary,
    select_columns,
    shape,
    sheet_parts,
    unique_file_stems,
    unique_sheet_names,
)
from rowforge.operators import filters, inspect
from rowforge.plans.spec import ExportSpec, PivotSpec


def column(spark, values, name="v"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"row_id long, {name} string")


def evaluated(spark, values, expression):
    return [r.x for r in column(spark, values).select("row_id", expression.alias("x")).orderBy("row_id").collect()]


# ------------------------------------------------------------------ expressions

NUMBERS = [
    "1.5", " 2 ", "1_000", "1e3", ".5", "5.", "1.5d", "1,5", "0x10", "abc", "", "inf", "-inf", "nan", "+NaN", "iNfInItY",
    "1__0", "_1", "1_", "1e400", "١٢", "\x1c7", " 7", "1e5_0", "1_0.0_1", "1._5", "1_.5", "infinit", "１２", None,
    "1-2", "-", "-.5", "5-", "1.2.3", "00012", "-7", "+-1", "1e", "e1", ".", "+.5e-3", "1 2", "\t3\n", "1f", "1L", "NaN1", "-0", "1_0e1_0",
]


def test_to_number(spark):
    got = evaluated(spark, NUMBERS, to_number(F.col("v")))
    want = [model.number(v) for v in NUMBERS]
    assert [repr(x) for x in got] == [repr(x) for x in want]


def test_float_text(spark):
    rng = random.Random(1)
    values = [0.0, -0.0, 1e7, 1e16, 9999999999999998.0, 1e-4, 9.9e-5, 1e300, -2.5e-7, float("inf"), float("nan"), 2 / 3]
    values += [rng.choice([1, -1]) * round(rng.random(), rng.randint(1, 6)) * 10.0 ** rng.randint(-8, 18) for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "x double").select("x", float_text(F.col("x")).alias("t"))
    for row in df.collect():
        # The digits are those of the JVM, which may give one more than the shortest form.
        assert float(row.t) == row.x or row.x != row.x
        assert ("e" in row.t) == ("e" in repr(row.x))
        if len(repr(row.x)) == len(row.t):
            assert row.t == repr(row.x)


def test_blank_and_strip(spark):
    values = [None, "", "  ", " ", "\x1c", " \t", "x", " x ", "​"]
    assert evaluated(spark, values, is_blank(F.col("v"))) == [not (v or "").strip() for v in values]
    assert evaluated(spark, values, strip(F.col("v"))) == [v and v.strip() if v is not None else None for v in values]


def test_contains_ci(spark):
    values = ["Привет", "пРиВ", "abc", None, ""]
    assert evaluated(spark, values, contains_ci(F.col("v"), "ПРИВ")) == [True, True, False, False, False]


# ------------------------------------------------------------------ filters, columns, routing


def test_long_value_list_equals_literals(spark, monkeypatch):
    df = column(spark, ["a", "b", None, "", "c"])
    for mode in ("drop", "keep"):
        literal = filter_in(df, "v", ["a", "", "zz"], mode).collect()
        monkeypatch.setattr(filters, "LITERAL_VALUES", 1)
        joined = filter_in(df, "v", ["a", "", "zz"], mode).collect()
        table = filter_in(df, "v", spark.createDataFrame([("a",), ("",), ("a",)], "w string"), mode).collect()
        monkeypatch.undo()
        assert sorted(literal) == sorted(joined) == sorted(table)


def test_unknown_filter_column(spark):
    df = column(spark, ["a"])
    with pytest.warns(UserWarning):
        assert filter_in(df, "V", ["x"]).count() == 1
    with pytest.raises(ValueError):
        filter_in(df, "V", ["x"], strict=True)
    assert filter_in(df, "v", []).count() == 1


@pytest.mark.parametrize("limit", [1000, 0])
def test_route(spark, monkeypatch, limit):
    monkeypatch.setattr("rowforge.operators.routing.LITERAL_VALUES", limit)
    values = ["", "  ", " ", "\x1c", "x", " x ", "Остальные", "y", None]
    df = column(spark, values)
    want = [(v, model.destination(v, {"x"}, "Остальные")) for v in values]
    got = [(r.v, r.d) for r in route(df, "v", ["x"], "d").orderBy("row_id").collect()]
    assert got == [w for w in want if w[1] is not None]
    plain = [(r.v, r.d) for r in route(df, "v", out="d").orderBy("row_id").collect()]
    assert plain == [(v, v) for v in values if v and v.strip()]


def test_selection(spark):
    df = spark.createDataFrame([("1", None, "3")], "a string, b string, c string")
    with pytest.warns(UserWarning):
        out = select_columns(df, ["c", "zzz", "b", "a"])
    assert out.columns == ["c", "b", "a"] and tuple(out.first()) == ("3", "", "1")
    with pytest.warns(UserWarning):
        assert select_columns(df, ["zzz"]).columns == ["a", "b", "c"]
    assert select_columns(df).columns == ["a", "b", "c"]


# ------------------------------------------------------------------ numbering and layout


def sliced(spark, rng, n_slices=6):
    rows = []
    for s in range(n_slices):
        for i in range(rng.randint(0, 30)):
            rows.append(((s << 33) + i, rng.choice(["a", "b", "hot", "hot", None]), rng.randint(0, 5)))
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "row_id long, k string, x long")


def test_running_values(spark):
    rows, df = sliced(spark, random.Random(2))
    out = number_rows(df, "n")
    out = number_rows(out, "kn", ["k"])
    out = running(out, F.col("x"), "s", ["k"])
    out = running(out, F.col("x"), "m", ["k"], how="max")
    got = {r.row_id: (r.n, r.kn, r.s, r.m) for r in out.collect()}
    seen = {}
    for i, (row_id, k, x) in enumerate(sorted(rows), 1):
        xs = seen.setdefault(k, [])
        xs.append(x)
        assert got[row_id] == (i, len(xs), sum(xs), max(xs))


def test_positions_follow_the_order(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1009).alias("v")).repartition(7)
    rows = position_rows(df, ["v"]).collect()
    assert [r.v for r in sorted(rows, key=lambda r: r.row_pos)] == sorted(r.v for r in rows)
    assert sorted(r.row_pos for r in rows) == list(range(1000))


def test_no_single_task_for_rows(spark):
    df = spark.range(100).select(F.col("id").alias("row_id"), F.lit("k").alias("k"))
    plan = number_rows(df)._jdf.queryExecution().optimizedPlan().toString()
    # One window runs per slice of rows, the other over the table of slice totals.
    assert plan.count("Window [") == 2
    assert len(re.findall(r"windowspecdefinition\(_slice#\d+L, row_id#\d+L ASC", plan)) == 1
    assert re.search(r"windowspecdefinition\(_slice#\d+L ASC[^\n]*\n[^\n]*Aggregate", plan)


def test_roll_over(spark):
    df = spark.createDataFrame([("", "a", "", i) for i in range(25)], "source_file string, dest_file string, dest_sheet string, row_id long")
    rows = sorted((r.row_id, r.sheet_part, r.sheet_row) for r in place_rows(df, 10).collect())
    assert rows == [(i, i // 10 + 1, i % 10 + 2) for i in range(25)]
    parts = sheet_parts(df.groupBy("dest_file").agg(F.count("*").alias("n_rows")), 10).orderBy("sheet_part").collect()
    assert [(p.sheet_part, p.n_rows) for p in parts] == [(1, 10), (2, 10), (3, 5)]


# ------------------------------------------------------------------ names


NAMES = [
    "a/b", "a\\b", "'q'", "x" * 40, "X" * 40, "A", "a", "a_1", "A_1", "'", "", " ' ' ", "a_1_1", "[1]:*?", "<x>", "a..", "a\tb",
    "y" * 100, "y" * 79 + ".z", "...", "a.", "a. .", " b  c ", "Unknown", "Sheet", "sheet", "ПРИВЕТ", "привет", "a b ' ",
]


SHEET_NAMES = {
    "a/b": "a_b", "a\\b": "a_b", "'q'": "q", "x" * 40: "x" * 29, "'": "Sheet", "": "Sheet", "[1]:*?": "_1____",
    "<x>": "<x>", " b  c ": "b  c", "a b ' ": "a b", "ПРИВЕТ": "ПРИВЕТ", "a..": "a..",
}
FILE_STEMS = {
    "a/b": "a_b", "a\\b": "a_b", "<x>": "_x_", "a..": "a", "a. .": "a", "...": "Unknown", "": "Unknown", "y" * 100: "y" * 80,
    " b  c ": "b c", "y" * 79 + ".z": "y" * 79, "'q'": "'q'", "a\tb": "a_b", "привет": "привет",
}


def test_clean_names(spark):
    assert evaluated(spark, list(SHEET_NAMES), clean_sheet_name(F.col("v"))) == list(SHEET_NAMES.values())
    assert evaluated(spark, list(FILE_STEMS), clean_file_stem(F.col("v"))) == list(FILE_STEMS.values())
    for name in evaluated(spark, NAMES, clean_sheet_name(F.col("v"))):
        assert 1 <= len(name) <= 29 and not set(name) & set(":\\/?*[]")
    for name in evaluated(spark, NAMES, clean_file_stem(F.col("v"))):
        assert 1 <= len(name) <= 80 and not set(name) & set('<>:"/\\|?*\t') and name[-1] not in ". "


def name_sets():
    rng = random.Random(4)
    yield NAMES
    yield ["a_1", "a", "A", "a", "a_2", "a_1", "a"] * 3
    yield ["q" * 27 + rng.choice("abc") + rng.choice("xy") for _ in range(150)]
    for _ in range(3):
        yield ["".join(rng.choices(["a", "A", "_1", "_2", "_", "1"], k=rng.randint(1, 4))) for _ in range(60)]
        yield ["z" * rng.randint(24, 30) + rng.choice(["", "_1", "_2", "1", ". "]) for _ in range(60)]


def check_unique(rows, limit):
    """Names of a scope: different without regard to case, within the limit; the first holder keeps its
    base, and whoever is numbered found every smaller number taken by an earlier row."""
    taken = set()
    for row in sorted(rows, key=lambda r: r.row_id):
        assert row.name.lower() not in taken and len(row.name) <= limit
        if row.name != row.b:
            assert row.b.lower() in taken
            stem, _, number = row.name.rpartition("_")
            assert row.b.startswith(stem) or stem == "File"
            for smaller in range(1, int(number)):
                other = f"{stem}_{smaller}".lower()
                # A shorter number leaves room for a longer stem.
                assert any(t == other or (t.endswith(f"_{smaller}") and t.startswith(stem.lower())) for t in taken)
        taken.add(row.name.lower())


def test_unique_names(spark):
    rows = [(str(s), (i % 3 << 33) + i, name) for s, names in enumerate(name_sets()) for i, name in enumerate(names)]
    df = spark.createDataFrame(rows, "scope string, row_id long, v string")
    sheets = unique_sheet_names(df.withColumn("b", clean_sheet_name(F.col("v"))), "b", "name", ["scope"]).collect()
    files = df.withColumn("b", clean_file_stem(F.repeat("v", 3)))
    files = unique_file_stems(files, "b", "name", ["scope"]).collect()
    assert len(sheets) == len(files) == len(rows)
    for made, limit in ((sheets, 29), (files, 80)):
        for scope in {r.scope for r in made}:
            check_unique([r for r in made if r.scope == scope], limit)


def test_passes_do_not_grow_with_the_names(spark, monkeypatch):
    from rowforge.operators import naming

    stored = []
    keep = naming.materialize
    monkeypatch.setattr(naming, "materialize", lambda df, purpose: stored.append(purpose) or keep(df, purpose))
    passes = {}
    for n in (12, 98, 900):
        values = [f"item_{i}" for i in range(1, n + 1)] + ["Item", "item", "ITEM"]
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "row_id long, b string")
        stored.clear()
        named = {r.b: r.name for r in unique_sheet_names(df, "b", "name").collect()}
        assert named["Item"] == "Item" and named["item"] == f"item_{n + 1}" and named["ITEM"] == f"ITEM_{n + 2}"
        passes[n] = len(stored)
    # A stored stage for every number of digits, none for the names.
    assert passes[900] <= passes[12] + 1, passes


# ------------------------------------------------------------------ pivot


def pivot_rows(rng, n):
    rows = []
    for _ in range(n):
        full = [rng.choice(["r1", "r2", "", " "]), rng.choice(["c1", "c 2", "a / b"]), rng.choice(["a", "a / b", "b"]), rng.choice(NUMBERS[:-12] or [""]) or "", rng.choice("fg")]
        rows.append(full if rng.random() < 0.8 else full[: rng.randint(1, 5)])
    rows += [["", " ", "\x1c", "", " "], [""]]
    return rows


def same(a, b):
    return repr(a) == repr(b) or abs(a - b) <= 1e-9 * max(abs(a), abs(b))


@pytest.mark.parametrize("unique", [False, True])
@pytest.mark.parametrize("fields", [(["r"], ["c"]), (["r"], []), ([], ["c", "d"]), (["r", "c"], ["d"])])
def test_pivot_matches_model(spark, fields, unique):
    rng = random.Random(6)
    header = ["r", "c", "d", "v", "f"]
    aggs = ["sum", "avg", "count", "max", "min"]
    tables = {f"t{i}": pivot_rows(rng, rng.randint(0, 40)) for i in range(15)}
    flat = [(t, i, *[model.cell(row, j) for j in range(5)]) for t, rows in tables.items() for i, row in enumerate(rows)]
    df = spark.createDataFrame(flat, "source_file string, row_id long, " + ", ".join(f"{h} string" for h in header))
    spec = PivotSpec(tuple(fields[0]), tuple(fields[1]), tuple(("v", a) for a in aggs), remove_duplicates=unique)
    got = {}
    for row in pivot_long(df, spec, "f", ["f"], by=[SOURCE_FILE]).collect():
        key = (row.source_file, tuple(row)[1 : 1 + max(1, len(fields[0]))], row.col_key, row.metric[2:])
        got.setdefault(key, []).append(row.value)
    want = {}
    for t, rows in tables.items():
        for (r, c), values in model.pivot(header, rows, *fields, [("v", a) for a in aggs], ("f", ["f"]), unique).items():
            for a, v in zip(aggs, values):
                want.setdefault((t, r, " / ".join(c), a), []).append(v)
    assert got.keys() == want.keys()
    for key in want:
        pairs = zip(sorted(got[key], key=repr), sorted(want[key], key=repr))
        assert all(same(a, b) for a, b in pairs), key


def test_wide_pivot(spark):
    rows = [("r1", "a / b", "c", "1"), ("r1", "a", "b / c", "2"), ("r2", "a", "b / c", "nan"), ("r3", 'q"\\', "\x01", "4")]
    df = spark.createDataFrame(rows, "r string, c string, d string, v string")
    spec = PivotSpec(("r",), ("c", "d"), (("v", "Сумма"), ("v", "Сумма"), ("v", "count")))
    out = pivot_wide(df, spec)
    keys = sorted({(c, d) for _, c, d, _ in rows})
    assert out.columns == ["r", *[f"{c} / {d} - v ({a})" for c, d in keys for a in ("Сумма", "count")]]
    found = {row[0]: [repr(x) for x in tuple(row)[1:]] for row in out.collect()}
    for r in ("r1", "r2", "r3"):
        want = []
        for key in keys:
            xs = [model.number(v) for q, c, d, v in rows if (q, (c, d)) == (r, key)]
            want += [repr(float(sum(xs))), repr(float(len(xs)))]
        assert found[r] == want
    with pytest.raises(ValueError):
        pivot_wide(df, spec, max_columns=2)


def test_pivot_validation(spark):
    df = spark.createDataFrame([("r", "1")], "r string, v string")
    for bad in ({}, {"rows": ("r",)}, {"values": (("v", "sum"),)}, {"rows": ("r",), "values": (("v", "median"),)}):
        with pytest.raises(ValueError):
            PivotSpec(**bad)
    with pytest.raises(ValueError):
        pivot_long(df, PivotSpec(("zzz",), (), (("v", "sum"),)))
    with pytest.warns(UserWarning):
        rows = pivot_long(df, PivotSpec(("r",), (), (("zzz", "sum"), ("v", "sum")))).collect()
    assert {r.metric: r.value for r in rows} == {"zzz_sum": 0.0, "v_sum": 1.0}


# ------------------------------------------------------------------ inspection


def test_distinct_values(spark):
    df = spark.createDataFrame([("b", "1"), ("a", None), (" ", "1"), ("c", "2"), (None, "1"), ("Z", "")], "v string, f string")
    assert [r.value for r in distinct_values(df, "v").collect()] == ["Z", "a", "b", "c"]
    assert [r.value for r in distinct_values(df, "v", "f", ["1"]).collect()] == ["a", "b"]
    with pytest.warns(UserWarning):
        assert distinct_values(df, "zzz").count() == 0


def test_pages(spark, monkeypatch):
    df = column(spark, [str(i) for i in range(23)]).repartition(5)
    tied = spark.createDataFrame([(i % 2, None if i % 3 else i % 5) for i in range(40)] * 2, "k int, v int").repartition(7)
    seen = []
    for limit in (10_000, 0):
        monkeypatch.setattr(inspect, "TOP_ROWS", limit)
        seen.append([[tuple(r) for r in page(tied, p, 9, ["k"]).collect()] for p in range(1, 11)])
        assert Counter(r for p in seen[-1] for r in p) == Counter(tuple(r) for r in tied.collect())
        gaps = df.filter("v not in ('0', '7')")
        assert [r.v for r in page(gaps, 2, 5).collect()] == ["6", "8", "9", "10", "11"]
        assert [r.v for r in page(df, 9, 5).collect()] == []
        pages = [[r.v for r in page(df, p, 5, ["row_id"]).collect()] for p in range(1, 7)]
        assert [v for p in pages for v in p] == [str(i) for i in range(23)] and pages[5] == []
        assert [r.v for r in page(df, 2, 5).collect()] == ["5", "6", "7", "8", "9"]
    assert seen[0] == seen[1]
    assert tuple(page_info(df, 5).first()) == (23, 5)
    assert tuple(page_info(df.filter("v = 'x'"), 5).first()) == (0, 1)


def test_search(spark):
    rows = [(i, a, b) for i, (a, b) in enumerate([("x", "y"), ("Найти", None), ("q", "НАЙТИ"), ("", "z"), ("найти!", "n")])]
    df = spark.createDataFrame(rows, "row_id long, a string, b string").repartition(3)
    found = lambda column: sorted(r.row_pos for r in search_rows(df, "найти", column).collect())
    assert found(None) == [1, 2, 4] and found("a") == [1, 4] and found("b") == [2] and found("zzz") == [1, 2, 4]
    assert tuple(search_summary(df, "найти", 2, "b").first()) == (1, 2)
    assert tuple(search_summary(df, "nothing", 2).first()) == (0, None)
    marked = {r.row_id: r.matched_columns for r in mark_cells(df, "n").collect()}
    assert marked == {0: [], 1: [], 2: [], 3: [], 4: ["b"]}


def test_counts_and_metrics(spark):
    df = spark.createDataFrame([("a", "1"), ("a", "1"), ("b", None), (" ", "1"), ("c", "9")], "k string, f string")
    assert count_rows(df, "f", ["1"]).first()[0] == 4
    spec = ExportSpec(filter_column="f", filter_values=("1",), file_split_column="k", selected_columns=("k",))
    row = export_metrics(df, spec, "id").first()
    assert tuple(row) == ("id", 5, 3, 2, 1, 1)


def test_forecast_ranks(spark):
    counts = [("f1", "s1", 5), ("f1", "s2", 5), ("f2", "s1", 10), ("f3", "x", 1), ("f0", "a", 30)]
    df = spark.createDataFrame(counts, "dest_file string, dest_sheet string, n_rows long")
    got = {(r.dest_file, r.dest_sheet): (r.file_total, r.file_rank, r.sheet_rank) for r in rank_forecast(df).collect()}
    assert got == {
        ("f0", "a"): (30, 1, 1),
        ("f1", "s1"): (10, 2, 1),
        ("f1", "s2"): (10, 2, 2),
        ("f2", "s1"): (10, 3, 1),
        ("f3", "x"): (1, 4, 1),
    }


# ------------------------------------------------------------------ job description


def test_spec_rules():
    spec = ExportSpec(file_split_column="k", sheet_split_column="s", filter_column="zzz", selected_columns=("a",))
    with pytest.warns(UserWarning):
        known = spec.normalise(["k", "s", "a"])
    assert known.filter_column == "" and known.sheet_split_column == "s"
    with pytest.raises(ValueError):
        spec.normalise(["k", "s", "a"], strict=True)
    csv = ExportSpec(output_format="csv", file_split_column="zzz", sheet_split_column="s", sheet_split_values=("x",))
    with pytest.warns(UserWarning):
        moved = csv.normalise(["s"])
    assert (moved.file_split_column, moved.file_split_values, moved.sheet_split_column) == ("s", ("x",), "")
    assert spec.removes_duplicates(["k", "s", "a"]) and not spec.removes_duplicates(["a"])
    pivot = PivotSpec(("k",), (), (("a", "sum"),))
    job = ExportSpec(file_split_column="k", filter_column="a", filter_values=("1",), pivot=pivot)
    narrowed = job.select(["a", "s"])
    assert (narrowed.file_split_column, narrowed.filter_values, narrowed.pivot) == ("", ("1",), None)
    carried = ExportSpec(selected_columns=("b", "a"), filter_column="c", pivot=pivot).carry_to(["a", "b", "d"])
    assert carried.selected_columns == ("b", "a", "d") and carried.filter_column == "" and carried.pivot is pivot
    assert ExportSpec(filter_column="a", pivot=pivot).carry_to([]) == ExportSpec()


# ------------------------------------------------------------------ invariance and plans


def test_results_do_not_depend_on_partitioning(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice("xyz"), str(rng.randint(0, 4))) for i in range(300)]
    df = spark.createDataFrame(rows, "row_id long, k string, a string")
    spec = ExportSpec(file_split_column="k", selected_columns=("a",))
    results = set()
    for n, shuffles in ((1, "1"), (7, "3"), (16, "16")):
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)
        results.add(json.dumps(sorted(map(list, shape(df.repartition(n), spec).collect()))))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(results) == 1


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    spec = ExportSpec(
        filter_column="o_orderstatus", filter_values=("F",), file_split_column="o_orderpriority", selected_columns=("o_custkey",)
    )
    plan = plan_of(shape(orders, spec))
    assert "PushedFilters: [" in plan and "o_orderstatus" in plan.split("PushedFilters: [")[1].split("]")[0]
    assert plan.count("Exchange") == 1 and "o_totalprice" not in plan and "Python" not in plan
    assert "SinglePartition" not in plan
