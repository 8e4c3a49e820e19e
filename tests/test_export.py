import csv
import os
import random
import zipfile
from collections import defaultdict
from xml.etree import ElementTree

import pytest
import model
from rowforge.columns import ROW_ID, SOURCE_FILE
from rowforge.operators import filter_in, forecast, shape
from rowforge.plans.export import export, export_batch, write_pivot
from rowforge.runtime import scratch_dir, scratch_scope
from rowforge.plans.spec import ExportSpec, PivotSpec
from rowforge.sinks.csv import write_csv

HEADER = ["k", "s", "a", "b"]
NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def random_rows(rng, n):
    rows = []
    for _ in range(n):
        full = [rng.choice(v) for v in (["x", "y", "z", " ", "", "Остальные"], ["p", "q", " ", "r"], "12", "123")]
        rows.append(full if rng.random() < 0.85 else full[: rng.randint(1, 4)])
    return rows


@pytest.fixture(scope="module")
def cases(spark):
    """Many small random tables in one frame: each is a source file of its own."""
    rng = random.Random(11)
    tables = {f"case{i:03d}": random_rows(rng, rng.randint(0, 25)) for i in range(60)}
    flat = [
        (name, i, *[model.cell(row, j) for j in range(4)]) for name, rows in tables.items() for i, row in enumerate(rows)
    ]
    df = spark.createDataFrame(flat, "source_file string, row_id long, k string, s string, a string, b string")
    return tables, df.repartition(5).cache()


SPECS = {
    "plain": {},
    "filter": {"flt": ("k", ["x", "y"])},
    "files": {"files": ("k", [])},
    "others": {"files": ("k", ["x"]), "flt": ("s", ["p", "q"])},
    "two_level": {"files": ("k", ["x", "y"]), "sheets": ("s", ["p"])},
    "sheets_dedup": {"sheets": ("k", ["x"]), "selected": ["b", "a"]},
    "files_dedup": {"files": ("k", ["z"]), "sheets": ("s", []), "selected": ["a"]},
    "no_dedup": {"files": ("k", ["z"]), "selected": ["a"], "dedup": False},
    "all_selected": {"selected": ["b", "a", "s", "k"]},
    "unknown_selected": {"selected": ["nope"]},
    "partly_unknown": {"selected": ["b", "nope"], "flt": ("nope", ["1"])},
}


def spec_of(flt=None, files=None, sheets=None, selected=(), dedup=True, **more):
    return ExportSpec(
        filter_column=flt[0] if flt else "",
        filter_values=flt[1] if flt else (),
        file_split_column=files[0] if files else "",
        file_split_values=files[1] if files else (),
        sheet_split_column=sheets[0] if sheets else "",
        sheet_split_values=sheets[1] if sheets else (),
        selected_columns=tuple(selected),
        deduplicate_rows=dedup,
        **more,
    )


@pytest.mark.filterwarnings("ignore")
@pytest.mark.parametrize("name", SPECS)
def test_shape_matches_model_in_order(cases, name):
    tables, df = cases
    got = defaultdict(list)
    for row in shape(df, spec_of(**SPECS[name])).orderBy(SOURCE_FILE, ROW_ID).collect():
        got[row.source_file].append((row.dest_file, row.dest_sheet, tuple(row)[4:]))
    for table, rows in tables.items():
        assert got[table] == model.export(HEADER, rows, **SPECS[name]), table


def test_forecast_counts_duplicates_once_over_all_files(cases):
    tables, df = cases
    config = SPECS["files_dedup"]
    rows = [row for table in tables.values() for row in table]
    want = defaultdict(int)
    for file, sheet, _ in model.export(HEADER, rows, **config):
        want[file, sheet] += 1
    got = {(r.dest_file, r.dest_sheet): r.n_rows for r in forecast(df, spec_of(**config)).collect()}
    assert got == want


def read_workbook(path):
    """{sheet name: rows of (text, is number)}"""
    sheets = {}
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        for i, sheet in enumerate(book.find(f"{NS}sheets"), 1):
            rows = []
            for row in ElementTree.fromstring(z.read(f"xl/worksheets/sheet{i}.xml")).iter(f"{NS}row"):
                assert int(row.get("r")) == len(rows) + 1
                rows.append(
                    [c.findtext(f"{NS}is/{NS}t") or c.findtext(f"{NS}v") or "" for c in row.iter(f"{NS}c")]
                )
            sheets[sheet.get("name")] = rows
    return sheets


def read_csv_outputs(folder):
    """{file name: [header, *rows]} over the ordered part files of each output."""
    outputs = {}
    for entry in sorted(os.listdir(folder)):
        if not entry.startswith("file_name="):
            continue
        parts = sorted(p for p in os.listdir(f"{folder}/{entry}") if p.endswith(".csv"))
        rows = []
        for part in parts:
            with open(f"{folder}/{entry}/{part}", encoding="utf-8", newline="") as f:
                text = f.read()
            assert text.startswith("﻿")
            header, *body = csv.reader(text[1:].splitlines(keepends=True), delimiter=";")
            rows += body
        outputs[entry.removeprefix("file_name=")] = [header, *rows]
    return outputs


def test_workbooks_match_model(cases, tmp_path):
    tables, df = cases
    config = SPECS["two_level"]
    out = str(tmp_path / "books")
    manifest = export(df, spec_of(**config), out, "run", cap=4).collect()
    files = {name for name in os.listdir(out)}
    assert files == {r.file_name for r in manifest}
    books = {name: read_workbook(f"{out}/{name}") for name in files}
    got = defaultdict(list)
    for r in sorted(manifest, key=lambda r: (r.file_name, r.dest_sheet, r.sheet_part)):
        header, *rows = books[r.file_name][r.sheet_name]
        assert header == HEADER and len(rows) == r.n_rows <= 4
        got[r.source_file, r.dest_file, r.dest_sheet] += rows
    want = defaultdict(list)
    for table, rows in tables.items():
        for file, sheet, cells in model.export(HEADER, rows, **config):
            want[table, file, sheet].append(list(cells))
    assert got == want


def test_unsplit_workbook_rolls_over_with_names(spark, tmp_path):
    rows = [("f.csv", i, str(i)) for i in range(25)]
    df = spark.createDataFrame(rows, "source_file string, row_id long, v string")
    out = str(tmp_path / "o")
    manifest = export(df, ExportSpec(), out, "r", cap=10).orderBy("sheet_part").collect()
    assert [(m.sheet_name, m.n_rows) for m in manifest] == [
        ("Все проекты", 10),
        ("Все проекты_2", 10),
        ("Все проекты_3", 5),
    ]
    book = read_workbook(f"{out}/f (conver_r).xlsx")
    assert [r[0] for s in ("Все проекты", "Все проекты_2", "Все проекты_3") for r in book[s][1:]] == [
        str(i) for i in range(25)
    ]


def test_long_destination_goes_on_in_next_workbook(spark, tmp_path):
    df = spark.createDataFrame([("f.csv", i, "h", str(i)) for i in range(40)], "source_file string, row_id long, k string, v string")
    out = str(tmp_path / "o")
    manifest = export(df, ExportSpec(file_split_column="k"), out, "r", cap=10, workbook_rows=22).collect()
    assert sorted({m.file_name for m in manifest}) == ["f (conver_r).part2_h.xlsx", "f (conver_r)_h.xlsx"]
    found = [row[1] for name in os.listdir(out) for s in read_workbook(f"{out}/{name}").values() for row in s[1:]]
    assert sorted(map(int, found)) == list(range(40))


def test_cell_texts_survive_the_workbook(spark, tmp_path):
    texts = ["=1+1", "http://x", "<&>\"'", " pad ", "a\nb", "a\r\nb", "\x01", "_x0041_", "Жя", "😀", "", "x" * 40_000]
    df = spark.createDataFrame([("t.csv", i, v) for i, v in enumerate(texts)], "source_file string, row_id long, v string")
    out = str(tmp_path / "o")
    export(df, ExportSpec(sheet_label="S"), out, "r")
    (name,) = os.listdir(out)
    rows = read_workbook(f"{out}/{name}")["S"][1:]

    def decoded(text):
        import re

        return re.sub("_x([0-9A-F]{4})_", lambda m: chr(int(m[1], 16)), text)

    assert [decoded(r[0]) for r in rows] == texts


def test_csv_files_match_model(cases, tmp_path):
    tables, df = cases
    config = SPECS["others"]
    out = str(tmp_path / "csv")
    spec = spec_of(**config, output_format="csv")
    manifest = export(df, spec, out, "run").collect()
    outputs = read_csv_outputs(out)
    assert set(outputs) == {m.file_name for m in manifest}
    want = defaultdict(list)
    for table, rows in tables.items():
        for file, _, cells in model.export(HEADER, rows, **config):
            want[table, file].append(list(cells))
    assert {(m.source_file, m.dest_file): outputs[m.file_name][1:] for m in manifest} == want
    assert all(rows[0] == HEADER for rows in outputs.values())


def test_csv_texts_round_trip(spark, tmp_path):
    rng = random.Random(3)
    alphabet = ["a", "Я", " ", '"', ",", ";", "\t", "\n", "\r", "\\", "#", "'"]
    rows = [tuple("".join(rng.choices(alphabet, k=rng.randint(0, 5))) for _ in range(3)) for _ in range(400)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row_id long, a string, b string, c string")
    out = str(tmp_path / "c")
    write_csv(df.coalesce(1), out)
    got = []
    for part in sorted(p for p in os.listdir(out) if p.endswith(".csv")):
        with open(f"{out}/{part}", encoding="utf-8-sig", newline="") as f:
            got += [tuple(r) for r in csv.reader(f, delimiter=";")][1:]
    assert got == rows


def test_single_empty_column_keeps_its_rows(spark, tmp_path):
    df = spark.createDataFrame([(0, "a"), (1, ""), (2, None), (3, "b")], "row_id long, v string")
    out = str(tmp_path / "c")
    write_csv(df, out)
    text = "".join(open(f"{out}/{p}", encoding="utf-8").read() for p in sorted(os.listdir(out)) if p.endswith(".csv"))
    assert text.count("\n") - text.count("﻿v") == 4 and '""\n""\n' in text.replace("﻿v\n", "")


PIVOT = PivotSpec(("k",), ("s",), (("b", "Сумма"), ("b", "Количество")))


def test_pivot_outputs(cases, tmp_path):
    tables, df = cases
    want = {t: model.pivot(HEADER, rows, ["k"], ["s"], [("b", "sum"), ("b", "count")]) for t, rows in tables.items()}
    out = str(tmp_path / "x")
    export(df, ExportSpec(pivot=PIVOT, sheet_split_column="k"), out, "r")
    by_table = {}
    for i, table in enumerate(sorted(t for t, rows in tables.items() if rows)):
        path = f"{out}/{table}{f'_{i + 1}' if i else ''} (conver_r).xlsx"
        by_table[table] = read_workbook(path)
    for table, groups in want.items():
        if not groups:
            continue
        sheets = by_table[table]
        assert list(sheets)[-1] == "Сводная таблица"
        header, *rows = sheets["Сводная таблица"]
        keys = sorted({c for _, c in groups})
        assert header == ["k", *[f"{c[0]} - b ({a})" for c in keys for a in ("Сумма", "Количество")]]
        assert [r[0] for r in rows] == [r[0] for r in sorted({r for r, _ in groups})]
        for row in rows:
            flat = [x for c in keys for x in groups.get(((row[0],), c), [0.0, 0.0])]
            assert [float(x) for x in row[1:]] == flat
    out = str(tmp_path / "c")
    export(df, ExportSpec(output_format="csv", pivot=PIVOT), out, "r")
    outputs = read_csv_outputs(out)
    table = next(t for t in want if len(want[t]) > 3)
    name = next(n for n in outputs if n.startswith(table) and n.endswith("Сводная таблица.csv"))
    header, *rows = outputs[name]
    assert header == ["k", "Колонка", "Метрика", "Значение"]
    flat = []
    for (r, c), (total, count) in sorted(want[table].items()):
        flat += [[r[0], c[0], "b_Количество", str(int(count))], [r[0], c[0], "b_Сумма", repr(total)]]
    assert rows == flat


def test_pivot_sheet_avoids_taken_name(spark, tmp_path):
    rows = [("f.csv", 0, "Сводная таблица", "1"), ("f.csv", 1, "сводная таблица_4", "2")]
    df = spark.createDataFrame(rows, "source_file string, row_id long, k string, b string")
    out = str(tmp_path / "o")
    export(df, ExportSpec(sheet_split_column="k", pivot=PivotSpec(("k",), (), (("b", "sum"),))), out, "r")
    (name,) = os.listdir(out)
    assert list(read_workbook(f"{out}/{name}")) == ["Сводная таблица", "сводная таблица_4", "Сводная таблица_5"]


def test_pivot_with_too_many_columns_is_long(spark, tmp_path, monkeypatch):
    rows = [("a.csv", i, f"r{i % 2}", f"c{i}", str(i)) for i in range(5)] + [("b.csv", i, "r", f"c{i}", "1") for i in range(2)]
    df = spark.createDataFrame(rows, "source_file string, row_id long, k string, s string, b string")
    monkeypatch.setattr("rowforge.operators.pivot.pivot_grid.__defaults__", ("", (), ("source_file",), 3))
    out = str(tmp_path / "o")
    with pytest.warns(UserWarning, match="long form"):
        export(df, ExportSpec(pivot=PIVOT, selected_columns=("k", "b"), deduplicate_rows=False), out, "r")
    sheets = read_workbook(f"{out}/a (conver_r).xlsx")
    assert len(sheets["Все проекты"]) == 6
    header, *body = sheets["Сводная таблица"]
    assert header == ["k", "Колонка", "Метрика", "Значение"]
    assert [r[:3] for r in body[:2]] == [["r0", "c0", "b_Количество"], ["r0", "c0", "b_Сумма"]] and len(body) == 10
    assert [float(r[3]) for r in body[:2]] == [1.0, 0.0]
    assert len(read_workbook(f"{out}/b_2 (conver_r).xlsx")["Сводная таблица"][0]) == 5


def test_write_pivot(spark, tmp_path):
    df = spark.createDataFrame([("x", "c", 1.0), ("y", "d", 2.5), ("x", "d", 4.0)], "k string, s string, b double")
    write_pivot(df, PIVOT, str(tmp_path / "o"), "p.xlsx", "k", ["x", "y"], cap=1)
    sheets = read_workbook(str(tmp_path / "o" / "p.xlsx"))
    assert list(sheets) == ["Сводная таблица", "Сводная таблица_1"]
    first, second = sheets.values()
    assert first[0] == second[0] and [first[1][0], second[1][0]] == ["x", "y"]
    assert [float(c) for c in first[1][1:]] == [1.0, 1.0, 4.0, 1.0] and [float(c) for c in second[1][1:]] == [0.0, 0.0, 2.5, 1.0]


def test_pivot_sheets_past_a_workbook_go_on_in_the_next(spark, tmp_path):
    df = spark.createDataFrame([(f"k{i}", "c", 1.0) for i in range(5)], "k string, s string, b double")
    out = str(tmp_path / "o")
    export(df, ExportSpec(pivot=PIVOT, file_split_column="s"), out, "r", cap=2, workbook_rows=6)
    sheets = {name: list(read_workbook(f"{out}/{name}")) for name in sorted(os.listdir(out)) if "Сводная" in name}
    title = "Сводная таблица"
    assert sheets == {
        f"export (conver_r)_{title}.xlsx": [title, f"{title}_1"],
        f"export (conver_r).part2_{title}.xlsx": [f"{title}_2"],
    }


def test_unsplit_csv_without_rows_has_a_header(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "one.csv").write_text("k;v\nx;1\n", encoding="utf-8")
    (src / "two.csv").write_text("k;v\ny;2\n", encoding="utf-8")
    (src / "three.csv").write_text("k;w\n", encoding="utf-8")
    spec = ExportSpec(output_format="csv", filter_column="k", filter_values=("x",))
    manifest = export_batch(spark, str(src), spec, str(tmp_path / "o"), "r").collect()
    assert {m.file_name: m.n_rows for m in manifest} == {"one (conver_r).csv": 1, "three_2 (conver_r).csv": 0, "two_3 (conver_r).csv": 0}
    outputs = read_csv_outputs(str(tmp_path / "o"))
    assert outputs == {"one (conver_r).csv": [["k", "v"], ["x", "1"]], "three_2 (conver_r).csv": [["k", "w"]], "two_3 (conver_r).csv": [["k", "v"]]}
    df = spark.createDataFrame([("y", 1)], "k string, v int")
    export(df, spec, str(tmp_path / "t"), "r")
    assert read_csv_outputs(str(tmp_path / "t")) == {"export (conver_r).csv": [["k", "v"]]}


def test_scratch_scope_deletes_what_jobs_store(spark, tmp_path):
    base = scratch_dir(spark, "any").rsplit("/", 1)[0].removeprefix("file:")
    os.makedirs(base, exist_ok=True)
    before = set(os.listdir(base))
    df = spark.createDataFrame([("y", 1)], "k string, v int")
    with scratch_scope(spark):
        export(df, ExportSpec(output_format="csv", file_split_column="k"), str(tmp_path / "o"), "r")
        assert set(os.listdir(base)) > before
    assert set(os.listdir(base)) == before
    assert read_csv_outputs(str(tmp_path / "o"))


def test_batch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "one.csv").write_text("k;v\nx;1\ny;2\nx;1\n", encoding="utf-8")
    (src / "two.txt").write_bytes("k\tw\tимя\nx\t5\tю\n".encode("cp1251"))
    (src / "none.csv").write_text("")
    out = str(tmp_path / "out")
    spec = ExportSpec(output_format="csv", file_split_column="k", selected_columns=("v", "имя"))
    with pytest.warns(UserWarning):
        manifest = export_batch(spark, str(src), spec, out, "r").collect()
    rows = {(os.path.basename(m.source_file), m.dest_file): (m.n_rows, m.file_name, m.error) for m in manifest}
    assert rows == {
        ("one.csv", "x"): (1, "one (conver_r)_x.csv", None),
        ("one.csv", "y"): (1, "one (conver_r)_y.csv", None),
        ("two.txt", "x"): (1, "two_2 (conver_r)_x.csv", None),
        ("none.csv", None): (None, None, "no line read"),
    }
    outputs = read_csv_outputs(out)
    assert outputs["two_2 (conver_r)_x.csv"] == [["имя"], ["ю"]]
    assert outputs["one (conver_r)_x.csv"] == [["v"], ["1"]]


def test_file_that_breaks_off_leaves_others(spark, tmp_path):
    jvm, source = spark._jvm.org.apache.hadoop.fs, tmp_path / "in"
    files = jvm.FileSystem.getLocal(spark._jsc.hadoopConfiguration())
    for name in ("a", "b", "c"):
        made = tmp_path / f"{name}.csv"
        made.write_text("k,v\n" + "".join(f"{name},{i}\n" for i in range(100_000)))
        files.copyFromLocalFile(jvm.Path(str(made)), jvm.Path(str(source / f"{name}.csv")))
    with (source / "b.csv").open("r+b") as f:  # its check sums no longer hold near the end
        f.seek(-10, 2)
        f.write(b"?")
    result = export_batch(spark, str(source), spec_of(output_format="csv"), str(tmp_path / "out"), "r1", skip_unreadable=True)
    rows = {r.source_file[-5:]: (r.n_rows, r.error) for r in result.collect()}
    assert rows.keys() == {"a.csv", "b.csv", "c.csv"}
    assert rows["a.csv"] == rows["c.csv"] == (100_000, None)
    assert rows["b.csv"][0] is None and "hecksum" in rows["b.csv"][1]


def test_odd_headers(spark, tmp_path):
    header = ["a b,{}()=", "x.y", "`q`", "", "x.y", "X.Y", "row_id", "file_name"]
    src = tmp_path / "odd.csv"
    with open(src, "w", encoding="utf-8", newline="") as f:
        csv.writer(f, delimiter=";").writerows([header, list("12345678"), list("12345679"), list("92345678")])
    pivot = PivotSpec(("x.y",), ("`q`",), (("X.Y", "sum"), ("row_id", "max")))
    config = {"selected": ["X.Y", "`q`", "", "x.y", "row_id", "file_name"], "files": ("a b,{}()=", [])}
    rows = [list("12345678"), list("12345679"), list("92345678")]
    want = [list(cells) for _, _, cells in model.export(header, rows, **config)]
    for fmt in ("xlsx", "csv"):
        out = str(tmp_path / fmt)
        manifest = export_batch(spark, str(src), spec_of(**config, output_format=fmt, pivot=pivot), out, "r").collect()
        manifest.sort(key=lambda m: m.dest_file)
        assert [m.error for m in manifest] == [None, None]
        if fmt == "xlsx":
            found = [r for m in manifest for r in read_workbook(f"{out}/{m.file_name}")[m.sheet_name]]
            assert read_workbook(f"{out}/odd (conver_r)_Сводная таблица.xlsx") == {
                "Сводная таблица": [["x.y", "3 - X.Y (sum)", "3 - row_id (max)"], ["2", "18.0", "7.0"]]
            }
        else:
            found = [r for m in manifest for r in read_csv_outputs(out)[m.file_name]]
            # Names that differ in case only, and the name of the folder column, carry their position.
            assert found[0] == ["X.Y#5", "`q`", "", "x.y", "row_id", "file_name#7"]
            found = [[cell.split("#")[0] for cell in row] for row in found]
        assert found == [config["selected"], want[0], want[1], config["selected"], want[2]]


def test_line_ends_and_parquet(spark, tmp_path):
    df = spark.createDataFrame([(0, "a", "1"), (1, "b", None)], "row_id long, k string, v string")
    write_csv(df, str(tmp_path / "c"), crlf=True)
    (text,) = [p.read_bytes() for p in (tmp_path / "c").glob("*.csv") if p.stat().st_size]
    assert text == "\ufeffk;v\r\na;1\r\nb;\r\n".encode()
    out = str(tmp_path / "p")
    spec = ExportSpec(output_format="parquet", file_split_column="k")
    for _ in range(2):
        export(df.drop("row_id"), spec, out, "r", order_by=["v"], mode="overwrite")
    back = spark.read.parquet(out)
    assert sorted((r.k, r.v, r.file_name) for r in back.collect()) == [
        ("a", "1", "export (conver_r)_a.parquet"),
        ("b", "", "export (conver_r)_b.parquet"),
    ]


def test_repeated_runs_give_equal_workbooks(spark, tmp_path):
    df = spark.createDataFrame([(i, "ab"[i % 2], str(i)) for i in range(50)], "row_id long, k string, v string")
    contents = []
    for run in ("one", "two"):
        out = str(tmp_path / run)
        export(df.repartition(3 if run == "one" else 7), ExportSpec(file_split_column="k"), out, "r", order_by=["row_id"])
        contents.append({n: open(f"{out}/{n}", "rb").read() for n in sorted(os.listdir(out))})
    assert contents[0] == contents[1]


def test_engine_names_and_typed_cells_are_kept(spark, tmp_path):
    df = spark.sql(
        "SELECT 7L AS row_id, 'x' AS sheet_row, TIMESTAMP '2024-01-02 03:04:05.123456' AS t, array(1, 2) AS l, 1 AS v"
    )
    export(df, ExportSpec(output_format="csv"), str(tmp_path / "out"), run_id="r")
    text = "".join(p.read_text("utf-8-sig") for p in (tmp_path / "out").rglob("part-*.csv"))
    assert text.splitlines() == ["row_id;sheet_row;t;l;v", "7;x;2024-01-02 03:04:05.123456;[1,2];1"]


def test_whole_number_filters_reach_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    kept = filter_in(df, "l_linenumber", ["1", "3", "03", "x"])
    assert "PushedFilters: [In(l_linenumber, [1,3])]" in kept._jdf.queryExecution().executedPlan().toString()
    assert kept.count() == df.filter("l_linenumber IN (1, 3)").count()
    assert filter_in(df, "l_linenumber", ["x"]).count() == 0
