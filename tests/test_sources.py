import csv
import os
import random

import pytest
from pyspark.sql import functions as F

import model
from rowforge.operators import filter_in, page, pivot_long, search_rows, search_summary
from rowforge.plans.spec import PivotSpec
from rowforge.sources.delimited import batch_total, profile_batch, read_batch, read_delimited, read_dialect
from rowforge.sources.profile import profile_files


def put(folder, name, text, encoding="utf-8", bom=False):
    path = folder / name
    path.write_bytes((("﻿" if bom else "") + text).encode(encoding))
    return str(path)


def base(path):
    return os.path.basename(path)


@pytest.fixture(scope="module")
def fleet(tmp_path_factory):
    d = tmp_path_factory.mktemp("fleet a+b")
    put(d, "enc_utf8.csv", "имя;город\nа;б\n")
    put(d, "enc_bom.csv", "name;city\nа;б\n", bom=True)
    put(d, "enc_cp1251.csv", "имя;город\nпривет;мир\n", "cp1251")
    put(d, "enc_cp1251_late.csv", "id;name\n" + "1;a\n" * 10000 + "2;ё\n", "cp1251")
    for e in ("utf-16-le", "utf-16-be", "utf-32-le", "utf-32-be"):
        put(d, f"enc_{e}.txt", "a;б\n1;ж\n", e, bom=True)
    put(d, "delim_tie.txt", "a\tb;c\n1\t2\n")
    put(d, "delim_none.csv", "a\n1\n")
    put(d, "delim_none.txt", "a\n1\n")
    put(d, "delim_quoted.csv", '"x;y;z",b\n1;2\n')
    put(d, "upper.TSV", "p\tq\n1\t2\n")
    put(d, "header_only.csv", "a,b\n")
    put(d, "empty.csv", "")
    put(d, "other.dat", "a,b\n1,2\n")
    return str(d)


def test_profile(spark, fleet):
    rows = {base(r.source_file): r for r in profile_files(spark, [fleet]).collect()}
    assert "other.dat" not in rows
    expected = {
        "enc_utf8.csv": ("utf-8", ";", "имя;город"),
        "enc_bom.csv": ("utf-8", ";", "name;city"),
        "enc_cp1251.csv": ("windows-1251", ";", "имя;город"),
        "enc_cp1251_late.csv": ("windows-1251", ";", "id;name"),
        "enc_utf-16-le.txt": ("utf-16-le", ";", "a;б"),
        "enc_utf-16-be.txt": ("utf-16-be", ";", "a;б"),
        "enc_utf-32-le.txt": ("utf-32-le", ";", "a;б"),
        "enc_utf-32-be.txt": ("utf-32-be", ";", "a;б"),
        "delim_tie.txt": ("utf-8", "\t", "a\tb;c"),
        "delim_none.csv": ("utf-8", ",", "a"),
        "delim_none.txt": ("utf-8", "\t", "a"),
        "delim_quoted.csv": ("utf-8", ";", '"x;y;z",b'),
        "upper.TSV": ("utf-8", "\t", "p\tq"),
    }
    for name, want in expected.items():
        r = rows[name]
        assert (r.encoding, r.delimiter, r.header_line) == want, name
    assert rows["empty.csv"].error == "no line read"


def test_batch_profile_and_total(spark, fleet):
    profile = profile_batch(spark, fleet)
    rows = {base(r.source_file): r for r in profile.collect()}
    assert "header_only.csv" not in rows
    assert rows["empty.csv"].error and rows["empty.csv"].n_rows is None
    assert rows["enc_cp1251_late.csv"].n_rows == 10001
    assert rows["enc_utf-16-be.txt"].headers == ["a", "б"]
    total = batch_total(profile).first()
    assert total.n_rows == sum(r.n_rows or 0 for r in rows.values())
    assert total.n_files == len(rows) - 1


@pytest.mark.parametrize(
    "name,encoding", [("enc_cp1251.csv", "cp1251"), ("enc_utf-16-le.txt", "utf-16-le"), ("enc_utf-32-be.txt", "utf-32-be")]
)
def test_encodings_read(spark, fleet, name, encoding):
    path = os.path.join(fleet, name)
    header, rows = model.read_rows(path, encoding, ";")
    (table,) = read_batch(spark, path)
    assert list(table.headers) == header
    assert [list(r)[2:] for r in table.df.collect()] == rows


def cells(table):
    return [tuple(r)[2:] for r in table.df.orderBy("row_id").collect()]


def test_ragged_and_quoted(spark, tmp_path):
    text = 'a,b,c\n1\n1,2\n1,2,3\n1,2,3,4\n,,\n"x ""q"", y",,"multi\nline"\n\n"p","",\n5" pipe,"a\\b",6" z\n"k,k"\n'
    path = put(tmp_path, "ragged.csv", text)
    (table,) = read_batch(spark, path)
    assert not table.splittable
    _, rows = model.read_rows(path, "utf-8", ",")
    assert cells(table) == [tuple(model.cell(r, i) for i in range(3)) for r in rows]
    assert profile_batch(spark, path).first().n_ragged == 5


def test_blank_lines(spark, tmp_path):
    path = put(tmp_path, "blank.csv", "a,b\n1,2\n\n3\n\n")
    (dropped,) = read_batch(spark, path, keep_blank_rows=False)
    assert cells(dropped) == [("1", "2"), ("3", None)]
    (kept,) = read_batch(spark, path)
    assert cells(kept) == [("1", "2"), (None, None), ("3", None), (None, None)]


def test_duplicate_header_resolves_to_first(spark, tmp_path):
    path = put(tmp_path, "dup.csv", "a,b,a,A\n1,2,3,4\n5,6,7,8\n")
    (table,) = read_batch(spark, path)
    assert table.headers == ("a", "b", "a", "A")
    assert [tuple(r)[2:] for r in filter_in(table.df, "a", ["1"]).collect()] == [("1", "2", "3", "4")]
    assert [tuple(r)[2:] for r in filter_in(table.df, "A", ["8"]).collect()] == [("5", "6", "7", "8")]


def test_line_ends_and_long_cell(spark, tmp_path):
    crlf = put(tmp_path, "crlf.csv", 'a,b\r\n1,"x\r\ny"\r\n2,"p\rq"\r\n3,' + "z" * 200_000 + "\r\n")
    (table,) = read_batch(spark, crlf)
    assert cells(table) == [("1", "x\ny"), ("2", "p\nq"), ("3", "z" * 200_000)]
    cr = put(tmp_path, "cr.csv", "a,b\r1,2\r3,4\r")
    assert cells(read_batch(spark, cr)[0]) == [("1", "2"), ("3", "4")]


def test_header_over_two_lines(spark, tmp_path):
    path = put(tmp_path, "two.csv", '"a\nx",b\n1,2\n')
    (table,) = read_batch(spark, path)
    assert table.headers == ("a\nx", "b")
    assert cells(table) == [("1", "2")]


def test_short_rows_pass_lenient_filters_only(spark, tmp_path):
    path = put(tmp_path, "short.csv", "a,b\n1\n2,\n3,x\n4,y\n")
    (table,) = read_batch(spark, path)
    kept = lambda mode: [r.a for r in filter_in(table.df, "b", ["x"], mode).orderBy("row_id").collect()]
    assert kept("drop") == ["3"]
    assert kept("keep") == ["1", "3"]
    counted = pivot_long(table.df, PivotSpec(("a",), (), (("a", "count"),)), "b", ["x"])
    assert sorted(r.a for r in counted.collect()) == ["1", "3"]


def test_splittable_file_keeps_order_over_blocks(spark, tmp_path):
    path = put(tmp_path, "big.csv", "k,v\n" + "".join(f'{i},"v {i}"\n' for i in range(40_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        (table,) = read_batch(spark, path)
        assert table.splittable and table.df.rdd.getNumPartitions() > 4
        rows = table.df.orderBy("row_id").select("k", "row_id").collect()
        assert [int(r.k) for r in rows] == list(range(40_000))
        assert len({r.row_id for r in rows}) == 40_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_union_by_name(spark, tmp_path):
    put(tmp_path, "one.csv", "a,b\n1,2\n")
    put(tmp_path, "two.tsv", "b\tc\n3\t4\n")
    rows = read_delimited(spark, str(tmp_path)).select("a", "b", "c").collect()
    assert sorted(map(tuple, rows), key=str) == sorted([("1", "2", None), (None, "3", "4")], key=str)


def test_random_files(spark, tmp_path):
    rng = random.Random(5)
    alphabet = ["a", "Я", " ", '"', ",", ";", "\t", "\n", "\\", "0", "''", "x y"]
    wanted = {}
    for i in range(24):
        encoding = rng.choice(["utf-8", "cp1251", "utf-16-le"])
        delimiter = rng.choice(",;\t")
        width = rng.randint(2, 5)
        path = tmp_path / f"f{i}.txt"
        with open(path, "w", encoding=encoding, newline="") as f:
            if encoding == "utf-16-le":
                f.write("﻿")
            out = csv.writer(f, delimiter=delimiter, quoting=rng.choice([csv.QUOTE_MINIMAL, csv.QUOTE_ALL]))
            out.writerow([f"Ж{j}" for j in range(width)])
            for _ in range(rng.randint(1, 30)):
                n = width if rng.random() < 0.8 else rng.randint(1, width + 2)
                out.writerow(["".join(rng.choices(alphabet, k=rng.randint(0, 4))) for _ in range(n)])
        header, rows = model.read_rows(path, encoding, delimiter)
        wanted[path.name] = sorted(str(tuple(model.cell(r, j) for j in range(width))) for r in rows)
    got = {}
    for table in read_batch(spark, str(tmp_path)):
        for row in table.df.collect():
            got.setdefault(base(row.source_file), []).append(str(tuple(row)[2:]))
    assert {k: sorted(v) for k, v in got.items()} == wanted


def test_profile_is_one_shuffle_without_python(spark, fleet):
    (table,) = read_batch(spark, os.path.join(fleet, "enc_utf8.csv"))
    plan = table.df.agg(F.count(F.lit(1)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_search_and_pages_in_file_order(spark, tmp_path):
    rows = [f"{i},{'Needle' if i % 701 == 5 else 'hay'} {i}" for i in range(9000)]
    path = put(tmp_path, "hay.csv", "a,b\n" + "\n".join(rows) + "\n")
    other = put(tmp_path, "other.csv", "a,b\nneedle,1\nx,NEEDLE\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32768")
    try:
        (table,) = read_batch(spark, [path, other])
        found = {(base(r.source_file), r.row_pos) for r in search_rows(table.df, "needle").collect()}
        want = {("hay.csv", i) for i in range(9000) if i % 701 == 5} | {("other.csv", 0), ("other.csv", 1)}
        assert found == want
        # Rows missing from a block: positions come from a sort instead.
        odd = table.df.filter("try_cast(a AS int) % 2 = 1 and source_file like '%hay%'")
        assert sorted(r.row_pos for r in search_rows(odd, "needle").collect()) == [
            i // 2 for i in range(9000) if i % 701 == 5 and i % 2
        ]
        one = read_dialect(spark, [path], "utf-8", ",", ["a", "b"], True)
        assert tuple(search_summary(one, "needle 706", 50).first()) == (1, 706 // 50 + 1)
        assert [r.a for r in page(one, 3, 100).collect()] == [str(i) for i in range(200, 300)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_rows_of_empty_cells_stay(spark, tmp_path):
    body = "a\tb\tc\n1\t2\t3\n\t\t\n\n4\t5\t6\n"
    plain = read_delimited(spark, put(tmp_path, "plain.tsv", body))
    rows = sorted((r.row_id, r.a, r.b, r.c) for r in plain.collect())
    assert [r[1:] for r in rows] == [("1", "2", "3"), ("", "", ""), (None, None, None), ("4", "5", "6")]
    blank = read_delimited(spark, put(tmp_path, "one.csv", "a\n  \nx\n"))
    assert sorted(r.a for r in blank.collect()) == ["  ", "x"]


def test_quotes_inside_plain_cells_do_not_stop_splitting(spark, tmp_path):
    (table,) = read_batch(spark, put(tmp_path, "inch.csv", 'a,b\n5" pipe,1\n"x, y",2\n'))
    assert table.splittable
    assert sorted((r.a, r.b) for r in table.df.collect()) == [('5" pipe', "1"), ("x, y", "2")]


def test_columns_that_differ_in_case_stay_apart(spark, tmp_path):
    (tmp_path / "m").mkdir()
    put(tmp_path, "m/one.csv", "a,A\n1,2\n")
    put(tmp_path, "m/two.csv", "A,b\n3,4\n")
    df = read_delimited(spark, str(tmp_path / "m"))
    labels = [f.metadata.get("label") for f in df.schema.fields if "label" in f.metadata]
    assert labels == ["a", "A", "b"]
    assert sorted(str(tuple(r)[2:]) for r in df.collect()) == ["('1', '2', None)", "(None, '3', '4')"]


def test_a_broken_byte_leaves_a_file_utf8(spark, tmp_path):
    good = "имя;город\nпривет;мир\nещё;раз\n".encode()
    (tmp_path / "mostly.csv").write_bytes(good + b"a\xff;b\n")
    (tmp_path / "older.csv").write_bytes("имя;город\nпривет;a\nabc;d\n".encode("cp1251"))
    found = {os.path.basename(r.source_file): r.encoding for r in profile_files(spark, [str(tmp_path)]).collect()}
    assert found == {"mostly.csv": "utf-8", "older.csv": "windows-1251"}
    rows = read_delimited(spark, str(tmp_path / "mostly.csv")).orderBy("row_id").collect()
    assert [tuple(r)[2:] for r in rows] == [("привет", "мир"), ("ещё", "раз"), ("a\ufffd", "b")]
