"""Records over several lines and blocks, against Python's own reader."""

import random

import model
import pytest
from pyspark.sql import functions as F

from rowforge.operators import count_rows
from rowforge.sources.delimited import profile_batch, read_batch, read_delimited
from rowforge.sources.records import join_lines


@pytest.fixture
def small_blocks(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "17000")
    spark.conf.set("spark.sql.files.openCostInBytes", "17000")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def by_file(tables):
    found = {}
    for table in tables:
        for row in table.df.orderBy("source_file", "row_id").collect():
            found.setdefault(row.source_file.rsplit("/", 1)[-1], []).append(tuple(row)[2:])
    return found


def wanted(path, encoding, delimiter):
    header, rows = model.read_rows(path, encoding, delimiter)
    return [tuple(model.cell(r, i) for i in range(len(header))) for r in rows]


def test_any_quotes_in_many_blocks(spark, tmp_path, small_blocks):
    """Cells over lines and blocks, blank lines in and between records, text after closing quotes, no end of a quote."""
    pick = random.Random(11)
    files = {}
    for i, (encoding, d) in enumerate([("utf-8", ","), ("cp1251", ";"), ("utf-8", "\t"), ("utf-16-le", ","), ("utf-32-be", ";")]):
        lines = [f"a{d}b{d}c"]
        for _ in range(400):
            kind = pick.random()
            cell = pick.choice(["x", "", "Ж 1", "''", "y y"])
            if kind < 0.55:
                lines.append(d.join([cell, "2", "3"][: pick.choice([3, 3, 3, 1, 2])]) + d * pick.choice([0, 0, 1]))
            elif kind < 0.7:
                lines.append("")
            elif kind < 0.85:
                inner = pick.choice(["\n", "\n\n", f"{d}\n{d}", '""\n""', "\n" * 5, "w" * 9000 + "\n" + "v" * 9000])
                lines.append(f'{cell}{d}"p{inner}q"{d}"{cell}"')
            else:
                lines.append(pick.choice([f'5" {d}z', f'"k""k"{d}""{d}"{d}"', f' "n"{d}o']))
        if i == 0:
            lines += ['z,"never closed', "1,2,3", "", "4,5"]
        path = tmp_path / f"f{i}.txt"
        mark = "﻿" if encoding.startswith("utf-") and encoding != "utf-8" else ""
        path.write_bytes((mark + "\n".join(lines) + "\n" * (i != 0)).encode(encoding))
        files[path.name] = wanted(path, encoding, d)
    tables = read_batch(spark, str(tmp_path))
    assert not any(t.splittable for t in tables)
    row = tables[0].df.agg(F.countDistinct(F.shiftright("row_id", 33))).first()
    assert row[0] > 2  # blocks in which records start
    assert by_file(tables) == files


def test_same_rows_with_and_without_a_cell_over_lines(spark, tmp_path, small_blocks):
    body = "a,b\n" + "".join(f"{i},v{i}\n" + "\n" * (i % 3 == 0) + ",\n" * (i % 5 == 0) for i in range(3000))
    (tmp_path / "plain").mkdir()
    (tmp_path / "cell").mkdir()
    (tmp_path / "plain" / "f.csv").write_text(body)
    (tmp_path / "cell" / "f.csv").write_text(body + '"over\n\nlines",1\n')
    (plain,), (cell,) = (read_batch(spark, str(tmp_path / x)) for x in ("plain", "cell"))
    assert plain.splittable and not cell.splittable
    rows, more = by_file([plain])["f.csv"], by_file([cell])["f.csv"]
    assert len(rows) == 3000 + 1000 + 600
    assert more == [*rows, ("over\n\nlines", "1")]
    (dropped,) = read_batch(spark, str(tmp_path / "cell"), keep_blank_rows=False)
    assert count_rows(dropped.df).first()[0] == 3000 + 600 + 1
    assert [r.n_rows for r in profile_batch(spark, str(tmp_path)).orderBy("source_file").collect()] == [4601, 4600]


def test_line_feed_bytes_inside_characters(spark, tmp_path, small_blocks):
    """The bytes of a line feed stand across U+0A05 and U+4E00 in UTF-16-LE, and across others elsewhere."""
    for i, (encoding, text) in enumerate(
        [("utf-16-le", "ਅ一"), ("utf-16-be", "一ਅ"), ("utf-32-le", "ਅĀ"), ("utf-32-be", "Āਅ"), ("utf-16-le", "ਅ")]
    ):
        lines = ["k,v"] + [f"{j},{text * (j % 4)}{'x' * (j % 7)}" for j in range(2000)]
        (tmp_path / f"w{i}.csv").write_bytes(("﻿" + "\r\n".join(lines) + "\r\n").encode(encoding))
    got = by_file(read_batch(spark, str(tmp_path)))
    for i in range(5):
        text = ["ਅ一", "一ਅ", "ਅĀ", "Āਅ", "ਅ"][i]
        assert got[f"w{i}.csv"] == [(str(j), text * (j % 4) + "x" * (j % 7)) for j in range(2000)]


def test_states_carry_over_blocks(spark):
    """Sums modulo three with resets, against one line after the other."""
    pick = random.Random(3)
    rows, want, state, first = [], {}, 0, None
    for n in range(400):
        block, seq = n // 9, n
        put = pick.choice([None, None, None, None, 0, 1])
        add = pick.randrange(3)
        rows.append(("f", block * 100, seq, str(n), add, put))
        if state == 0:
            first = (block * 100, seq)
        want.setdefault(first, []).append(str(n))
        state = put if put is not None else (state + add) % 3
    lines = spark.createDataFrame(rows, "source_file string, block long, seq long, value string, add int, put int")
    got = join_lines(lines.repartition(5), 3, F.col("add"), F.col("put"), "|").collect()
    assert {(r.block, r.seq): r.value for r in got} == {k: "|".join(v) for k, v in want.items()}
    assert [(r.block, r.seq) for r in got if r.head] == [(0, 0)]


def test_header_after_blank_lines_and_over_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text('\n\n"x\ny",b\n\n1,2\n')
    (tmp_path / "b.csv").write_text("\n\n")
    df = read_delimited(spark, str(tmp_path / "a.csv"))
    assert [f.metadata.get("label") for f in df.schema.fields][2:] == ["x\ny", "b"]
    assert [tuple(r)[2:] for r in df.orderBy("row_id").collect()] == [(None, None), ("1", "2")]
    assert read_batch(spark, str(tmp_path / "b.csv")) == []
