"""Batches of several headers in one run, and the counters of that run."""

import csv
import os

import pytest

from rowforge.plans.export import run_batch
from rowforge.plans.spec import ExportSpec
from test_export import read_csv_outputs, read_workbook

HEADERS = (["k", "a", "b"], ["a", "k"], ["b", "x y", "k", "a"], ["k", "k", "a"])
SPEC = {"filter_column": "k", "filter_values": ("x", "y", " "), "file_split_column": "k", "selected_columns": ("a", "k")}


def write_headers(folder, headers, n=30):
    """Files of unlike headers, and what a run over them has to count."""
    os.makedirs(folder)
    want = dict.fromkeys(("rows_in", "rows_kept", "rows_routed", "duplicates_removed"), 0)
    files = {}
    for i, header in enumerate(headers):
        rows = [{"k": ("x", "y", " ", "z")[j % 4], "a": str(j % 3), "b": str(j), "x y": "q;\n\""} for j in range(n)]
        with open(f"{folder}/f{i}.csv", "w", encoding="utf-8", newline="") as f:
            csv.writer(f, delimiter=";").writerows([header, *([row[c] for c in header] for row in rows)])
        kept = [row for row in rows if row["k"] != "z"]
        routed = [row for row in kept if row["k"] != " "]
        cells = [(row["k"], row["a"]) for row in routed]
        # Equal header texts count as columns of their own, so the last header has a column that is left out.
        written = list(dict.fromkeys(cells)) if len(header) > 2 else cells
        want["rows_in"] += n
        want["rows_kept"] += len(kept)
        want["rows_routed"] += len(routed)
        want["duplicates_removed"] += len(cells) - len(written)
        files[f"f{i}"] = written
    want["rows_written"] = sum(map(len, files.values()))
    want["outputs"] = sum(len({k for k, _ in rows}) for rows in files.values())
    return files, want


@pytest.mark.parametrize("fmt", ["csv", "xlsx", "parquet"])
def test_counters_are_those_of_the_written_rows(spark, tmp_path, fmt):
    files, want = write_headers(str(tmp_path / "in"), HEADERS)
    (tmp_path / "in" / "none.csv").write_text("")
    out = str(tmp_path / "out")
    manifest, counters = run_batch(spark, str(tmp_path / "in"), ExportSpec(output_format=fmt, **SPEC), out, "r")
    assert [row.asDict() for row in counters.collect()] == [{"run_id": "r", **want, "files_failed": 1}]
    listed = {m.file_name: m for m in manifest.collect() if not m.error}
    assert sum(m.n_rows for m in listed.values()) == want["rows_written"]
    for name, m in listed.items():
        rows = files[os.path.basename(m.source_file).removesuffix(".csv")]
        expected = [["a", "k"], *([a, k] for k, a in rows if k == m.dest_file)]
        if fmt == "csv":
            assert read_csv_outputs(out)[name] == expected
        elif fmt == "xlsx":
            assert read_workbook(f"{out}/{name}") == {m.sheet_name: expected}
        else:
            back = spark.read.parquet(f"{out}/file_name={name}")
            assert [list(row) for row in back.collect()] == expected[1:]


def test_nothing_kept_counts_nothing_written(spark, tmp_path):
    _, want = write_headers(str(tmp_path / "in"), HEADERS[:2])
    spec = ExportSpec(output_format="csv", filter_column="a", filter_values=("none",))
    _, counters = run_batch(spark, str(tmp_path / "in"), spec, str(tmp_path / "out"), "r")
    row = counters.first()
    assert (row.rows_in, row.rows_kept, row.rows_written, row.outputs) == (want["rows_in"], 0, 0, 0)


def test_headers_share_their_jobs(spark, tmp_path):
    """Four headers read line by line take at most half as many jobs again as one.

    Cells over several lines are left out here: putting such records together takes jobs of its own, once a batch.
    """
    by_line = [*HEADERS[:2], ["b", "k", "a"], HEADERS[3]]
    context, jobs = spark.sparkContext, {}
    try:
        for n in (1, 4):
            write_headers(str(tmp_path / f"in{n}"), by_line[:n])
            context.setJobGroup(f"headers-{n}", "")
            run_batch(spark, str(tmp_path / f"in{n}"), ExportSpec(output_format="csv", **SPEC), str(tmp_path / f"out{n}"), "r")
            jobs[n] = len(context.statusTracker().getJobIdsForGroup(f"headers-{n}"))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[4] <= 1.5 * jobs[1], jobs
