"""Plans that keep the lines of a file, and rows without duplicate removal, out of single tasks."""

import pytest

from rowforge.plans import together
from rowforge.plans.export import run_batch
from rowforge.plans.spec import ExportSpec
from rowforge.sources.delimited import read_delimited


@pytest.fixture()
def no_size_checks(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("cell", ["plain", '"over\nlines"'])
def test_lines_are_not_shuffled_by_file_to_find_the_header(spark, tmp_path, no_size_checks, cell):
    (tmp_path / "a.csv").write_text(f"k;v\n1;{cell}\n2;x\n")
    df = read_delimited(spark, str(tmp_path))
    assert sorted((r["k"], r["v"]) for r in df.collect()) == [("1", cell.strip('"')), ("2", "x")]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line and "_first" in line]
    assert joins and all("rightHint=(strategy=broadcast)" in line for line in joins)


def _written(folder):
    return sorted(x for f in folder.rglob("part-*.csv") for x in f.read_text("utf-8-sig").splitlines()[1:])


def test_rows_are_parsed_once_and_grouped_only_to_remove_duplicates(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("s;v\nF;1\nF;1\nO;2\n;3\n")
    (tmp_path / "in" / "b.csv").write_text("s;v;k\nF;1;1\nF;1;2\nO;2;3\n;3;4\n")
    seen = []

    def outcomes(members, _find=together._outcomes):
        seen.append((members, *_find(members)))
        return seen[-1][1:]

    stored = []

    def materialize(df, purpose="stage", folders=(), _store=together.materialize):
        stored.append((purpose, df._jdf.queryExecution().optimizedPlan().toString()))
        return _store(df, purpose, folders)

    monkeypatch.setattr(together, "_outcomes", outcomes)
    monkeypatch.setattr(together, "materialize", materialize)
    spec = ExportSpec(output_format="csv", file_split_column="s", selected_columns=("s", "v"))
    counters = run_batch(spark, str(tmp_path / "in"), spec, str(tmp_path / "out"), "run")[1].first().asDict()
    assert _written(tmp_path / "out") == ["F;1", "F;1", "F;1", "O;2", "O;2"]
    assert (counters["rows_in"], counters["rows_kept"], counters["rows_routed"]) == (8, 8, 6)
    assert (counters["duplicates_removed"], counters["rows_written"], counters["outputs"]) == (1, 5, 4)
    members, rows, own = seen[0]
    assert sorted(m.unique for m in members) == [False, True]
    for df in (rows, *own.values()):
        assert "from_csv" not in df._jdf.queryExecution().optimizedPlan().toString()
    grouped = ["cells" in plan.splitlines()[0] and plan.startswith("Aggregate") for purpose, plan in stored if purpose == "outcomes"]
    assert sorted(grouped) == [False, True]
