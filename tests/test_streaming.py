import os

from rowforge.plans.spec import ExportSpec
from rowforge.streaming.landing import export_arrivals


def test_new_files_are_exported_once_and_removed(spark, tmp_path):
    src = tmp_path / "in [x]"
    src.mkdir()
    out, progress = str(tmp_path / "out"), str(tmp_path / "progress")
    spec = ExportSpec(output_format="csv", file_split_column="k")

    def run():
        query = export_arrivals(spark, str(tmp_path / "in*"), spec, out, progress, files_per_batch=1)
        query.awaitTermination()
        done = spark.read.option("recursiveFileLookup", "true").parquet(f"{out}/manifest").collect()
        return sorted((os.path.basename(r.source_file), r.dest_file, r.n_rows) for r in done)

    (src / "a.csv").write_text("k,v\nx,1\ny,2\n")
    assert run() == [("a.csv", "x", 1), ("a.csv", "y", 1)]
    (src / "b.csv").write_text("k,v\nx,1\nx,2\n")
    assert run() == [("a.csv", "x", 1), ("a.csv", "y", 1), ("b.csv", "x", 2)]
    assert run() == [("a.csv", "x", 1), ("a.csv", "y", 1), ("b.csv", "x", 2)]
    assert sorted(os.listdir(out)) == ["batch-0", "batch-1", "manifest"]
