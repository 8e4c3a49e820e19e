"""Row ids of typed files, positions and pages per source."""

import random

from pyspark.sql import functions as F

from rowforge.operators import page, search_rows, search_summary, with_row_id
from rowforge.operators.numbering import ranks


def test_ids_follow_paths_and_rows_whatever_reads_them(spark, tmp_path):
    folder = str(tmp_path / "t")
    for i, name in enumerate(["b", "a", "c"]):
        frame = spark.range(1000 * i, 1000 * i + 700, 1, 1).withColumn("x", F.col("id") * 2)
        frame.write.parquet(f"{folder}/{name}")
    want = [*range(1000, 1700), *range(700), *range(2000, 2700)]
    seen = []
    for size in ("3000", "134217728"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        df = spark.read.option("recursiveFileLookup", "true").parquet(folder).filter("x >= 0").select("id")
        rows = with_row_id(df).orderBy("row_id").collect()
        assert [r.id for r in rows] == want
        seen.append([r.row_id for r in rows])
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert seen[0] == seen[1]
    one = with_row_id(spark.read.parquet(f"{folder}/b").filter("id % 2 = 1"))
    assert [r.row_id for r in one.orderBy("row_id").collect()] == list(range(1, 700, 2))
    joined = df.join(spark.range(2).withColumnRenamed("id", "k"))
    assert with_row_id(joined).select("row_id").distinct().count() == 4200


def test_ranks_with_gaps(spark):
    pick = random.Random(8)
    rows = {(f, (s << 33) | p) for f in "ab" for s in (0, 3, 9) for p in pick.sample(range(5000), 300)}
    rows |= {("a", (7 << 33) | p) for p in (0, 63, 64, 127, (1 << 33) - 1)}
    flagged = {r for r in rows if pick.random() < 0.3} | {("a", 7 << 33), ("a", (7 << 33) | 63), ("a", (8 << 33) - 1)}
    df = spark.createDataFrame([(f, i, (f, i) in flagged) for f, i in rows], "source_file string, row_id long, hit boolean")
    want = {}
    for f in "ab":
        for n, i in enumerate(sorted(i for g, i in rows if g == f)):
            if (f, i) in flagged:
                want[f, i] = n
    assert {(r.source_file, r.row_id): r.row_pos for r in ranks(df, F.col("hit")).collect()} == want
    assert ranks(df.limit(0), F.col("hit")).count() == 0


def test_pages_and_searches_agree_per_source(spark):
    rows = [(f, (s << 33) | p, f"{'needle' if (s + p) % 17 == 3 else 'hay'}") for f in ("x", "y") for s in range(3) for p in range(0, 90, 2)]
    rows = [r for r in rows if not (r[0] == "y" and r[1] < 20)]
    df = spark.createDataFrame(rows, "source_file string, row_id long, v string").repartition(3)
    for f in ("x", "y"):
        ids = sorted(i for g, i, _ in rows if g == f)
        hits = [i for i in ids if (f, i, "needle") in rows]
        found = {r.row_id: r.row_pos for r in search_rows(df, "NEEDLE").collect() if r.source_file == f}
        assert found == {i: ids.index(i) for i in hits}
        assert [r.row_id for r in page(df, 2, 40).collect() if r.source_file == f] == ids[40:80]
    summary = {r.source_file: (r.n_matches, r.first_page) for r in search_summary(df, "needle", 5, per_source=True).collect()}
    for f, (n, first) in summary.items():
        shown = [r.v for r in page(df, first, 5).collect() if r.source_file == f]
        assert "needle" in shown and n == sum(g == f and v == "needle" for g, _, v in rows)
    none = search_summary(df, "nothing", 5, per_source=True).collect()
    assert sorted(tuple(r) for r in none) == [("x", 0, None), ("y", 0, None)]


def test_shallow_and_deep_pages_have_one_order(spark, tmp_path):
    """Around the row from which pages come from counts instead of a top-k."""
    spark.range(0, 5300, 1, 1).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    for n in (99, 100, 101):
        assert [r.id for r in page(df, n, 50).collect()] == list(range(50 * n - 50, 50 * n))
