"""Every operator and pipeline stage keeps other columns, whatever they are called."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rowforge.llm import co_training, curriculum, decontaminate, language, line_dedup, pii, quality_rules, sharding, simhash, toxicity
from rowforge.llm.common import fold_of

FOLDER = "/root/testdata/sf0.001"
EXTRA = ["_hash", "_text", "_copy", "_gone", "_fp", "_none", "_position", "_id", "_own", "_s", "_key", "_place"]


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels, items = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    docs = docs.filter("doc_id < 120")
    return docs.withColumns({c: F.concat(F.lit(c), docs["doc_id"]) for c in EXTRA}).cache(), labels, items


OPERATORS = {
    "op1": lambda d, x, b: co_training.score_quality(d, co_training.learn_quality_views(d, x)),
    "op2": lambda d, x, b: line_dedup.dedup_lines(d),
    "op3": lambda d, x, b: simhash.near_duplicates(d),
    "op4": lambda d, x, b: language.identify_language(d, language.learn_profiles(d, fold_of(d["doc_id"], 5) != 0)),
    "op6": lambda d, x, b: toxicity.score_toxicity(d, toxicity.learn_toxicity(d, x)),
    "op7": lambda d, x, b: quality_rules.judge_quality(d, quality_rules.learn_quality(d, x)),
    "op8": lambda d, x, b: pii.find_personal_data(d, pii.learn_spans(d)),
    "op9": lambda d, x, b: decontaminate.drop_contaminated(d, b),
    "op5": lambda d, x, b: curriculum.mix_documents(d),
    "op10": lambda d, x, b: sharding.shard_documents(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operator(tables, name):
    made = OPERATORS[name](*tables)
    assert set(EXTRA) <= set(made.columns)
    rows = made.select("doc_id", *EXTRA).collect()
    assert rows and all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in EXTRA)


def test_stages(spark, tables):
    docs = tables[0]
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, FOLDER)
        assert made.columns[: len(docs.columns)] == docs.columns or name == "sharding"
        rows = made.select("doc_id", *EXTRA).collect()
        assert rows and all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in EXTRA), name
