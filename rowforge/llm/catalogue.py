"""Registered queries of this subpackage, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table
from . import curriculum, decontaminate, hard_negatives, line_dedup, url_rules
from .co_training import co_training_digest
from .language import identify_language, learn_profiles
from .common import fold_of
from .periodic_runs import runs_digest
from .pii import pii_digest
from .quality_rules import quality_digest
from .sharding import shard_digest
from .simhash import near_duplicates
from .toxicity import toxicity_digest

Query = Callable[[SparkSession, str], DataFrame]


def op1_co_training(spark: SparkSession, sf: str) -> DataFrame:
    return co_training_digest(read_table(spark, sf, "documents"), read_table(spark, sf, "labels"))


def op2_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return line_dedup.line_digest(read_table(spark, sf, "documents"))


def op3_simhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf, "documents").select("doc_id", "text"))
    return found.select("doc_id", "fingerprint", "component_id")


def op4_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents")
    profiles = learn_profiles(docs, fold_of(docs["doc_id"], 5) != 0)
    found = identify_language(docs.select("doc_id", "text"), profiles)
    return found.withColumn("held_out", fold_of(found["doc_id"], 5) == 0)


def op5_curriculum_mix(spark: SparkSession, sf: str) -> DataFrame:
    return curriculum.mix_digest(read_table(spark, sf, "documents"))


def op6_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity_digest(read_table(spark, sf, "documents"), read_table(spark, sf, "labels"))


def op7_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality_digest(read_table(spark, sf, "documents"), read_table(spark, sf, "labels"))


def op8_personal_data(spark: SparkSession, sf: str) -> DataFrame:
    return pii_digest(read_table(spark, sf, "documents"))


def op9_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    docs, benchmark = read_table(spark, sf, "documents"), read_table(spark, sf, "benchmark")
    found = decontaminate.find_contamination(docs, benchmark, proximity=True)
    found = found.withColumn("n_near_items", F.size("near_items").cast("long"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near_items")


def op10_feistel_sharding(spark: SparkSession, sf: str) -> DataFrame:
    return shard_digest(read_table(spark, sf, "documents"))


def op11_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    return hard_negatives.negatives_digest(read_table(spark, sf, "embeddings"))


def op12_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    return runs_digest(read_table(spark, sf, "documents"))


def op13_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    return url_rules.url_digest(read_table(spark, sf, "pages"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_co_training,
        op2_line_dedup,
        op3_simhash_near_dedup,
        op4_language_id,
        op5_curriculum_mix,
        op6_toxicity,
        op7_quality_rules,
        op8_personal_data,
        op9_decontamination,
        op10_feistel_sharding,
        op11_hard_negatives,
        op12_periodic_runs,
        op13_url_filter,
    )
}

ORACLES: dict[str, str] = {
    "op2_line_dedup": line_dedup.DIGEST_SQL,
    "op5_curriculum_mix": curriculum.DIGEST_SQL,
    "op9_decontamination": decontaminate.DIGEST_SQL,
    "op11_hard_negatives": hard_negatives.DIGEST_SQL,
    "op13_url_filter": url_rules.DIGEST_SQL,
}
