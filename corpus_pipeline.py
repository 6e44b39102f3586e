"""A training corpus from raw documents: five stages, each on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rillflow.llm import decontam, jaccard, langid, packing, quality
from rillflow.llm.common import release, ship, written
from rillflow.llm.queries import table, tokenizer_path


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier scores below its threshold."""
    release(ship(spark), docs)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language can't be told."""
    release(ship(spark), docs)
    return langid.keep_identified(docs)


def first_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least doc_id of each component of near copies."""
    release(ship(spark), docs)
    return jaccard.keep_first(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark."""
    release(ship(spark), docs)
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the token ids of what is left into sequences of 2048."""
    release(ship(spark), docs)
    return packing.pack(docs, tokenizer_path(), 0, 2048)


#: A stage's docs are its predecessor's written result, so what led to them is let go when it begins.
STAGES = [
    ("quality", good_quality),
    ("language", known_language),
    ("near_copies", first_of_near_copies),
    ("decontamination", without_benchmark),
    ("packing", packed),
]
#: SQL can express neither the learnt stages nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
