"""documents, refined in stages; each stage's rows are written and read again as the next one's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarn.llm import quality
from tarn.llm.common import materialise, table
from tarn.llm.decontamination import without_leaks
from tarn.llm.mixing import mixed
from tarn.llm.sharding import assign_shards
from tarn.llm.simhash import one_of_similar


def good_only(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def near_deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles at a similarity of 0.8 or more."""
    return one_of_similar(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that leak a benchmark item."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixed(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row with its shard and slot."""
    return assign_shards(docs)


STAGES = [
    ("quality", good_only),
    ("near duplicates", near_deduplicated),
    ("decontamination", decontaminated),
    ("mix", source_mix),
    ("shards", sharded),
]

#: Classifier, fingerprints and jump hashes have no SQL form; tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs, name.replace(" ", "-"))
    return docs
