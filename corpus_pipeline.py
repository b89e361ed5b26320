"""Cleaning of a training corpus in five stages, from the ``documents`` table to a weighted mix.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns a DataFrame; ``run`` writes it as Parquet
to the shared folder and reads it back for the next one. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from armspark.llm import decontaminate, mixing, near_copies, quality, surrogates
from armspark.llm.common import read
from armspark.session import materialize


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def one_per_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies: 0.8 or more on five-word shingles."""
    return near_copies.keep_first(docs)


def not_in_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a leaked benchmark item."""
    return decontaminate.drop_leaking(docs, read(spark, sf_dir, "benchmark"))


def without_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced; n_chars follows the new text."""
    # Numbered names, so that no column of the input meets the count of entities.
    names = [f"c{i}" for i in range(len(docs.columns))]
    done = surrogates.replace_entities(docs).toDF(*names, "found")
    if "n_chars" in docs.columns:
        length, text = names[docs.columns.index("n_chars")], names[docs.columns.index("text")]
        n_chars = F.when(F.col("found") > 0, F.char_length(text)).otherwise(F.col(length))
        done = done.withColumn(length, n_chars.cast(docs.schema["n_chars"].dataType))
    return done.select(*names).toDF(*docs.columns)


def weighted_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with its target, taken words and copies."""
    return mixing.mixed_documents(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("SimHash near-dedup", one_per_group),
    ("benchmark decontamination", not_in_benchmark),
    ("PII surrogates", without_pii),
    ("source mixing", weighted_mix),
]

# The classifier, fingerprints and surrogates have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.lower().replace(" ", "-"))
    return docs
