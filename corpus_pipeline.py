"""The corpus pipeline: documents to a filtered, de-duplicated, decontaminated training mix.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor
kept, and returns a DataFrame; all but the last return the columns of
documents. ``run`` writes each stage's result as Parquet in the shared folder,
reads it back as the next one's input, and deletes what a stage wrote on its
way and the input that it has used up; only the last result stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontamination, mixing, near_copies, suffixes, toxicity
from tidemark.llm.common import discard, materialize, read, scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores 0.3 or more go."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a five-word Jaccard similarity of 0.8, candidates by SimHash and then by prefixes, the
    document of smallest id stays."""
    return near_copies.first_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more stay at their first occurrence only."""
    return suffixes.without_repeats(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.without_items(docs, read(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are replicated to their target weights and shuffled."""
    return mixing.mix_sources(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mixing", mix),
]

#: A trained network and fingerprints are beyond SQL; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs, used = read(spark, sf_dir, "documents"), []
    for _, stage in STAGES:
        with scratch():
            docs = materialize(stage(spark, docs, sf_dir), keep=True)
        discard(*used)
        used = [docs]
    return docs
