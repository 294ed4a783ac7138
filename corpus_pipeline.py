"""A corpus from raw documents: rules, classifier, near-duplicates, mix, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs.  All but the last return the columns
of documents.  Both models are fitted on the table of documents itself and its labels,
never on held-out rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import byte_cnn, chosen_path, mixing, pair_bpe, quality_rules
from gridloom.llm.shared import spent, written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the counting rules or the n-gram regression reject."""
    return quality_rules.keep(docs, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the convolutional network scores below the threshold."""
    return byte_cnn.keep(docs, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates."""
    return chosen_path.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents until the sources meet their target weights."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document (array) and their number."""
    return pair_bpe.with_tokens(docs).select("doc_id", "source", "n_tokens", "token_ids")


STAGES = [("quality_rules", rules), ("quality_classifier", classifier), ("jaccard_join", deduplicate), ("mixing", mix), ("bpe_encoding", encode)]

#: Trained models and hashed joins have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`, one after another, each written and reread; a stage's
    table is deleted once the next is written.  Null ids and sources, null, empty, very long
    and repeated texts and an empty table are no errors: what each stage does with them is in
    the docstring of its operator."""
    docs, before = _table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        spent(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
