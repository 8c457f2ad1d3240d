"""Five stages from raw documents to token ids: quality, toxicity, near copies, mixture, BPE. Each stage's result is written
as Parquet to the folder that all executors share and is the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomtext.llm import bpe, mixing, ngram_join, quality, toxicity
from loomtext.llm.common import materialise, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.classify(docs, table(spark, sf_dir, "labels")).filter("keep").select(*docs.columns)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose nearest labelled examples vote them toxic go."""
    return toxicity.score(docs, table(spark, sf_dir, "labels")).filter("NOT toxic").select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return ngram_join.deduplicate(docs)


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight says."""
    return mixing.mix(docs).select(*docs.columns)


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids."""
    return bpe.encode(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("toxicity", toxicity_filter),
    ("n-gram Jaccard join", near_copies),
    ("mixing sources to target weights", source_mixture),
    ("BPE encoding and decoding", bpe_tokens),
]

#: SQL can express neither the fitted classifier nor BPE; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = materialise(stage(spark, docs, sf_dir), f"stage{i}")
    return docs
