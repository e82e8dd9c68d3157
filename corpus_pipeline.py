"""A corpus pipeline of five stages, each one of the training-data operators over what its predecessor kept.

Cases defined for all stages: an empty table gives an empty result; null texts count as empty ones; columns of documents
are kept whatever their names, the last stage's apart; a row that a stage keeps is unchanged, but for the cut in mixing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandspark.llm import exact_dedup, mixing, packing, simhash, toxicity
from strandspark.llm._shared import materialize


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not reject. A null or empty text, or one without any feature, is kept, and
    all are if labels are missing or of one kind; repeated rows are judged alike; a null id is as good as any."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal but for white space: that with the least id, null being the
    greatest. Null and empty texts are one group; of rows that share the id that stays, one does."""
    return exact_dedup.drop_duplicates(docs)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: that with the least id. Rows with a null id stay only if no row of their group has
    one; null, empty and blank texts have fingerprint zero and are a group like any other."""
    return simhash.drop_near_duplicates(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by source weights: a row for each repeat of a document, the last cut at its source's budget. A null source is
    a source of its own and comes last; texts without words are in whole epochs only; equal rows are interchangeable."""
    return mixing.mix_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences, with their checksum; repeats of a document are packed each for itself. A null or empty text is
    the end id alone; a text longer than a sequence fills several; a null id stays null."""
    return packing.pack_digests(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("simhash", simhash_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: The chain, fingerprint links and the packing are not expressible in SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name}")
    return docs
