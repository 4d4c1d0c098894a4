"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next.

Stages decide about rows, not about ids: rows whose doc_id is null or shared are told apart by numbers drawn for
them (``with_row_ids``), which come after all ids. So of rows repeated whole one stays, rows that share an id but
not the text are decided each for itself, and rows without id are deduplicated like others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querylens.llm.common import documents, kept, with_row_ids
from querylens.llm.exact_dedup import exact_groups
from querylens.llm.mixing import sampled
from querylens.llm.near_dedup import near_classes
from querylens.llm.quality import accepted, fit_quality
from querylens.llm.sentence_pieces import encoded, model_bytes


def _decided(docs: DataFrame, decide: Callable[[DataFrame], DataFrame], column: str) -> DataFrame:
    """The rows that an operator decides for; it is given a table whose doc_id is unique."""
    rows = with_row_ids(docs)
    decisions = decide(rows.withColumn("doc_id", F.col("_row_id")).drop("_row_id"))
    ids = decisions.where(column).select(F.col("doc_id").alias("_row_id"))
    return rows.join(ids, "_row_id", "left_semi").select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble does not reject."""
    return accepted(docs, fit_quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal but for white space."""
    return _decided(docs, exact_groups, "kept")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts alike by four fifths of their five-word shingles."""
    return _decided(docs, near_classes, "kept")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens meet target shares of sources, languages and topics."""
    return _decided(docs, sampled, "sampled")


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, the bytes each piece came from, and the text decoded from the ids."""
    return encoded(docs, model_bytes(), decoded=True).withColumn("n_tokens", F.size("ids").cast("bigint"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("encoding", encoding),
]
# Learnt scores and near-duplicate classes have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = kept(stage(spark, docs, sf_dir), name)
    return docs
