"""A corpus pipeline: quality, near duplicates, repeated passages, mixture, packing.

Each stage takes (spark, docs, sf_dir); docs has the columns of `documents`, and all stages but the last return them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm import chunks, mixing, packing, quality, simhash
from quadrille.llm.common import small_batches, staged, table
from quadrille.llm.tokens import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps."""
    small_batches(spark)
    return quality.judge(docs.select(COLUMNS), table(spark, sf_dir, "labels")).where("kept").select(COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, the one with the smallest doc_id; rows without an id and repeated rows are in their groups like others."""
    small_batches(spark)
    return simhash.one_of_each(docs.select(COLUMNS))


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages that an earlier one has; those of which nothing is left go."""
    small_batches(spark)
    out = chunks.deduplicate(docs.select(COLUMNS))
    return out.where((F.size("removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mixture takes, in training order."""
    small_batches(spark)
    return mixing.mix(docs.select(COLUMNS)).select(COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each piece's place in the packed sequences."""
    small_batches(spark)
    return packing.pack_documents(docs, path=vocabulary(), remembered=300_000)  # other stages use the same workers


STAGES = [("quality", quality_stage), ("near_duplicates", near_duplicate_stage), ("passages", passage_stage), ("mixing", mixing_stage), ("packing", packing_stage)]
#: No stage but the mixture can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = staged(docs, name)
    return docs
