"""From raw documents to packed training sequences.

Five stages, each one operator of ``eventide.llm``: drop documents of low quality, keep one of each
group of near copies, blank personal data, mix the sources to their target weights, pack token ids
into sequences.  Every stage takes all rows that the one before it kept; its result is written as
Parquet into the shared folder and read back, so a lost executor costs at most one stage's tasks.

``STAGES`` is the list of (name, function); each function takes (spark, docs, sf_dir).  All but the last
return the columns of ``documents``; the last returns a row for each piece of a packed document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from eventide.llm import mixing, near_dedup, packing, pii, quality
from eventide.llm.common import table, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier accepts."""
    return quality.accepted(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id.

    Five-word shingles, similarity of 0.8 or more.
    """
    return near_dedup.deduplicated(docs, percent=80)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind in brackets."""
    return pii.redacted(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; the last of a source may be cut short."""
    return mixing.mixed(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 token ids and their places in the packed sequences."""
    packed = packing.pack(packing.tokenize(docs, with_ids=False).drop("ids"), docs.count())
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [("quality", quality_stage), ("near_dedup", near_dedup_stage), ("pii", pii_stage), ("mixing", mixing_stage), ("packing", packing_stage)]

#: SQL has no word for the classifier or the tokenizer; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
