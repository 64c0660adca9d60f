"""The corpus pipeline: five stages, each on all documents that the one before it kept.

``run`` writes each stage's documents as Parquet to the folder that executors share and rereads them for the next stage; what a stage wrote besides is deleted.

Every stage but the last returns the columns of documents, and others that came with them under any name, in whole rows. An empty table gives an
empty result; repeated rows, null ids, null and very long texts and ties are settled as each stage says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fundloom.llm import decontam, mixing, rules, secret_scan, simhash
from fundloom.llm.common import discard, settled, table

#: No SQL: the stages' thresholds and classes can't be put in one query. They are tested against brute-force versions.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, each row judged for itself; a null text fails, a null language is a stratum of its own."""
    return rules.filtered(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, texts that op8's fingerprints link or whose shingles are similar: the least doc_id, null last. Null texts and texts without words are one class; repeated rows are copies."""
    return simhash.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; a null text holds none. Rows with equal ids are told apart by their texts."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts replaced and n_chars counted anew; a null text stays null."""
    return secret_scan.redacted(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How much of each document the mix takes. Null sources are one source, the last; rows of equal id and size are interchangeable."""
    return mixing.mix(docs.select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scans", secret_scans),
    ("source_mixing", source_mixing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs = settled(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
        if before is not None:
            discard(before)  # the stage before this one has been read for the last time
        before = docs
    return docs
