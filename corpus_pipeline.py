"""A training corpus from documents: language, exact copies, near copies, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; its result is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm import exact_dedup, language, ngram_join, pii, queries
from lodestrata.llm._common import drop_folder, drop_made, folders_made, materialise, work_folder


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no language that can be learned: without text or letters."""
    return language.with_known_language(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id stays."""
    return exact_dedup.deduplicated(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents that are 80 % alike, the one with the smallest doc_id stays."""
    return ngram_join.without_near_copies(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts."""
    return pii.redacted(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens in windows of 2048."""
    return queries.pack(docs)


STAGES = [("language ID", known_language), ("exact dedup", exact_copies), ("n-gram Jaccard join", near_copies), ("PII", personal_data), ("packing", packed)]

#: Learned languages, checksums and tokens are not SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written and read again; the last one's rows. What a stage wrote on its way goes
    when its result is written."""
    docs, folder, before = queries.table(spark, sf_dir, "documents"), work_folder(spark), None
    for i, (_, stage) in enumerate(STAGES):
        mark = folders_made()
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, f"{folder}/{i}")
            drop_made(spark, mark)
            if before:
                drop_folder(spark, before)
            before = f"{folder}/{i}"
    return docs
