"""The corpus pipeline: language identification, near-dedup, substring dedup, personal data, packing.

Each stage is (name, function); a function takes (spark, docs, sf_dir), where docs has doc_id, text and any other columns, and
returns a DataFrame with the same columns (the last one: pieces of packed sequences). Between stages, what was kept is
written as Parquet to the folder in spark.checkpoint.dir and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.common import read, remove, rewritten
from lodestone.llm.op2_dartminhash import drop_near_duplicates
from lodestone.llm.op6_substring import dedup_substrings
from lodestone.llm.op7_pii import redact_documents
from lodestone.llm.op8_language import keep_identified
from lodestone.llm.op9_packing import pack_documents


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose predicted language agrees with their label or scores enough; missing labels are filled. Null texts, texts
    without a letter and texts in none of the labels' languages go."""
    return keep_identified(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least doc_id, of each group of near copies."""
    return drop_near_duplicates(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words and more that a document with a smaller doc_id has as well."""
    return dedup_substrings(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind."""
    return redact_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens in packed sequences."""
    return pack_documents(docs)


STAGES = [
    ("language", identify_language),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeated_passages),
    ("personal_data", redact_personal_data),
    ("packing", pack_sequences),
]

#: Language identification, dart signatures, the field and the tokenizer are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = rewritten(stage(spark, docs, sf_dir), name)
        if before is not None:
            remove(spark, before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
