"""The corpus pipeline: documents in, packed training sequences out.

Every stage is one operator of ``quillspark.llm`` applied to all that its predecessor kept; each result is written as
Parquet in the shared folder and read again as the next stage's documents. The last result has every piece of every
document with its ids and its place: start in the document, sequence and offset. ``packing.sequences`` puts pieces together.

Every stage reads whole texts, passes on columns that it doesn't know (also under names that operators use themselves) and
gives no rows for an empty table. What a stage does with nulls, ties and repeated rows its docstring says.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import language_id, mixing, packing, secret_scan, simhash
from quillspark.llm.common import remove, scratch, shared_folder


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language compression can't tell go: null texts, texts without a letter, too narrow a margin.

    Each row is judged by its text alone, so repeated rows stay or go together. Dictionaries come from rows with a lang; where
    there is none, no document can be told and all go. Null ids, sources and langs are kept as they are.
    """
    return language_id.keep_identified(docs, language_id.fit(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the smallest doc_id's, or one without an id if none has one.

    Of rows that repeat that id, the one with the least fingerprint, then the least digest of its columns, stays; null texts
    and texts without a word are one group.
    """
    return simhash.drop_near_duplicates(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mask; no document goes, and n_chars follows. A null text stays null; equal texts become equal ones."""
    return secret_scan.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat, or go, as their sources' target weights ask.

    Null sources are one source, the last; documents without words cost nothing and have odds of their own; repeated rows
    share their copies.
    """
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their ids, sequences and offsets. A null text is its end id alone; every row is a document."""
    return packing.pack(docs, packing.tokenizer_path(), with_ids=True)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Fingerprints, compression, tokens and dependent rounding are beyond SQL: tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what they leave between them is removed once the next one has read it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, before = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        path = f"{folder}/{name}.parquet"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
