"""The corpus pipeline: stages that each apply one operator to all that the stage before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gaugeworks.llm import bpe, decontam, langid, line_dedup, simhash
from gaugeworks.llm._io import written
from gaugeworks.llm.queries import table, vocabulary_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter and nulls go. Texts of languages that weren't learned stay: the posterior over a whole text is near 1 for any text but a very short one, so its least value hardly ever binds."""
    model = langid.fit(docs.where(~langid.held_out()).select("doc_id", "text", "lang"))
    return langid.accepted(docs, model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long lines that five documents or more hold stay in the last of them. No document goes."""
    return line_dedup.without_repeated_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of texts whose five-word shingles are alike by 0.8 the document with the smallest id stays; of rows that repeat it, one."""
    return simhash.without_near_duplicates(docs)


#: Words of a benchmark item in a row from which a document goes; shorter matches are cut out of it.
LEAKED_WORDS = 13


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ``LEAKED_WORDS`` words of a benchmark item in a row go, and those of several items; shorter matches are cut out."""
    return decontam.cleaned(docs, table(spark, sf_dir, "benchmark"), longest=LEAKED_WORDS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with its count of tokens and the digest of the decoded text."""
    return bpe.encoded_digests(docs, vocabulary_path()).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("bpe", encode),
]

#: The stages use hashes and models that SQL doesn't have; tests compare them with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
