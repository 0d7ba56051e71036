"""One query for each operator, over whole tables."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm import bpe, decontam, langid, lengths, line_dedup, multiset_hash, secrets, sharding, simhash, wacz
from gaugeworks.llm.oracle import SQL


def vocabulary_path() -> str:
    """The tokenizer's vocabulary file: the one that GAUGEWORKS_VOCABULARY names, or that of the installed public tokenizers."""
    if named := os.environ.get("GAUGEWORKS_VOCABULARY"):
        return named
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: spans by pattern, and spans of values that one owner alone has."""
    found = secrets.secret_spans(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[count(k) for k, *_ in secrets.KINDS],
        F.sha2(secrets.joined_spans(F.col("base")), 256).alias("base_sha256"),
        secrets.joined_spans(F.array_sort(F.concat("base", "live"))).alias("spans"),
        F.size("live").cast("long").alias("n_live"),
    )


def op2_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate class of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_print(F.col("fp")).alias("fingerprint"), "component_id")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, dropped lines and digest of the kept lines of every document."""
    return line_dedup.keep_bitmaps(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op4_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    return multiset_hash.with_edits(table(spark, sf_dir, "documents"))


def op5_wacz_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, written to archives and read back by range."""
    records = wacz.read_records(wacz.write_archives(table(spark, sf_dir, "pages")))
    return records.select(F.col("page").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram of encoded lengths with suffix sums."""
    return lengths.length_report(table(spark, sf_dir, "documents"), vocabulary_path())


def op7_suffix_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words and items in every document."""
    found = decontam.matches(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_items") >= 2).alias("contaminated"))


def op8_naive_bayes_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; one in four is held out of the fit."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out()).select("doc_id", "text", "lang"))
    found = langid.identified(docs.select("doc_id", "text"), model)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op9_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of 24, near equal in bytes, equal texts together."""
    out = sharding.sharded(table(spark, sf_dir, "documents"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded."""
    return bpe.encoded_digests(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary_path()).drop("text")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_secret_ownership, op2_simhash_pigeonring, op3_line_dedup, op4_multiset_hash, op5_wacz_archives, op6_length_histogram, op7_suffix_automaton, op8_naive_bayes_language, op9_minimax_shards, op10_bpe_roundtrip, pipeline)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
