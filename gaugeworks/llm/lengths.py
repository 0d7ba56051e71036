"""Token counts as an exact histogram of encoded lengths.

Documents are aggregated by encoded length: one row for each length that occurs, as many as the longest document has
tokens at most. Suffix sums over the histogram answer, for every context limit, how many documents reach it, how many
tokens they hold, and what is left if longer documents are cut there.

Null and empty texts have length 0. An empty table has an empty histogram.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.llm._io import written
from gaugeworks.llm.bpe import token_counts

#: Lengths that are added up in one group; the groups' own sums are few.
SPAN = 4096


def histogram(docs: DataFrame, vocabulary_path: str, text: str = "text") -> DataFrame:
    """``n_tokens`` and ``n_docs``."""
    return token_counts(docs.select(text), vocabulary_path, text).groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(lengths: DataFrame) -> DataFrame:
    """For each length L of a histogram: documents and tokens of documents of L or more, those of all documents cut at L,
    the share of documents of L or fewer, and how many documents are longer.

    Sums go by groups of ``SPAN`` lengths, then over the groups, so that no task has all lengths.
    """
    grouped = lengths.withColumn("_g", F.floor(F.col("n_tokens") / SPAN))
    tokens = F.col("n_tokens") * F.col("n_docs")
    groups = grouped.groupBy("_g").agg(F.sum("n_docs").alias("_docs"), F.sum(tokens).alias("_tokens"))
    above = Window.orderBy(F.col("_g").desc()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    groups = groups.select("_g", F.coalesce(F.sum("_docs").over(above), F.lit(0)).alias("_da"), F.coalesce(F.sum("_tokens").over(above), F.lit(0)).alias("_ta"), F.sum("_docs").over(everything).alias("_dn"), F.sum("_tokens").over(everything).alias("_tn"))
    within = Window.partitionBy("_g").orderBy(F.col("n_tokens").desc())
    out = grouped.select("*", F.sum("n_docs").over(within).alias("_d"), F.sum(tokens).over(within).alias("_t")).join(groups, "_g")
    docs_from, tokens_from = F.col("_d") + F.col("_da"), F.col("_t") + F.col("_ta")
    return out.select(
        "n_tokens",
        "n_docs",
        docs_from.alias("docs_from"),
        tokens_from.alias("tokens_from"),
        (F.col("_tn") - tokens_from + F.col("n_tokens") * docs_from).alias("tokens_cut"),
        ((F.col("_dn") - docs_from + F.col("n_docs")) / F.col("_dn")).alias("share_within"),
        (docs_from - F.col("n_docs")).alias("docs_longer"),
    )


def length_report(docs: DataFrame, vocabulary_path: str, text: str = "text") -> DataFrame:
    """The histogram of ``docs`` with its suffix sums."""
    return suffix_sums(written(histogram(docs, vocabulary_path, text), "lengths"))


def at_limits(report: DataFrame, limits: list[int]) -> DataFrame:
    """For each context limit: documents that are longer, and the tokens left if they are cut there. From the histogram alone."""
    pairs = report.select("n_tokens", "n_docs", F.explode(F.lit([int(x) for x in limits])).alias("context"))
    return pairs.groupBy("context").agg(
        F.sum(F.when(F.col("n_tokens") > F.col("context"), F.col("n_docs")).otherwise(0)).alias("docs_longer"),
        F.sum(F.least("n_tokens", "context") * F.col("n_docs")).alias("tokens_cut"),
    )


def quantile(report: DataFrame, share: float) -> int | None:
    """The least length that ``share`` of the documents don't exceed."""
    row = report.where(F.col("share_within") >= share).agg(F.min("n_tokens")).first()
    return row[0]
