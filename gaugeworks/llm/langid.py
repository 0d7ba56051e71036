"""Language identification: multinomial naive Bayes over hashed character n-grams.

The model is learned from labelled rows: n-grams of two and three code points of the lower-case text are hashed to ``BUCKETS``
columns and counted by language; smoothed log-probabilities make a matrix that is broadcast. A batch of documents is a sparse
matrix, a row for each document and an entry for each n-gram, in numpy; its product with the matrix has all scores.

Null texts and texts without a letter have language ``und`` and score 0. Labels that are null aren't learned from. With no
labelled row at all every text is ``und``. Equal scores go to the first language by name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.llm._rows import batches_with, text_column

#: Columns that n-grams are hashed to; lengths of n-grams in code points; smoothing.
BUCKETS, SIZES, ALPHA = 1 << 16, (2, 3), 0.5
#: Labelled rows that are learned from (about so many at most): a bound on the work of the fit. Each label has an equal part
#: of them, and all its rows if they are fewer, so that a rare label is learned however large the table is. The rows are
#: taken by a hash of id and text, so that the sample doesn't depend on their order.
MOST_ROWS, UND = 10_000, "und"
#: Signs that are turned into n-grams at once.
PIECE = 1 << 18
#: Languages that a model tells apart at most: its matrix stays within 64 MB.
MOST_LANGUAGES = 256
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
_BLANK, _END = 32, 0
#: Code points of ASCII that aren't letters are blanks; no text has the sign that ends it.
_PLAIN = np.array([c if 0x61 <= c <= 0x7A else _BLANK for c in range(128)], np.uint32)


def _pieces(texts: list[str]) -> Iterator[list[tuple[int, str, int]]]:
    """(number of the text, signs, how many of them begin an n-gram) of lower-case texts, about ``PIECE`` signs together.

    Long texts come in several pieces, which overlap by an n-gram less one sign, so that none is lost or doubled.
    """
    held, size = [], 0
    for k, text in enumerate(texts):
        low = text.lower()
        for at in range(0, len(low), PIECE):
            part = low[at : at + PIECE + max(SIZES) - 1]
            held.append((k, part, PIECE))
            size += len(part)
            if size >= PIECE:
                yield held
                held, size = [], 0
    if held:
        yield held


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For all n-grams of the texts that don't begin with two blanks: the number of the text, and the bucket; in order of the texts."""
    for held in _pieces(texts):
        signs = np.frombuffer("\0".join([*(part for _, part, _ in held), "\0"]).encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.array([len(part) + 1 for _, part, _ in held])
        ends = np.cumsum(lengths) - 1
        signs = np.where(signs < 128, _PLAIN[np.minimum(signs, 127)], signs)
        signs[ends] = _END
        owner = np.repeat([k for k, _, _ in held], lengths)
        begins = np.ones(len(owner), bool)
        for end, (_, part, most) in zip(ends.tolist(), held, strict=True):
            if len(part) > most:
                begins[end - len(part) + most : end] = False
        for size in SIZES:
            n = len(owner) - size + 1
            if n < 1:
                continue
            ok = begins[:n] & ((signs[:n] != _BLANK) | (signs[1 : n + 1] != _BLANK))
            code = np.full(n, size, np.uint64)
            for j in range(size):
                ok &= signs[j : n + j] != _END
                code = (code ^ signs[j : n + j]) * np.uint64(_FACTORS[j])
            yield owner[:n][ok], (code[ok] >> np.uint64(48)).astype(np.int32)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


@dataclass
class Model:
    languages: list[str]
    log_prior: np.ndarray
    #: BUCKETS x languages
    log_probability: np.ndarray

    def scores(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The language of each text, and its posterior probability."""
        known = [k for k, text in enumerate(texts) if text and self.languages and has_letter(text)]
        predicted, score = [UND] * len(texts), [0.0] * len(texts)
        if not known:
            return predicted, score
        total = np.tile(self.log_prior, (len(known), 1))
        for row, column in grams([texts[k] for k in known]):
            if len(row):
                # the product of the sparse rows with the matrix: an entry for each n-gram, rows one after the other
                first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                total[row[first]] += np.add.reduceat(self.log_probability[column], first, axis=0, dtype=np.float64)
        best = total.argmax(axis=1)
        sure = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        for k, b, s in zip(known, best.tolist(), sure.tolist(), strict=True):
            predicted[k], score[k] = self.languages[b], s
        return predicted, score


def _rates(labelled: DataFrame, label: str, most_rows: int) -> dict[str, float]:
    """The part of each label's rows that is learned from. The labels' counts come to the driver, ``MOST_LANGUAGES`` at most."""
    found = labelled.where(F.col(label).isNotNull()).groupBy(F.col(label).cast("string").alias("lang")).agg(F.count(F.lit(1)).alias("n")).limit(MOST_LANGUAGES + 1).collect()
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} languages")
    out, left = {}, most_rows
    for k, r in enumerate(sorted(found, key=lambda r: r["n"])):  # what small labels leave goes to the larger
        taken = min(r["n"], left // (len(found) - k))
        out[r["lang"]], left = taken / r["n"], left - taken
    return out


def fit(labelled: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "lang", most_rows: int = MOST_ROWS) -> Model:
    """A model of about ``most_rows`` of the labelled rows at most; languages' priors are those of all labelled rows."""
    rates = _rates(labelled, label, most_rows)
    languages = sorted(rates)
    if not languages:
        return Model([], np.zeros(0), np.zeros((BUCKETS, 0), np.float32))
    rate = F.element_at(F.create_map(*[F.lit(x) for pair in rates.items() for x in pair]), F.col("lang"))
    rows = labelled.select(F.col(id_col).alias("id"), F.col(label).cast("string").alias("lang"), F.col(text).alias("text")).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) < rate * float(1 << 30)).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch in batches_with(batches):
            langs = batch.column(0).to_pylist()
            for lang in langs:
                docs[lang] = docs.get(lang, 0) + 1
                sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
            for row, column in grams(text_column(batch, "text")):
                of = np.array(langs)[row]
                for lang in set(langs):
                    sums[lang] += np.bincount(column[of == lang], minlength=BUCKETS)
        for lang, counts in sums.items():
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(some) + 1)), pa.array(np.r_[-1, some], pa.int32()), pa.array(np.r_[docs[lang], counts[some]], pa.int64())], names=["lang", "bucket", "n"])

    counted = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.collect_list("bucket").alias("bucket"), F.collect_list("n").alias("n"))
    found = {r["lang"]: (np.array(r["bucket"]), np.array(r["n"], np.float64)) for r in counted.collect()}  # a row of BUCKETS counts at most for each language
    languages = sorted(found)
    table, prior = np.zeros((BUCKETS, len(languages))), np.zeros(len(languages))
    for k, lang in enumerate(languages):
        bucket, n = found[lang]
        prior[k] = n[bucket == -1].sum() / rates[lang]
        table[bucket[bucket >= 0], k] = n[bucket >= 0]
    smoothed = table + ALPHA
    return Model(languages, np.log(prior / max(prior.sum(), 1)), np.log(smoothed / smoothed.sum(axis=0)).astype(np.float32))


def identified(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the posterior probability of that language. Columns of ``docs`` with these names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_with(batches):
            predicted, score = shared.value.scores(text_column(batch, text))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(predicted, pa.string()), pa.array(score, pa.float64())], names=[*kept, "lang_pred", "score"])

    return docs.mapInArrow(run, T.StructType([*[docs.schema[c] for c in kept], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept from the fit: one in four, by the checksum of its id as text. Null ids are learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def accepted(docs: DataFrame, model: Model, text: str = "text", min_score: float = 0.5) -> DataFrame:
    """The rows whose language can be told: not ``und``, and of ``min_score`` or more.

    The posterior over a whole text is near 1 for any text but a very short one, so that ``min_score`` rejects little.
    """
    shared, columns = docs.sparkSession.sparkContext.broadcast(model), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_with(batches):
            predicted, score = shared.value.scores(text_column(batch, text))
            yield batch.select(columns).filter(pa.array([p != UND and s >= min_score for p, s in zip(predicted, score, strict=True)]))

    return docs.mapInArrow(run, docs.schema)
