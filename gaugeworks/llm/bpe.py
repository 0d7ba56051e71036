"""Byte-level BPE: encoding, decoding and token counts of whole texts.

The merge loop keeps, for each word, a contiguous array of its parts with the rank of every adjacent pair; it scans for
the smallest rank, deletes that boundary and refreshes the two neighbouring ranks. Words of one size take their steps
side by side, as rows of one array. The array is scanned whole for each merge, so words from ``LONG_WORD`` bytes, where
that grows with the square, take the same merges in the same order from a heap over linked parts instead.

Null texts count as empty; an empty text has no tokens.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from gaugeworks.llm._rows import batches_with, text_column

#: Bytes from which a word's parts are kept in a heap rather than scanned.
LONG_WORD = 200
#: Words whose tokens a worker remembers; then it starts afresh.
REMEMBERED = 200_000
_NONE = 1 << 40


@lru_cache(maxsize=1)
def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if visible, else the next free letter."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


#: Kinds of code points: any other sign, letter, number, white space, end of a text.
OTHER, LETTER, NUMBER, SPACE, END = range(5)


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """The kind of each code point, as the pre-tokenizer's ``\\p{L}``, ``\\p{N}`` and ``\\s`` see it."""
    table = np.zeros(sys.maxunicode + 1, np.uint8)
    for c in range(sys.maxunicode + 1):
        category = unicodedata.category(chr(c))
        if category[0] in "LNZ":
            table[c] = {"L": LETTER, "N": NUMBER, "Z": SPACE}[category[0]]
    table[[9, 10, 11, 12, 13, 0x85]] = SPACE
    return table


def split_words(texts: list[str]) -> list[list[str]]:
    """The words of each text: contractions, and runs of letters, of numbers and of other signs, each with one blank before it, and what is left of white space.

    Same words as the pattern ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``, found for all texts at once.
    """
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    whole = "\n".join([*texts, ""])
    code = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(lengths + 1) - 1
    kind = kinds()[code]
    kind[ends] = END
    start = np.ones(len(code) + 3, bool)
    start[1 : len(code)] = kind[1:] != kind[:-1]
    # the last sign of white space before a word is a word's own start; a blank takes the word with it
    after = np.flatnonzero((kind[1:] < SPACE) & (kind[:-1] == SPACE)) + 1
    start[after - 1] = True
    start[after] = code[after - 1] != 32
    at = np.flatnonzero(code == 39)
    at = at[start[at] & (kind[np.minimum(at + 1, len(code) - 1)] == LETTER)]
    if len(at):
        padded = np.append(code, [0, 0])
        one, two = padded[at + 1], padded[at + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = (two == ord("e")) & ((one == ord("r")) | (one == ord("v"))) | (one == ord("l")) & (two == ord("l"))
        cut = at[short | long]
        start[cut + 1] = False
        start[at[short] + 2] = True
        # letters of a long contraction: nothing starts inside it
        start[at[long] + 2] = False
        start[at[long] + 3] = True
    start[ends] = True
    start[ends[:-1] + 1] = True
    places = np.flatnonzero(start[: len(code)])
    bounds = np.searchsorted(places, ends).tolist()
    p = places.tolist()
    words = [whole[a:b] for a, b in zip(p, p[1:], strict=False)]
    first, out = 0, []
    for end in bounds:
        out.append(words[first:end])
        first = end + 1
    return out


#: Settings of a model that change its tokens and aren't done here.
_REFUSED = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")


def check(spec: dict) -> None:
    """Refuses a tokenizer with a part that isn't done here; truncation, padding and post-processing don't matter to tokens."""
    model, splitter = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or splitter.get("type") != "ByteLevel":
        raise ValueError("a byte-level BPE vocabulary is needed")
    wrong = [k for k in _REFUSED if model.get(k)]
    wrong += [k for k in ("normalizer",) if spec.get(k)]
    wrong += ["add_prefix_space"] if splitter.get("add_prefix_space") else []
    wrong += ["use_regex off"] if splitter.get("use_regex") is False else []
    wrong += ["decoder"] if (spec.get("decoder") or {}).get("type") != "ByteLevel" else []
    wrong += [f"{k} of {x['content']!r}" for x in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip") if x.get(k)]
    if wrong:
        raise ValueError(f"not supported: {', '.join(wrong)}")


class Vocabulary:
    """A byte-level BPE vocabulary read from the text of a ``tokenizer.json``; one with parts that aren't done here is refused."""

    def __init__(self, source: str):
        spec = json.loads(source)
        check(spec)
        model, letters = spec["model"], byte_letters()
        ids: dict[str, int] = model["vocab"]
        self.added: dict[str, int] = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        size = 1 + max([*ids.values(), *self.added.values()])
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in ids.items():
            self.bytes_of[i] = bytes(letters[c] for c in token)
        for content, i in self.added.items():
            self.bytes_of[i] = content.encode()
        self.digits = [str(i) for i in range(size)]
        self.single = [ids[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        pairs = [pair.split(" ") if isinstance(pair, str) else pair for pair in model["merges"]]
        #: The rank of a pair, by left id * 2**32 + right id, and the id that each rank makes.
        self.ranks: dict[int, int] = {ids[x] << 32 | ids[y]: rank for rank, (x, y) in enumerate(pairs)}
        self.made = np.array([ids[x + y] for x, y in pairs] or [0], np.int64)
        self._keys = np.array(sorted(self.ranks) or [-1], np.int64)
        self._ranks = np.array([self.ranks[k] for k in self._keys.tolist()] if self.ranks else [_NONE], np.int64)
        first = np.array(self.single, np.int64)
        self._byte_ranks = self._look(np.repeat(first, 256), np.tile(first, 256)).reshape(256, 256)
        found = "|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True))
        self.special = re.compile(f"({found})") if found else None
        #: By word: its decimal ids, comma-joined, and the bytes that these ids stand for.
        self.spelling: dict[str, str] = {}
        self.meaning: dict[str, bytes] = {}

    def _look(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._ranks[at], _NONE)

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """The token ids of each word."""
        out: list[list[int]] = [[] for _ in words]
        by_size: dict[int, list[int]] = {}
        for k, word in enumerate(words):
            if len(word) < LONG_WORD:
                by_size.setdefault(len(word), []).append(k)
            else:
                out[k] = self._heap([self.single[b] for b in word])
        for size, places in by_size.items():
            for at in range(0, len(places), 20_000):
                some = places[at : at + 20_000]
                signs = np.frombuffer(b"".join([words[k] for k in some]), np.uint8).reshape(len(some), size)
                for rows, parts in self._scan(signs):
                    for k, ids in zip(rows.tolist(), parts.tolist(), strict=True):
                        out[some[k]] = ids
        return out

    def _scan(self, signs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The merges of many words of one size side by side; yields words (by place) that end with equally many parts."""
        parts = np.array(self.single, np.int64)[signs]
        ranks = self._byte_ranks[signs[:, :-1], signs[:, 1:]]
        rows = np.arange(len(signs))
        while parts.shape[1] > 1:
            best = ranks.min(axis=1)
            done = best >= _NONE
            if done.any():
                yield rows[done], parts[done]
                rows, parts, ranks, best = rows[~done], parts[~done], ranks[~done], best[~done]
                if not len(rows):
                    return
            at, each = ranks.argmin(axis=1), np.arange(len(rows))
            width = parts.shape[1]
            parts[each, at] = self.made[best]
            stay = np.arange(width - 1) + (np.arange(width - 1) > at[:, None])
            parts = np.take_along_axis(parts, stay, axis=1)
            ranks = np.take_along_axis(ranks, np.arange(width - 2) + (np.arange(width - 2) >= at[:, None]), axis=1)
            for side in (at - 1, at):
                ok = np.flatnonzero((side >= 0) & (side < width - 2))
                ranks[ok, side[ok]] = self._look(parts[ok, side[ok]], parts[ok, side[ok] + 1])
        if len(rows):
            yield rows, parts

    def _heap(self, parts: list[int]) -> list[int]:
        rank_of, n = self.ranks.get, len(parts)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        queue = [(rank, i, parts[i], parts[i + 1]) for i in range(n - 1) if (rank := rank_of(parts[i] << 32 | parts[i + 1], _NONE)) < _NONE]
        heapq.heapify(queue)
        while queue:
            rank, i, left, right = heapq.heappop(queue)
            j = after[i]
            if parts[i] != left or j >= n or parts[j] != right:
                continue
            parts[i], parts[j] = int(self.made[rank]), -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (rank := rank_of(parts[a] << 32 | parts[b], _NONE)) < _NONE:
                    heapq.heappush(queue, (rank, a, parts[a], parts[b]))
        return [p for p in parts if p >= 0]

    def learn(self, words: set[str]) -> None:
        """Merges the words that aren't known yet."""
        if len(self.spelling) + len(words) > REMEMBERED:
            self.spelling.clear()
            self.meaning.clear()
        new = [w for w in words if w not in self.spelling]
        for word, ids in zip(new, self.merge([w.encode("utf-8", "surrogatepass") for w in new]), strict=True):
            self.spelling[word] = ",".join(map(self.digits.__getitem__, ids))
            self.meaning[word] = b"".join(map(self.bytes_of.__getitem__, ids))

    def words(self, texts: list[str]) -> Iterator[list[str]]:
        """The words of each text, all of them known; special tokens in a text stay words of their own."""
        plain, marks = texts, {}
        if self.special:
            plain = []
            for k, text in enumerate(texts):
                parts = self.special.split(text)
                marks[k] = parts[1::2]
                plain += parts[::2]
        found = split_words(plain)
        known = self.spelling
        if new := {w for words in found for w in words if w not in known}:
            if len(known) + len(new) > REMEMBERED:
                new = {w for words in found for w in words}
            self.learn(new)
        for mark, i in self.added.items():
            self.spelling[mark], self.meaning[mark] = self.digits[i], self.bytes_of[i]
        parts = iter(found)
        for k in range(len(texts)):
            words = next(parts)
            for mark in marks.get(k, ()):
                words = [*words, mark, *next(parts)]
            yield words

    def spell(self, words: list[str]) -> str:
        """The decimal ids of words, comma-joined."""
        return ",".join(map(self.spelling.__getitem__, words))

    def read(self, words: list[str]) -> str:
        """The text that the ids of these words decode to."""
        return b"".join(map(self.meaning.__getitem__, words)).decode("utf-8", "replace")

    def encode(self, text: str) -> list[int]:
        spelled = self.spell(next(self.words([text])))
        return [*map(int, spelled.split(","))] if spelled else []

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(source: str) -> Vocabulary:
    """The vocabulary, built once for each worker process, so that later tasks find its words known."""
    key = hashlib.sha256(source.encode()).hexdigest()
    if key not in _vocabularies:
        _vocabularies[key] = Vocabulary(source)
    return _vocabularies[key]


def shipped(spark: SparkSession, path: str, most: int = 64_000_000):
    """The vocabulary file's text as a broadcast; a file of over ``most`` bytes is refused."""
    with open(path, encoding="utf-8") as f:
        source = f.read(most + 1)
    if len(source) > most:
        raise ValueError(f"{path}: a vocabulary of over {most} bytes isn't broadcast")
    return spark.sparkContext.broadcast(source)


def encoded(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens`` (long), ``ids`` (the decimal ids, comma-joined) and ``decoded`` (the text made of them again).

    Columns of ``docs`` with these names are replaced.
    """
    return _applied(docs, path, text, {"n_tokens": pa.int64(), "ids": pa.string(), "decoded": pa.string()}, _whole)


def encoded_digests(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """As :func:`encoded`, with ``ids_sha256`` and ``decoded_sha256`` in place of the ids and the decoded text."""
    return _applied(docs, path, text, {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}, _digests)


def token_counts(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens`` (long)."""
    return _applied(docs, path, text, {"n_tokens": pa.int64()}, _counts)


def _whole(v: Vocabulary, words: list[str]) -> tuple:
    return (ids := v.spell(words)).count(",") + bool(ids), ids, v.read(words)


def _digests(v: Vocabulary, words: list[str]) -> tuple:
    n, ids, decoded = _whole(v, words)
    return n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def _counts(v: Vocabulary, words: list[str]) -> tuple:
    return ((ids := v.spell(words)).count(",") + bool(ids),)


def _applied(docs: DataFrame, path: str, text: str, new: dict, of) -> DataFrame:
    source = shipped(docs.sparkSession, path)
    kept = [c for c in docs.columns if c not in new]
    types = {pa.int64(): T.LongType(), pa.string(): T.StringType()}
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(c, types[k]) for c, k in new.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(source.value)
        for batch in batches_with(batches):
            rows = [of(v, words) for words in v.words([x or "" for x in text_column(batch, text)])]
            made = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(new.values())]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + made, names=[*kept, *new])

    return docs.mapInArrow(run, schema)
