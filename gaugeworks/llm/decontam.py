"""Benchmark decontamination by a generalised suffix automaton of the test items.

The automaton is built over the words of the items. Training documents stream through it: at each word it holds the
longest stretch of the document ending there that occurs in some item. Once that stretch has the window's length, the
state of its last words tells the items that hold them.

A benchmark of any size is cut into slices of ``MOST_WORDS`` words (a longer item into pieces that overlap by a window less
one word, so that no window is lost). Executors build an automaton for each slice and write it, as arrays of numbers, to the
shared folder; the driver has the slices' paths alone. A task takes ``GROUP_BYTES`` of documents at a time through one slice
after the other and keeps ``KEPT_BYTES`` of slices, so that its memory doesn't grow with the benchmark. Words stand for
themselves by their XXH64.

Words are stretches of the given signs, A-Z in lower case. A window is ``window`` consecutive words of an item; an item of
fewer, but not none, is one window. Null texts have no words; items without words match nothing. Items that repeat an
item_id count as one; null ids are left out of the list of ids but count, as one.
"""

from __future__ import annotations

import io
import json
import re
import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.llm._io import file_system, new_path, written
from gaugeworks.llm._rows import batches_with, text_column

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes that aren't part of a word become blanks, A-Z lower-case.
_PLAIN = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))
MATCH_FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("n_items", T.LongType()),
]
#: Words of items in one slice, and in one piece of an item. Building a full slice takes some 150 MB, its arrays some 15 MB.
MOST_WORDS, PIECE_WORDS = 250_000, 20_000
#: Bytes of documents that are taken through all slices together; bytes of slices that a worker keeps.
GROUP_BYTES, KEPT_BYTES = 32 << 20, 128 << 20


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_PLAIN).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


class Automaton:
    """A suffix automaton of several word sequences, with the items that hold each window, in arrays.

    A state's moves are a stretch of ``codes`` and ``targets``, sorted by code; so are its items one of ``held``.
    """

    ARRAYS = ("vocabulary", "pairs", "moves", "codes", "targets", "link", "length", "home", "items", "held", "short", "whole", "held_whole", "names", "numbers")

    def __init__(self, items: list[tuple[str | None, np.ndarray]], window: int):
        items = [(item, hashes) for item, hashes in items if len(hashes)]
        vocabulary = np.unique(np.concatenate([h for _, h in items])) if items else np.zeros(0, np.uint64)
        names: dict[str | None, int] = {}
        coded = [(names.setdefault(item, len(names)), np.searchsorted(vocabulary, hashes).tolist()) for item, hashes in items]
        self._next: list[dict[int, int]] = [{}]
        self._link, self._length = [-1], [0]
        ends = []
        for _, codes in coded:
            last, path = 0, []
            for c in codes:
                last = self._extend(last, c)
                path.append(last)
            ends.append(path)
        moves, link, length = self._next, np.array(self._link, np.int32), np.array(self._length, np.int32)
        del self._next, self._link, self._length
        states = len(moves)
        # the state of a state's last `window` words; the nearest one, itself included, that ends a short item
        by_length = np.argsort(length, kind="stable").tolist()
        home = np.full(states, -1, np.int32)
        for s in by_length:
            if length[s] >= window:
                home[s] = s if length[link[s]] < window else home[link[s]]
        own, whole = set(), set()
        for (item, codes), path in zip(coded, ends, strict=True):
            if len(codes) < window:
                whole.add((self._at(moves, codes), item))
            else:
                # a state may have been split after it was reached: its place is found anew
                s = 0
                for k, c in enumerate(codes):
                    s = moves[s][c]
                    if k + 1 >= window:
                        own.add((int(home[s]), item))
        short = np.zeros(states, np.int32)
        for s, _ in whole:
            short[s] = s
        for s in by_length[1:] if whole else ():
            if not short[s]:
                short[s] = short[link[s]]
        size = max(1, len(vocabulary))
        pairs = np.unique(np.concatenate([np.array(c[:-1], np.int64) * size + np.array(c[1:], np.int64) for _, c in coded])) if coded else np.zeros(0, np.int64)
        at = np.cumsum([0, *map(len, moves)], dtype=np.int32)
        sorted_moves = [m for by in moves for m in sorted(by.items())]
        text = json.dumps([*names]).encode()
        self._set(
            vocabulary=vocabulary, pairs=pairs, moves=at, codes=np.array([c for c, _ in sorted_moves], np.int32), targets=np.array([t for _, t in sorted_moves], np.int32),
            link=link, length=length, home=home, **dict(zip(("items", "held"), _stretches(own, states), strict=True)), short=short, **dict(zip(("whole", "held_whole"), _stretches(whole, states), strict=True)),
            names=np.frombuffer(text, np.uint8), numbers=np.array([window, min([window, *(len(c) for _, c in coded)])], np.int64),
        )

    def _set(self, **arrays: np.ndarray) -> None:
        self.arrays = arrays
        self.bytes = sum(a.nbytes for a in arrays.values())
        self.window, self.least = map(int, arrays["numbers"])
        self.item_names: list[str | None] = json.loads(arrays["names"].tobytes())
        self.size = max(1, len(arrays["vocabulary"]))
        # single numbers are read faster from these than from numpy's arrays
        self.views = {k: memoryview(np.ascontiguousarray(arrays[k])) for k in ("moves", "codes", "targets", "link", "length", "home", "items", "held", "short", "whole", "held_whole")}

    def packed(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self.arrays)
        return out.getvalue()

    @classmethod
    def unpacked(cls, raw: bytes) -> Automaton:
        made = cls.__new__(cls)
        with np.load(io.BytesIO(raw), allow_pickle=False) as found:
            made._set(**{k: found[k] for k in cls.ARRAYS})
        return made

    @staticmethod
    def _at(moves: list[dict[int, int]], codes: list[int]) -> int:
        state = 0
        for c in codes:
            state = moves[state][c]
        return state

    def _extend(self, last: int, c: int) -> int:
        if c in self._next[last]:
            q = self._next[last][c]
            return q if self._length[q] == self._length[last] + 1 else self._split(last, c, q)
        new = self._state(self._length[last] + 1, {})
        p = last
        while p >= 0 and c not in self._next[p]:
            self._next[p][c] = new
            p = self._link[p]
        if p < 0:
            self._link[new] = 0
        else:
            q = self._next[p][c]
            self._link[new] = q if self._length[q] == self._length[p] + 1 else self._split(p, c, q)
        return new

    def _state(self, length: int, moves: dict[int, int]) -> int:
        self._next.append(moves)
        self._link.append(0)
        self._length.append(length)
        return len(self._next) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        clone = self._state(self._length[p] + 1, dict(self._next[q]))
        self._link[clone], self._link[q] = self._link[q], clone
        while p >= 0 and self._next[p].get(c) == q:
            self._next[p][c] = clone
            p = self._link[p]
        return clone

    def codes_of(self, hashes: np.ndarray) -> np.ndarray:
        """The vocabulary's number of each word, -1 for those that it doesn't have."""
        vocabulary = self.arrays["vocabulary"]
        if not len(vocabulary):
            return np.full(len(hashes), -1, np.int64)
        at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
        return np.where(vocabulary[at] == hashes, at, -1)

    def stretches(self, codes: np.ndarray) -> Iterator[tuple[int, int]]:
        """Parts of a document that can hold a window: known words, each two of which stand together in some item."""
        if self.least < 2:
            ok = codes >= 0
            edge = np.flatnonzero(np.diff(np.r_[0, ok.view(np.int8), 0]))
            yield from zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)
            return
        pairs = self.arrays["pairs"]
        if len(codes) < self.least or not len(pairs):
            return
        pair = np.where((codes[:-1] >= 0) & (codes[1:] >= 0), codes[:-1] * self.size + codes[1:], -2)
        at = np.minimum(np.searchsorted(pairs, pair), len(pairs) - 1)
        ok = pairs[at] == pair
        edge = np.flatnonzero(np.diff(np.r_[0, ok.view(np.int8), 0]))
        starts, ends = edge[::2], edge[1::2]
        long = ends - starts >= self.least - 1
        yield from zip(starts[long].tolist(), (ends[long] + 1).tolist(), strict=True)

    def _move(self, state: int, c: int) -> int:
        moves, codes = self.views["moves"], self.views["codes"]
        low, high = moves[state], moves[state + 1]
        while high - low > 8:
            mid = (low + high) // 2
            if codes[mid] <= c:
                low = mid
            else:
                high = mid
        for k in range(low, high):
            if codes[k] == c:
                return self.views["targets"][k]
        return -1

    def match(self, hashes: np.ndarray) -> Iterator[tuple[int, int, list[int]]]:
        """Places that windows end at: the word after, the words covered, and the items (by number) whose windows they are."""
        v = self.views
        link, length, home, items, held, short, whole, held_whole = (v[k] for k in ("link", "length", "home", "items", "held", "short", "whole", "held_whole"))
        codes, window, move = self.codes_of(hashes), self.window, self._move
        for first, end in self.stretches(codes):
            state, size = 0, 0
            for k, c in enumerate(codes[first:end].tolist(), first):
                to = move(state, c)
                while to < 0 and state:
                    state = link[state]
                    size = length[state]
                    to = move(state, c)
                if to < 0:
                    size = 0
                    continue
                state, size = to, size + 1
                hit, found = 0, []
                if size >= window:
                    h = home[state]
                    found, hit = held[items[h] : items[h + 1]].tolist(), window
                t = short[state]
                while t:
                    if length[t] <= size:
                        found += held_whole[whole[t] : whole[t + 1]].tolist()
                        hit = max(hit, length[t])
                    t = short[link[t]]
                if hit:
                    yield k + 1, hit, found


def _stretches(pairs: set[tuple[int, int]], states: int) -> tuple[np.ndarray, np.ndarray]:
    """For each state where its items begin in the array of all items, and that array."""
    found = np.array(sorted(pairs), np.int32).reshape(-1, 2)
    return np.searchsorted(found[:, 0], np.arange(states + 1)).astype(np.int32), np.ascontiguousarray(found[:, 1])


def slices(benchmark: DataFrame, id_col: str, text: str, window: int) -> list[str]:
    """The paths of the benchmark's automata, of ``MOST_WORDS`` words each at most."""
    spark = benchmark.sparkSession

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_with(batches):
            out = []
            for item, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                hashes = word_hashes(words_of(x)).view(np.int64)
                starts = range(0, max(1, len(hashes) - window + 1), max(1, PIECE_WORDS - window + 1)) if len(hashes) else ()
                out += [(item, k, hashes[k : k + PIECE_WORDS]) for k in starts]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.list_(pa.int64()))], names=["item", "start", "words"])

    pieces = written(benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text).alias("text")).mapInArrow(cut, "item string, start long, words array<long>").distinct(), "benchmark")
    total = pieces.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    folder = new_path(spark, "automata")
    most = MOST_WORDS

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        size = 0

        def flush() -> pa.RecordBatch:
            # every attempt writes files of its own; the table has those of the attempts that counted
            system, path = file_system(where := f"{folder}/{uuid.uuid4().hex}.npz")
            system.create_dir(path.rpartition("/")[0], recursive=True)
            with system.open_output_stream(path) as f:
                f.write(Automaton(held, window).packed())
            return pa.RecordBatch.from_arrays([pa.array([where])], names=["path"])

        for batch in batches:
            for k in range(batch.num_rows):
                words = batch.column(1)[k].values.to_numpy(zero_copy_only=False).view(np.uint64)
                if held and size + len(words) > most:
                    yield flush()
                    held, size = [], 0
                held.append((batch.column(0)[k].as_py(), words))
                size += len(words)
        if held:
            yield flush()

    made = pieces.repartition(max(1, -(-total // most)), "item", "start").select("item", "words").mapInArrow(build, "path string")
    return [r["path"] for r in written(made, "slices").orderBy("path").collect()]


_kept: OrderedDict[str, Automaton] = OrderedDict()


def _loaded(path: str, most: int) -> Automaton:
    """A slice, read once for each worker process as long as ``most`` bytes hold it."""
    if path in _kept:
        _kept.move_to_end(path)
        return _kept[path]
    system, name = file_system(path)
    with system.open_input_stream(name) as f:
        made = Automaton.unpacked(f.read())
    while _kept and sum(a.bytes for a in _kept.values()) + made.bytes > most:
        _kept.popitem(last=False)
    _kept[path] = made
    return made


def _found(texts: list[str | None], paths: list[str], most: int) -> list[tuple[int, list[tuple[int, int]], set]]:
    """For each text its number of words, the stretches of them that windows cover, and the items whose windows occur."""
    hashes = [word_hashes(words_of(x)) for x in texts]
    # all texts in one array, with a word that no item has between them
    starts = np.cumsum([0, *(len(h) + 1 for h in hashes)])
    gap = np.zeros(1, np.uint64)
    whole = np.concatenate([x for h in hashes for x in (h, gap)]) if hashes else gap
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[set] = [set() for _ in texts]
    for path in paths:
        a = _loaded(path, most)
        row = 0
        for end, size, found in a.match(whole):
            if end > starts[row + 1]:
                row = int(np.searchsorted(starts, end - 1, side="right")) - 1
            at = end - int(starts[row])
            mine = spans[row]
            if mine and mine[-1][1] >= at - size and mine[-1][0] <= at - size:
                mine[-1] = (mine[-1][0], max(at, mine[-1][1]))
            else:
                mine.append((at - size, at))
            items[row].update(found if len(paths) == 1 else [a.item_names[i] for i in found])
    if len(paths) == 1:
        names = _loaded(paths[0], most).item_names
        items = [{names[i] for i in found} for found in items]
    return [(len(h), _union(s), i) for h, s, i in zip(hashes, spans, items, strict=True)]


def _grouped(batches: Iterator[pa.RecordBatch], text: str, paths: list[str], limits: tuple[int, int]) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Batches with what :func:`_found` says of their texts; with several slices as many bytes of documents as ``limits`` has first go through them together."""
    held, size = [], 0
    for batch in batches_with(batches):
        held.append(batch)
        size += batch.nbytes
        if len(paths) < 2 or size >= limits[0]:
            yield from _group(held, text, paths, limits[1])
            held, size = [], 0
    yield from _group(held, text, paths, limits[1])


def _group(held: list[pa.RecordBatch], text: str, paths: list[str], most: int) -> Iterator[tuple[pa.RecordBatch, list]]:
    found = _found([x for b in held for x in text_column(b, text)], paths, most) if held else []
    at = 0
    for batch in held:
        yield batch, found[at : at + batch.num_rows]
        at += batch.num_rows


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 8) -> DataFrame:
    """``docs`` with ``n_words`` (long), ``spans`` (array of first and end word) and ``items`` (ids as strings, sorted) and ``n_items``.

    Columns of ``docs`` with these names are replaced. Each row is settled by itself, so ids may repeat or be null.
    """
    paths, limits = slices(benchmark, item_col, item_text, window), (GROUP_BYTES, KEPT_BYTES)
    kept = [c for c in docs.columns if c not in ("n_words", "spans", "items", "n_items")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))
        for batch, found in _grouped(batches, text, paths, limits):
            counts = [n for n, _, _ in found]
            spans = [[{"first": a, "end": b} for a, b in s] for _, s, _ in found]
            items = [sorted(i for i in ids if i is not None) for _, _, ids in found]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(counts, pa.int64()), pa.array(spans, span), pa.array(items, pa.list_(pa.string())), pa.array([len(ids) for _, _, ids in found], pa.int64())],
                names=[*kept, "n_words", "spans", "items", "n_items"],
            )

    schema = T.StructType([docs.schema[c] for c in kept] + MATCH_FIELDS)
    return docs.mapInArrow(run, schema)


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


_WORDS = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without some stretches of its words; what separates the words inside goes with them."""
    raw = text.encode("utf-8", "surrogatepass")
    places, out, at = [m.span() for m in _WORDS.finditer(raw)], [], 0
    for first, end in spans:
        out.append(raw[at : places[first][0]])
        at = places[end - 1][1]
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def cleaned(docs: DataFrame, benchmark: DataFrame, text: str = "text", chars: str | None = "n_chars", window: int = 8, longest: int = 50, coverage: float = 0.1, item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without benchmark passages.

    A document goes if it holds windows of two items or more, if a matched span reaches ``longest`` words, or if spans cover
    the share ``coverage`` of its words; of the others the matched words are cut out, and ``chars`` is counted anew.
    Documents without a match stay as they are, nulls included.
    """
    paths, limits = slices(benchmark, item_col, item_text, window), (GROUP_BYTES, KEPT_BYTES)
    columns = docs.columns
    counted = chars in columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _grouped(batches, text, paths, limits):
            texts, stays, new_counts = text_column(batch, text), [], batch.column(chars).to_pylist() if counted else []
            for k, (n, spans, items) in enumerate(found):
                sizes = [b - a for a, b in spans]
                stays.append(not spans or (len(items) < 2 and max(sizes) < longest and sum(sizes) < coverage * n))
                if spans and stays[-1]:
                    texts[k] = without_spans(texts[k], spans)
                    if counted:
                        new_counts[k] = len(texts[k])
            new = {text: pa.array(texts, batch.schema.field(text).type)}
            if counted:
                new[chars] = pa.array(new_counts, batch.schema.field(chars).type)
            yield pa.RecordBatch.from_arrays([new.get(c, batch.column(c)) for c in columns], names=columns).filter(pa.array(stays))

    return docs.mapInArrow(run, docs.schema)
