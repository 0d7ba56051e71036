"""Near-duplicate documents by SimHash, linked through a pigeonring filter.

A fingerprint is cut into segments on a ring. If two fingerprints differ in at most ``limit`` bits, some segment starts a
chain whose first k segments differ in at most k * limit / m bits together, for every k up to the number m of segments
(pigeonring). With 64 bits, five segments and a limit of four the first segment has to agree and the first two differ in one
bit at most: those two segments are the candidates' key, and the links are exact (:func:`near_duplicates`).

Texts of five-word shingles that are alike by 0.8 differ in 15 % of their bits, where no segment need agree
(:func:`similar_documents`): there the candidates' keys are minima of the shingles' hashes, fingerprints have 256 bits, the
ring prunes the candidates, and what it leaves is checked by ``MINIMA`` minima, whose equal share is the sets' likeness.

Texts are compared by distinct fingerprint, so copies add no pairs, and links are reported as spanning forests rather than
all pairs. Large buckets are dealt to blocks, each with the same few members as pivots: what a block finds connected to a
pivot is one tree over all blocks, and only what isn't has to meet the other blocks (:func:`links`).

Null texts count as empty; a text without words has fingerprint zero, which links like any other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.llm._io import released, written
from gaugeworks.llm._joins import split_join
from gaugeworks.llm._rows import batches_with, fresh, text_column

#: Widths of the ring's segments, from the highest bit; bits that linked fingerprints differ in at most.
WIDTHS, LIMIT = (13, 13, 13, 13, 12), 4
M = len(WIDTHS)
SHIFTS = tuple(64 - sum(WIDTHS[: k + 1]) for k in range(M))
MASKS = tuple(((1 << w) - 1) << s for w, s in zip(WIDTHS, SHIFTS, strict=True))
#: Words of 64 bits of a wide fingerprint; bands of minima, and minima in a band.
WIDE, BANDS, ROWS = 4, 8, 3
#: Minima of a text's shingles, of which two bits each are held, and words of 64 bits that these take.
MINIMA = 512
PACKED = MINIMA // 32
#: Standard deviations by which an estimate may miss: of bits that differ, where the ring prunes, and of minima that agree.
RING_SLACK, MINIMA_SLACK = 2.5, 1.3
_FACTORS = np.array([(0xD6E8FEB86659FD93 * (2 * k + 1) ^ k << 40) & (1 << 64) - 1 | 1 for k in range(MINIMA)], np.uint64)
#: Members of a bucket that one task compares with the rest at once; members that all blocks of a bucket have.
BLOCK, PIVOTS = 4096, 16
#: Large buckets that are broadcast, by key and a few numbers; more are joined by a shuffle that splits hot keys.
FEW = 100_000


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """The XXH64 (seed 42) of each shingle, repeats included; of the whole text if it has fewer words."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    whole, at, ends = b" ".join(parts), [0], []
    for p in parts:
        ends.append(at[-1] + len(p))
        at.append(ends[-1] + 1)
    size = min(words, len(parts))
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(whole[a:b], 42) for a, b in zip(at, ends[size - 1 :], strict=False)]), ">u8").astype(np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 255 * 256):
        some = hashes[k : k + 255 * 256]
        bits = np.unpackbits(some.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        whole = len(bits) // 255 * 255  # 255 ones fit into a byte
        ones += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64) + bits[whole:].sum(axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None, words: int = 4) -> int:
    """A bit is set if over half of the shingles' hashes have it."""
    return majority(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 4) -> DataFrame:
    """``id_col`` and ``fp`` (the fingerprint as a signed long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_with(batches):
            found = np.array([fingerprint(x, words) for x in text_column(batch, text)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(found)], names=[id_col, "fp"])

    schema = T.StructType([docs.schema[id_col], T.StructField("fp", T.LongType())])
    return docs.select(id_col, text).mapInArrow(run, schema)


def _keys(fp: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(key, place in fp, side) of each entry: side 0 by its own two segments, side 1 with one zero bit of the second set."""
    out = []
    for k in range(M):
        a, b = k, (k + 1) % M
        first = (fp & np.uint64(MASKS[a])) >> np.uint64(SHIFTS[a])
        second = (fp & np.uint64(MASKS[b])) >> np.uint64(SHIFTS[b])
        head = np.uint64(k << 32) | first << np.uint64(13)
        place = np.arange(len(fp))
        out.append((head | second, place, np.zeros(len(fp), np.int8)))
        for bit in range(WIDTHS[b]):
            zero = np.flatnonzero(second >> np.uint64(bit) & np.uint64(1) == 0)
            out.append((head[zero] | second[zero] | np.uint64(1 << bit), zero, np.ones(len(zero), np.int8)))
    return out


def entries(fps: DataFrame) -> DataFrame:
    """For each distinct fingerprint its bucket entries: key, side, id and w0, both the fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                fp = batch.column(0).slice(at, 20_000).to_numpy(zero_copy_only=False).view(np.uint64)
                for key, place, side in _keys(fp):
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(side), pa.array(fp[place].view(np.int64))], names=["key", "side", "id"])

    return fps.select("fp").mapInArrow(run, "key long, side byte, id long").withColumn("w0", F.col("id"))


class Ring:
    """Whether fingerprints of 64 bits differ in ``LIMIT`` bits at most, the key's chain first."""

    words = 1

    def near(self, a: np.ndarray, b: np.ndarray, start: np.ndarray | int) -> np.ndarray:
        """For pairs whose chain of two segments from ``start`` fits: chains of three and four, then all bits."""
        x = (a ^ b)[..., 0]
        ok = np.ones(x.shape, bool)
        for length in (3, 4):
            masks = np.array([np.bitwise_or.reduce([np.uint64(MASKS[(k + j) % M]) for j in range(length)]) for k in range(M)], np.uint64)
            ok &= np.bitwise_count(x & masks[start]) <= length * LIMIT // M
        return ok & (np.bitwise_count(x) <= LIMIT)


class WideRing:
    """Whether texts are alike: fingerprints of 256 bits that differ in ``limit`` bits at most, a segment for each word, chains
    of one to three first; then ``least`` equal ones among the minima's two bits."""

    words = WIDE + PACKED

    def __init__(self, similarity: float):
        self.limit, self.least = bits_apart(similarity), minima_alike(similarity)

    def near(self, a: np.ndarray, b: np.ndarray, start: np.ndarray | int) -> np.ndarray:
        parts = np.bitwise_count(a[..., :WIDE] ^ b[..., :WIDE])
        least = parts[..., 0]
        for k in range(1, WIDE):
            least = np.minimum(least, parts[..., k])
        # few pairs have a segment within its own budget: longer chains, all bits and the minima are counted for these alone
        some = np.nonzero(least <= self.limit // WIDE)
        part = parts[some].astype(np.int16)
        chain, alive = np.zeros(part.shape, np.int16), np.ones(part.shape, bool)
        for length in range(1, WIDE + 1):
            chain += np.roll(part, 1 - length, axis=-1)
            alive &= chain * WIDE <= length * self.limit
        ok = alive.any(axis=-1)
        left = tuple(x[ok] for x in some)
        shape = np.broadcast_shapes(a.shape, b.shape)
        unlike = np.broadcast_to(a, shape)[left][..., WIDE:] ^ np.broadcast_to(b, shape)[left][..., WIDE:]
        unlike |= unlike >> np.uint64(1)
        equal = MINIMA - np.bitwise_count(unlike & np.uint64(0x5555555555555555)).sum(axis=-1, dtype=np.int64)
        out = np.zeros(least.shape, bool)
        out[left] = equal >= self.least
        return out


class _Forest:
    """Union-find that tells which links join two trees."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        path = []
        while (y := self.up.get(x, x)) != x:
            path.append(x)
            x = y
        for p in path:
            self.up[p] = x
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def _bucket_links(ring, ids: np.ndarray, index: np.ndarray, probes: Iterator[tuple[np.ndarray, np.ndarray]], start: int, forest: _Forest | None = None) -> Iterator[tuple[list[int], list[int]]]:
    """The links that join a block's members, and the probes, into trees."""
    forest, left, right = forest or _Forest(), [], []
    # breadth first: what one member reaches isn't compared again with each other
    rest = np.arange(len(ids))
    while len(rest):
        todo, rest = [int(rest[0])], rest[1:]
        while todo and len(rest):
            x = todo.pop()
            near = ring.near(index[rest], index[x], start)
            if near.any():
                for y in rest[near].tolist():
                    if forest.join(int(ids[x]), int(ids[y])):
                        left.append(int(ids[x]))
                        right.append(int(ids[y]))
                    todo.append(y)
                rest = rest[~near]
    yield left, right
    # most members of a large bucket are one tree: a probe that is near to one of some members of it needs no look at the others
    roots = np.array([forest.root(x) for x in ids.tolist()], np.int64)
    name, sizes = np.unique(roots, return_counts=True)
    tree = np.flatnonzero(roots == name[np.argmax(sizes)])
    others = np.flatnonzero(roots != name[np.argmax(sizes)])
    step = max(1, (1 << 20) // max(1, len(ids) * ring.words))
    for names, some in probes:
        left, right = [], []

        def join(i: int, j: int, names=names, left=left, right=right) -> None:
            a, b = int(names[i]), int(ids[j])
            if a != b and forest.join(a, b):
                left.append(a)
                right.append(b)

        open_ = np.arange(len(some))
        for j in tree[:: max(1, len(tree) // PIVOTS)][:PIVOTS].tolist():
            near = ring.near(some[open_], index[j], start)
            for i in open_[near].tolist():
                join(i, j)
            open_ = open_[~near]
        for rows, against in ((open_, tree), (np.arange(len(some)), others)):
            for at in range(0, len(rows) if len(against) else 0, step):
                part = rows[at : at + step]
                for i, j in zip(*np.nonzero(ring.near(some[part, None], index[None, against], start)), strict=True):
                    join(int(part[i]), int(against[j]))
        yield left, right


def links(made: DataFrame, ring) -> DataFrame:
    """Links (a, b) between near ones of ``made``: key, side, id and the fingerprint's words ``w0``, ``w1``, ...

    Two are compared if they share a key and one of them at least is of side 0. The links' components are those of all near
    pairs. Buckets of over ``BLOCK`` members of side 0 are compared in two steps (:func:`_labels`, :func:`_unlabelled`).
    """
    own = made.where("side = 0").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    hot = written(own.where(F.col("n") > BLOCK).select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "hot")
    n_hot = hot.count()
    few = n_hot <= FEW
    columns = ["key", "side", "id", *[f"w{k}" for k in range(ring.words)]]
    unit, role = F.lit(0).alias("unit"), F.col("side").alias("role")
    if not n_hot:
        return _linked(made.select("key", unit, role, *columns[2:]), ring)
    cold = made.join(F.broadcast(hot), "key", "left_anti") if few else made.join(hot, "key", "left_anti")
    busy = written(_by_key(made, hot, few).select(*columns, "blocks"), "busy")
    labels = written(_labels(busy, ring, few), "labels")
    rest = _unlabelled(busy, labels, few).select("key", "unit", "role", *columns[2:])
    found = _linked(cold.select("key", unit, role, *columns[2:]).unionByName(rest), ring)
    return found.unionByName(labels.where("side is null").select("a", "b")).distinct()


def _by_key(rows: DataFrame, table: DataFrame, few: bool) -> DataFrame:
    """``rows`` of the keys that ``table`` has, one row for each."""
    return rows.join(F.broadcast(table), "key") if few else split_join(rows, table, ["key"])


def _linked(rows: DataFrame, ring) -> DataFrame:
    """Links within units (key, unit): members (role 0) with each other and with probes (1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for left, right in _unit_links(batches, ring):
            if len(left):
                a, b = np.asarray(left, np.int64), np.asarray(right, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    sorted_rows = rows.withColumn("role", F.col("role").cast("byte")).repartition("key", "unit").sortWithinPartitions("key", "unit", "role")
    return sorted_rows.mapInArrow(run, "a long, b long").distinct()


def _labels(busy: DataFrame, ring, few: bool) -> DataFrame:
    """The links within each block of a large bucket (a, b), and for each of its rows (key, id, side) a label.

    Every block has the bucket's pivots, the same ones. Rows that links within the block join with a pivot are labelled by
    the first pivot of their tree, other rows by -1. So rows of one label are one tree, whatever blocks they are in.
    """
    words = [f"w{k}" for k in range(ring.words)]
    first = F.min(F.struct(F.xxhash64("id").alias("order"), "id", *words)).alias("p")
    pivots = busy.where("side = 0").groupBy("key", "blocks", F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(PIVOTS)).alias("_k")).agg(first)
    copies = pivots.select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("unit"), F.lit(0).cast("byte").alias("role"), F.col("_k").alias("rank"), "p.id", *[f"p.{w}" for w in words])
    block = F.pmod(F.xxhash64("id", "key"), F.col("blocks")).cast("int").alias("unit")
    dealt = busy.select("key", block, (F.col("side") + 1).cast("byte").alias("role"), F.lit(0).cast("long").alias("rank"), "id", *words)
    sorted_rows = copies.unionByName(dealt).repartition("key", "unit").sortWithinPartitions("key", "unit", "role", "rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, role, ids, fps in _whole_units(batches, ring):
            forest, index = _Forest(), role < 2
            a, b = [], []
            for left, right in _bucket_links(ring, ids[index], fps[index], iter([(ids[~index], fps[~index])]), int(key) >> 32, forest):
                a += left
                b += right
            labels: dict[int, int] = {}
            for rank, i in enumerate(ids[role == 0].tolist()):
                labels.setdefault(forest.root(i), rank)
            names, sides = ids[role > 0], role[role > 0] - 1
            marks = np.array([labels.get(forest.root(i), -1) for i in names.tolist()], np.int32)
            n, m = len(a), len(names)
            pairs = np.array([a, b], np.int64).reshape(2, n)
            none = lambda k, kind: pa.nulls(k, kind)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([pa.array(pairs.min(axis=0)), none(m, pa.int64())]), pa.concat_arrays([pa.array(pairs.max(axis=0)), none(m, pa.int64())]),
                    pa.concat_arrays([none(n, pa.int64()), pa.array(np.full(m, key, np.int64))]), pa.concat_arrays([none(n, pa.int64()), pa.array(names)]),
                    pa.concat_arrays([none(n, pa.int8()), pa.array(sides.astype(np.int8))]), pa.concat_arrays([none(n, pa.int32()), pa.array(marks)]),
                ],
                names=["a", "b", "key", "id", "side", "label"],
            )

    return sorted_rows.mapInArrow(run, "a long, b long, key long, id long, side byte, label int")


def _unlabelled(busy: DataFrame, labels: DataFrame, few: bool) -> DataFrame:
    """Units that compare what isn't in the largest tree of its bucket with all the bucket's rows; none if nothing is left.

    Members of that tree need no look at each other. So they meet the rest alone, block by block, and the rest meets itself.
    """
    counted = labels.where("side is not null and label >= 0").groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    best = counted.groupBy("key").agg(F.max(F.struct("n", "label"))["label"].alias("best"))
    rows = labels.where("side is not null").join(F.broadcast(best) if few else best, "key", "left").select("key", "id", "side", (F.col("label") == F.coalesce("best", F.lit(-2))).alias("tree"))
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    sizes = rows.groupBy("key").agg(count(F.col("tree") & (F.col("side") == 0)).alias("in_tree"), count(~F.col("tree") & (F.col("side") == 0)).alias("others"), count(~F.col("tree")).alias("left"))
    of = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    sizes = written(sizes.where(F.col("left") > 0).select("key", of("in_tree").alias("trees"), of("others").alias("rests")), "sizes")
    each = _by_key(busy.join(rows, ["key", "id", "side"]), sizes, few)
    tree, member, hashed = F.col("tree"), F.col("side") == 0, F.xxhash64("id", "key")
    own = F.when(~member, F.lit(-1)).when(tree, F.pmod(hashed, F.col("trees"))).otherwise(F.col("trees") + F.pmod(hashed, F.col("rests")))
    # stretches of units: the tree's blocks, then those of the rest
    stretch = lambda a, b: F.when(b > a, F.sequence(a.cast("int"), (b - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    trees, rests = stretch(F.lit(0), F.col("trees")), stretch(F.col("trees"), F.col("trees") + F.col("rests"))
    home = F.array(F.col("own").cast("int"))
    units = F.when(tree & member, F.concat(home, rests)).when(tree, rests).when(member, F.concat(trees, stretch(F.col("own"), F.col("trees") + F.col("rests")))).otherwise(F.concat(trees, rests))
    return each.withColumn("own", own).withColumn("unit", F.explode(units)).withColumn("role", F.when(member & (F.col("unit") == F.col("own")), 0).otherwise(1))


def _whole_units(batches: Iterator[pa.RecordBatch], ring) -> Iterator[tuple]:
    """key, role, ids and fingerprints of each unit (key, unit) of sorted rows, which fits into memory."""
    held: list[tuple[np.ndarray, ...]] = []

    def joined() -> tuple:
        return held[0][0][0], *(np.concatenate([h[k] for h in held]) for k in (2, 3, 4))

    for batch in batches:
        if not batch.num_rows:
            continue
        got = _arrays(batch.select([c for c in batch.schema.names if c != "rank"]), ring)
        edges = np.flatnonzero((got[0][1:] != got[0][:-1]) | (got[1][1:] != got[1][:-1])) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(got[0])], strict=True):
            if held and (held[-1][0][0], held[-1][1][0]) != (got[0][a], got[1][a]):
                yield joined()
                held = []
            held.append(tuple(x[a:b] for x in got))
    if held:
        yield joined()


def _arrays(batch: pa.RecordBatch, ring) -> tuple[np.ndarray, ...]:
    """key, unit, role, id, and the fingerprints as rows of words."""
    got = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4 + ring.words)]
    return (*got[:4], np.ascontiguousarray(np.stack(got[4:], axis=1)).view(np.uint64))


def _unit_links(batches: Iterator[pa.RecordBatch], ring) -> Iterator[tuple]:
    """Walks rows sorted by unit; small units are compared side by side, larger ones one by one."""
    held: list[tuple[np.ndarray, ...]] = []
    batches = iter(batches)

    def whole(parts: list[tuple[np.ndarray, ...]]) -> Iterator[tuple]:
        """Complete units, all of them in memory."""
        key, unit, role, ids, fp = (np.concatenate([p[k] for p in parts]) for k in range(5))
        if not len(key):
            return
        first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (unit[1:] != unit[:-1])])
        size = np.diff(np.r_[first, len(key)])
        small = size <= 48
        # rows of small units, compared with the row 1, 2, ... below
        row = np.flatnonzero(np.repeat(small & (size > 1), size) & (role == 0))  # members come first: of two to be compared the upper is one
        last = np.repeat(first + size, size)
        step = 1
        while len(row):
            row = row[row + step < last[row]]
            near = ring.near(fp[row], fp[row + step], (key[row] >> 32).astype(np.int64)) & (ids[row] != ids[row + step])
            yield ids[row[near]], ids[row[near] + step]
            step += 1
        for f, n in zip(first[~small].tolist(), size[~small].tolist(), strict=True):
            members, part, names = role[f : f + n] == 0, fp[f : f + n], ids[f : f + n]
            if members.any():
                yield from _bucket_links(ring, names[members], part[members], iter([(names[~members], part[~members])]), int(key[f]) >> 32)

    for batch in batches:
        if not batch.num_rows:
            continue
        got = _arrays(batch, ring)
        # the last unit may go on; all rows before it are complete
        other = np.flatnonzero((got[0] != got[0][-1]) | (got[1] != got[1][-1]))
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut or held and (held[-1][0][-1], held[-1][1][-1]) != (got[0][0], got[1][0]):
            yield from whole([*held, tuple(x[:cut] for x in got)])
            held = []
        held.append(tuple(x[cut:] for x in got))
        if sum(len(h[0]) for h in held) > 8 * BLOCK:
            # one large unit: its members first, then probes as they come
            rest: list = []
            yield from _one_unit(held, batches, rest, ring)
            held = []
            for part in rest:
                other = np.flatnonzero((part[0] != part[0][-1]) | (part[1] != part[1][-1]))
                cut = int(other[-1]) + 1 if len(other) else 0
                yield from whole([tuple(x[:cut] for x in part)])
                held = [tuple(x[cut:] for x in part)]
    if held:
        yield from whole(held)


def _one_unit(held: list, batches: Iterator[pa.RecordBatch], rest: list, ring) -> Iterator[tuple]:
    """Ends a unit whose rows fill several batches, keeping its members but not its probes; what follows goes to ``rest``."""
    key, unit = held[0][0][0], held[0][1][0]

    def parts() -> Iterator[tuple]:
        yield from held
        for batch in batches:
            if not batch.num_rows:
                continue
            got = _arrays(batch, ring)
            same = (got[0] == key) & (got[1] == unit)
            n = len(same) if same.all() else int(np.flatnonzero(~same)[0])
            if n:
                yield tuple(x[:n] for x in got)
            if n < len(same):
                rest.append(tuple(x[n:] for x in got))
                return

    walk, members, waiting = parts(), [], []
    for part in walk:
        of = part[2] == 0
        members.append((part[3][of], part[4][of]))
        if not of.all():
            waiting.append((part[3][~of], part[4][~of]))
            break
    ids, index = (np.concatenate([m[k] for m in members]) for k in range(2))
    if not len(ids):
        for _ in walk:
            pass
        return

    def probes() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        yield from waiting
        for part in walk:
            yield part[3], part[4]

    yield from _bucket_links(ring, ids, index, probes(), int(key) >> 32)


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the least node that it reaches) of every node of ``edges`` (a, b).

    Rounds of large star and small star: each node's larger neighbours move to its least one. What a round leaves is
    written, and the rounds end when no edge changes; neither nodes nor links come to the driver.
    """
    now = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    # neither star makes more edges than it gets
    seen, n = None, now.count()
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # a node that very many others hang on is a hot key
        large = written(split_join(both.where("b > a"), least, ["a"]).select(F.col("m").alias("a"), "b").where("a < b").distinct(), "edges", n)
        # small star: by the larger end, which has no larger neighbour here
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        small = split_join(large, down, ["b"]).select(F.explode(F.array(F.struct(F.col("m").alias("x"), F.col("b").alias("y")), F.struct(F.col("m").alias("x"), F.col("a").alias("y")))).alias("e"))
        before, now = now, written(small.select(F.col("e.x").alias("a"), F.col("e.y").alias("b")).where("a < b").distinct(), "edges", n)
        released(before, large)
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            break
        seen, n = tuple(state), state[0]
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(now.select("a").distinct().select(F.col("a").alias("node"), F.col("a").alias("root")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 4) -> DataFrame:
    """``id_col``, ``fp`` and ``component_id`` of each row: the least id that links of ``LIMIT`` bits or fewer reach from it, its own included."""
    prints = written(fingerprints(docs, id_col, text, words), "fingerprints")
    distinct = written(prints.groupBy("fp").agg(F.min(id_col).alias("least")), "distinct", prints.count())
    classes = _classes(distinct, "fp", links(entries(distinct), Ring()))
    return split_join(prints, classes, ["fp"]).select(id_col, "fp", "component_id")


def _classes(distinct: DataFrame, node: str, found: DataFrame) -> DataFrame:
    """``node`` and ``component_id``, the smallest ``least`` of its component."""
    roots = components(found).withColumnRenamed("node", "_node")
    rooted = written(distinct.join(roots, distinct[node] == roots["_node"], "left").select(node, "least", F.coalesce("root", node).alias("root")), "rooted", distinct.count())
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return split_join(rooted, smallest, ["root"]).select(node, "component_id")


# similarity of shingles


def bits_apart(similarity: float) -> int:
    """Bits of a wide fingerprint that texts of a Jaccard similarity differ in, and ``RING_SLACK`` standard deviations more."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    n = 64 * WIDE
    return int(n * p + RING_SLACK * math.sqrt(n * p * (1 - p)))


def minima_alike(similarity: float) -> int:
    """Minima of which two bits agree in texts of a Jaccard similarity, less ``MINIMA_SLACK`` standard deviations."""
    p = similarity + (1 - similarity) / 4
    return math.ceil(MINIMA * p - MINIMA_SLACK * math.sqrt(MINIMA * p * (1 - p)))


def _mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes turned into others, as good as independent for each k."""
    x = hashes + np.uint64((0x9E3779B97F4A7C15 * (k + 1)) & (1 << 64) - 1)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def wide_print(hashes: np.ndarray) -> list[int]:
    return [majority(_mixed(hashes, k)) for k in range(WIDE)]


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least of the hashes by each of ``MINIMA`` orders."""
    least = np.full(MINIMA, (1 << 64) - 1, np.uint64)
    for at in range(0, len(hashes), 256):
        least = np.minimum(least, (hashes[at : at + 256, None] * _FACTORS).min(axis=0))
    return least


def packed_minima(least: np.ndarray) -> np.ndarray:
    """Two bits of each minimum, in words of 64 bits."""
    two = (least >> np.uint64(24)).astype(np.uint8) & 3
    return (two[::4] | two[1::4] << 2 | two[2::4] << 4 | two[3::4] << 6).view(np.uint64)


def band_keys(least: np.ndarray) -> list[int]:
    """Of each band the hash of its minima; texts that share a share s of their shingles share a band with the chance s ** ROWS."""
    return [xxhash.xxh64_intdigest(least[k * ROWS : (k + 1) * ROWS].tobytes(), k) >> 1 for k in range(BANDS)]


def _similar(docs: DataFrame, text: str, words: int, similarity: float, kept: list[str], least) -> tuple[DataFrame, DataFrame]:
    """The rows' columns ``kept`` with ``node``, the hash of the set of shingles; and each node's class, the smallest of its ``least``."""
    names = [f"w{k}" for k in range(WIDE + PACKED)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_with(batches):
            prints, ids, keys = [], [], []
            with np.errstate(over="ignore"):
                for x in text_column(batch, text):
                    hashes = np.unique(shingle_hashes(x, words))
                    found = minima(hashes)
                    prints.append(np.r_[np.array(wide_print(hashes), np.uint64), packed_minima(found)])
                    ids.append(xxhash.xxh64_intdigest(hashes.tobytes()))
                    keys.append(band_keys(found))
            wide = np.array(prints, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(np.array(ids, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64())), *[pa.array(wide[:, k]) for k in range(wide.shape[1])]],
                names=[*kept, "_node", "_bands", *names],
            )

    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField("_node", T.LongType()), T.StructField("_bands", T.ArrayType(T.LongType())), *[T.StructField(n, T.LongType()) for n in names]])
    prints = written(docs.select(*dict.fromkeys([*kept, text])).mapInArrow(run, schema), "wide-fingerprints")
    # texts of one set of shingles are one node
    distinct = written(prints.groupBy(F.col("_node").alias("node")).agg(least.alias("least"), F.first("_bands").alias("bands"), *[F.first(n).alias(n) for n in names]), "distinct")
    made = distinct.select(F.explode("bands").alias("key"), F.lit(0).cast("byte").alias("side"), F.col("node").alias("id"), *names)
    classes = _classes(distinct.select("node", "least"), "node", links(made, WideRing(similarity)))
    return prints.select(*kept, F.col("_node").alias("node")), classes


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``id_col`` and ``component_id`` of each row: the least id that links between texts alike by ``similarity`` reach.

    Likeness is that of the sets of shingles of ``words`` words. Candidates share a band of minima; links are what minima
    tell, with a slack of ``MINIMA_SLACK`` standard deviations of 0.02 each: of pairs just at the similarity about one in ten is
    missed, of those 0.05 below about one in six is linked, of those 0.1 below one in a thousand.
    """
    rows, classes = _similar(docs.select(id_col, text), text, words, similarity, [id_col], F.min(id_col))
    return split_join(rows, classes, ["node"]).select(id_col, "component_id")


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each class of :func:`similar_documents`, as it is: that with the smallest id, null ids last.

    Rows are told apart by all their columns, so that unlike texts stay though their ids are null or the same; of rows that
    repeat one another one stays.
    """
    high, low = fresh(docs.columns, "_row_high"), fresh(docs.columns, "_row_low")
    plain = [F.col(f"`{f.name}`") for f in docs.schema.fields if not isinstance(f.dataType, T.MapType)]
    marked = docs.select("*", F.xxhash64(*plain).alias(high), F.xxhash64(F.lit(1), *plain).alias(low))
    own = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(high).alias("high"), F.col(low).alias("low"))
    _, classes = _similar(marked.select(id_col, text, high, low), text, words, similarity, [id_col, high, low], F.min(own))
    stays = classes.select(F.col("component_id.high").alias(high), F.col("component_id.low").alias(low)).distinct()
    return marked.join(stays, [high, low], "left_semi").dropDuplicates([high, low]).select(*[f"`{c}`" for c in docs.columns])


def hex_print(fp):
    """A fingerprint as 16 lower-case hex digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
