"""Sharding by a minimax contiguous partition.

Rows with equal texts are one group and stay together. The groups stand in the order of their first id; the shards are
stretches of them. The smallest feasible capacity, the size that the largest shard needs, is found by binary search, each
capacity checked greedily; the cuts are made there.

The groups never come to the driver. It has the ends of cells of groups, ``CELLS`` at most: with them it brackets the
capacity and where each cut can be, then asks for finer cells in these places alone, until it has every group that can end
a shard. So the capacity is exact. Sums and positions go by ranges of ids, each in a task of its own.

A null text has no bytes; null texts are one group, apart from empty ones. Rows that repeat an id stand in any order among
themselves. Null ids come first. An empty table has no rows in any shard.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.llm._io import written
from gaugeworks.llm.multiset_hash import in_ranges

#: Ends of cells that the driver has at once; bytes that a row counts besides its text.
CELLS, ROW_BYTES = 50_000, 8


def greedy(ends: list[int], capacity: int, shards: int) -> list[int] | None:
    """The ends of shards that each take as many cells as fit; None if they don't hold all."""
    cuts, at = [], 0
    for _ in range(shards):
        k = bisect_right(ends, at + capacity)
        if not k or ends[k - 1] <= at:
            return None
        at = ends[k - 1]
        cuts.append(at)
        if at == ends[-1]:
            return cuts
    return None


def smallest_capacity(ends: list[int], low: int, shards: int) -> int:
    """The least capacity from ``low`` that suffices when shards end at ``ends`` only."""
    high = ends[-1]
    while low < high:
        mid = (low + high) // 2
        if greedy(ends, mid, shards):
            high = mid
        else:
            low = mid + 1
    return low


def balanced(ends: list[int], capacity: int, shards: int) -> list[int]:
    """Cuts within the capacity whose shards come near to equal sizes."""
    total, latest = ends[-1], [ends[-1]]
    for _ in range(shards - 1):  # the least end at which the rest still fits
        k = bisect_left(ends, latest[-1] - capacity)
        latest.append(0 if latest[-1] <= capacity else ends[k])
    cuts, at = [], 0
    for left in range(shards, 1, -1):
        want = at + (total - at) / left
        k = bisect_right(ends, want)
        near = [e for e in ends[max(0, k - 1) : k + 1] if at <= e <= at + capacity and e >= latest[left - 1]]
        fits = bisect_right(ends, at + capacity)
        at = min(near, key=lambda e: abs(e - want)) if near else max(at, latest[left - 1], ends[fits - 1] if fits and ends[fits - 1] <= want else 0)
        cuts.append(at)
    return [*cuts, total]


def cut_places(groups: DataFrame, shards: int, largest: int, total: int) -> list[int]:
    """The shards' ends, for ``groups`` with the running total ``end``."""
    width, where, coarse = max(1, -(-total // CELLS)), [(0, total)], set()
    while True:
        spans = F.lit(False)
        for a, b in where:
            spans = spans | F.col("end").between(a, b)
        cells = groups.where(spans).groupBy(F.floor(F.col("end") / width)).agg(F.max("end").alias("end"), F.count(F.lit(1)).alias("n"))
        found = [(r["end"], r["n"]) for r in cells.select("end", "n").collect()]  # at most CELLS and one for each place
        coarse |= {e for e, _ in found}
        ends = sorted(coarse | {total})
        exact = all(n == 1 for _, n in found)
        low = max(largest, -(-total // shards))
        high = smallest_capacity(ends, low, shards)
        if exact or high == low:
            return balanced(ends, high, shards)
        low = max(low, high - width)
        first, last, where = 0, 0, []
        for _ in range(shards):
            k = bisect_right(ends, first + low)
            first = ends[k - 1] if k else 0
            last = min(total, last + high)
            if where and first <= where[-1][1]:
                where[-1] = (where[-1][0], last)
            else:
                where.append((first, last))
        size = sum(b - a for a, b in where)
        width = max(1, min(width // 2, -(-size // CELLS)))


def sharded(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id_col``, size, text_crc32, shard and slot (gapless in each shard) of each row."""
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(id_col),
        (F.octet_length(raw) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.when(F.col(text).isNull(), F.lit(None)).otherwise(F.xxhash64(text)).alias("_hash"),
    )
    ranged = in_ranges(written(rows, "sizes"), id_col)
    group = F.struct(F.coalesce("_hash", F.lit(0)).alias("h"), F.col("_hash").isNull().alias("none"), F.col("text_crc32").alias("c"), F.col("size").alias("s"))
    rows = ranged.withColumn("_group", group)
    # a group's rows by range of ids: a group that has a third of all rows is many such parts
    parts = rows.groupBy("_group", "_range").agg(F.count(F.lit(1)).alias("_n"), F.min(id_col).alias("_first"))
    along = Window.partitionBy("_group").orderBy("_range")
    parts = parts.withColumn("_before", F.sum("_n").over(along) - F.col("_n"))
    first_range, whole = F.first("_range").over(along), F.sum("_n").over(Window.partitionBy("_group"))
    parts = written(parts.select("*", first_range.alias("_start"), F.first("_first").over(along).alias("_least"), whole.alias("_rows")), "parts")
    groups = parts.where(F.col("_range") == F.col("_start")).select("_group", "_start", "_least", "_rows", (F.col("_group.s") * F.col("_rows")).alias("_bytes"))
    # running totals: within the range where a group begins, on top of those of the ranges before
    sums = {r["_start"]: (r["b"], r["n"], r["most"]) for r in groups.groupBy("_start").agg(F.sum("_bytes").alias("b"), F.sum("_rows").alias("n"), F.max("_bytes").alias("most")).collect()}
    if not sums:
        return rows.select(id_col, "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    total, count, offsets = 0, 0, []
    for r in sorted(sums):
        offsets.append((r, total, count))
        total, count = total + sums[r][0], count + sums[r][1]
    offset = F.broadcast(docs.sparkSession.createDataFrame(offsets, "_start int, _b0 long, _n0 long"))  # a row for each range
    order = Window.partitionBy("_start").orderBy(F.col("_least").asc_nulls_first(), "_group")
    placed = written(
        groups.select("*", F.sum("_bytes").over(order).alias("_b"), F.sum("_rows").over(order).alias("_n")).join(offset, "_start").select("_group", "_rows", (F.col("_b") + F.col("_b0")).alias("end"), (F.col("_n") + F.col("_n0") - F.col("_rows")).alias("_rank")),
        "groups",
    )
    cuts = cut_places(placed, shards, max(x[2] for x in sums.values()), total)
    shard = F.size(F.filter(F.lit(cuts[:-1]), lambda c: c < F.col("end")))
    placed = placed.withColumn("shard", shard)
    starts = {r["shard"]: r["rank"] for r in placed.groupBy("shard").agg(F.min("_rank").alias("rank")).collect()}  # one for each shard
    start = F.element_at(F.create_map(*[F.lit(x) for s in starts.items() for x in s]), F.col("shard"))
    ranks = parts.select("_group", "_range", "_before").join(placed.select("_group", "shard", (F.col("_rank") - start).alias("_slot")), "_group")
    own = Window.partitionBy("_group", "_range").orderBy(F.col(id_col).asc_nulls_first())
    out = rows.withColumn("_k", F.row_number().over(own) - 1).join(ranks, ["_group", "_range"])
    return out.select(id_col, "size", "text_crc32", "shard", (F.col("_slot") + F.col("_before") + F.col("_k")).cast("long").alias("slot"))
