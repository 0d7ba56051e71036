"""Document fingerprints by a homomorphic multiset hash, in DataFrame functions only.

A text is a multiset of paragraphs: its lines, cut further where a sentence ends, and, if they are longer than ``LONG``,
where a word's (without blanks, a sign's) own hash says so, so that an edit moves no cut but those beside it. Each paragraph is
hashed to a wide vector; the vectors are added lane by lane, modulo powers of two. So equal multisets have equal fingerprints
in any order, and a paragraph is inserted or deleted by adding or subtracting its vector.

The vector has ``DENSE`` lanes of ``BITS`` bits, the paragraph's SHA-256, which tell texts apart, and 2^20 pairs of lanes of
which it fills one: 1, and 32 bits of its hash. Only the pairs that a text fills are held, so that their number may be far
beyond any text's paragraphs. Two pairs with the same quotient hold the same paragraph, as often as their first lanes say:
the likeness of two fingerprints is that of the multisets, the sum of the lesser counts by that of the greater, at any length.

Null and empty texts have the fingerprint zero; two of them have likeness 1. Rows that repeat an id are taken in the order
of their texts. Null ids come first. Ids are numbers, texts or times. An empty table gives no rows.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Dense lanes and their bits; hex digits that number a sparse lane (so many bits times four).
DENSE, BITS, LANE_DIGITS = 6, 40, 5
_MASK, _DIGITS = (1 << BITS) - 1, BITS // 4
#: Code points from which a paragraph is cut further at words, and from which what is left of it at signs; the first digits
#: of a hash that cut: one in eight.
LONG, LONG_RUN, CUTTING = 200, 1000, ("0", "8")
#: Ranges of ids for each shuffle partition; ids that are looked at for each range's bound.
RANGES, LOOKED_AT = 4, 20
_WORD = r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|[\x20\x09-\x0D]+"


def sentences(text: Column) -> Column:
    """The lines of a text, cut where a sentence ends; some may be empty."""
    ended = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"([.!?]) +", "$1\n"), "([\u3002\uff01\uff1f])", "$1\n")
    return F.split(ended, "\n+", -1)


def _pieces(unit: Column, pattern: str, long: int) -> Column:
    """A paragraph of over ``long`` signs cut after those of its parts whose hash says so; a shorter one whole."""
    marked = F.transform(F.regexp_extract_all(unit, F.lit(pattern), F.lit(0)), lambda w: F.when(F.substring(F.md5(w), 1, 1).isin(*CUTTING), F.concat(w, F.lit("\n"))).otherwise(w))
    return F.when(F.length(unit) > long, F.split(F.array_join(marked, ""), "\n")).otherwise(F.array(unit))


def paragraphs(docs: DataFrame, keys: list[str], units: Column) -> DataFrame:
    """``keys`` and ``_unit`` of each paragraph of a row's sentences; those that are still long are cut at words, then at signs. Some may be empty."""
    each = docs.select(*keys, F.explode(units).alias("_unit"))
    for pattern, long in ((_WORD, LONG), ("(?s).", LONG_RUN)):
        each = each.select(*keys, F.explode(_pieces(F.col("_unit"), pattern, long)).alias("_unit"))
    return each


def _sums(units: DataFrame, keys: list[str], tags: int) -> DataFrame:
    """For each key and sparse lane the sums of each of its texts, ``_tag`` 0, 1, ...: ``_n0``, ``_s0``, ``_d00`` (dense), ...

    Empty paragraphs have the lane null and add nothing, but keep their text from being lost.
    """
    digest = units.select(*keys, "_tag", F.when(F.col("_unit") != "", F.sha2("_unit", 256)).alias("_digest"))
    word = lambda j: F.conv(F.substring("_digest", 1 + _DIGITS * j, _DIGITS), 16, 10).cast("long").alias(f"_w{j}")
    vector = digest.select(*keys, "_tag", F.substring("_digest", 1, LANE_DIGITS).alias("_lane"), *[word(j) for j in range(DENSE)])
    of = lambda k, c: F.sum(F.when(F.col("_tag") == k, c).otherwise(F.lit(0).cast("long")))
    return vector.groupBy(*keys, "_lane").agg(
        *[x for k in range(tags) for x in (of(k, F.lit(1)).alias(f"_n{k}"), of(k, F.col("_w1").bitwiseAND(0xFFFFFFFF)).alias(f"_s{k}"))],
        *[of(k, F.col(f"_w{j}")).bitwiseAND(_MASK).alias(f"_d{k}{j}") for k in range(min(tags, 2)) for j in range(DENSE)],
    )


def _dense(k: int) -> Column:
    return F.array(*[F.coalesce(F.sum(f"_d{k}{j}").bitwiseAND(_MASK), F.lit(0).cast("long")) for j in range(DENSE)])


def hex_lanes(dense: Column) -> Column:
    """The dense lanes as lower-case hex digits."""
    return F.array_join(F.transform(dense, lambda x: F.lpad(F.lower(F.hex(x)), _DIGITS, "0")), "")


def _same(n: Column, s: Column, m: Column, t: Column) -> Column:
    """Whether two filled pairs of lanes hold the same paragraph."""
    return (n > 0) & (m > 0) & (s / n == t / m)


def likeness(a: Column, b: Column) -> Column:
    """The likeness of two fingerprints' sparse lanes, arrays of (lane, n, s)."""
    theirs = F.map_from_entries(F.transform(b, lambda y: F.struct(y["lane"], F.struct(y["n"].alias("n"), y["s"].alias("s")))))
    least = F.aggregate(a, F.lit(0).cast("long"), lambda acc, x: acc + F.coalesce(F.when(_same(x["n"], x["s"], theirs[x["lane"]]["n"], theirs[x["lane"]]["s"]), F.least(x["n"], theirs[x["lane"]]["n"])), F.lit(0)))
    total = lambda lanes: F.aggregate(lanes, F.lit(0).cast("long"), lambda acc, x: acc + x["n"])
    # the greater counts are what both have, less the lesser
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(least / (total(a) + total(b) - least))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id_col``, ``dense``, ``lanes`` (array of lane, n, s by lane) and ``fingerprint``, the dense lanes in hex, for each distinct id and text."""
    rows = docs.select(F.col(id_col), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_row"), F.col(text).alias("_text")).dropDuplicates([id_col, "_row"])
    units = paragraphs(rows, [id_col, "_row"], sentences(F.col("_text"))).withColumn("_tag", F.lit(0))
    lanes = _sums(units, [id_col, "_row"], 1)
    filled = F.collect_list(F.when(F.col("_lane").isNotNull(), F.struct(F.col("_lane").alias("lane"), F.col("_n0").alias("n"), F.col("_s0").alias("s"))))
    made = lanes.groupBy(id_col, "_row").agg(_dense(0).alias("dense"), F.array_sort(filled).alias("lanes"))
    return made.select(id_col, "dense", "lanes", hex_lanes(F.col("dense")).alias("fingerprint"))


def added(a: Column, b: Column, sign: int = 1, bits: int = BITS) -> Column:
    """Dense lanes of ``a`` with those of ``b`` inserted, or with ``sign`` -1 deleted."""
    return F.zip_with(a, b, lambda x, y: (x + sign * y).bitwiseAND((1 << bits) - 1))


def in_ranges(docs: DataFrame, id_col: str) -> DataFrame:
    """``docs`` with ``_range``, the number of its id's range; null ids are range -1.

    The ranges are cut at quantiles of some of the ids, ``LOOKED_AT`` for each range, taken by a hash; these alone come to the
    driver. Any type that can be sorted and hashed will do.
    """
    n = RANGES * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(F.col(id_col).alias("_id")).where("_id is not null")
    share = min(1.0, n * LOOKED_AT / max(1, ids.count()))
    some = ids.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 40)) < int(share * (1 << 40))).distinct() if share < 1 else ids.distinct()
    kind = docs.schema[id_col].dataType
    # as text for the driver and the plan; the order is that of the type
    found = [r["_id"] for r in some.orderBy("_id").select(F.col("_id").cast("string").alias("_id")).collect()]
    cuts = [found[k * len(found) // n] for k in range(1, n)] if len(found) >= n else found[1:]
    cuts = [x for k, x in enumerate(cuts) if not k or x != cuts[k - 1]]
    number = F.lit(0)
    if cuts:
        # in two steps, so that a row is compared with the square root of the cuts: among each cell's first, then in its cell
        step = max(1, math.isqrt(len(cuts)))
        cells = [cuts[k : k + step] for k in range(0, len(cuts), step)]
        # one literal in the plan; numbers and texts are read into it once, other types for each row
        plain = T.IntegralType if kind.typeName() != "string" else T.StringType
        typed = isinstance(kind, plain)
        values = [[int(x) if typed and plain is T.IntegralType else x for x in cell] for cell in cells]
        fine = F.from_json(F.lit(json.dumps(values)), f"array<array<{kind.simpleString() if typed else 'string'}>>")
        fine = fine if typed else F.transform(fine, lambda cell: F.transform(cell, lambda x: x.cast(kind)))
        reached = lambda part: F.size(F.filter(part, lambda c: c <= F.col(id_col)))
        cell = reached(F.transform(fine, lambda x: x[0]))
        number = F.when(cell == 0, 0).otherwise((cell - 1) * step + reached(F.element_at(fine, F.greatest(cell, F.lit(1)))))
    return docs.withColumn("_range", F.when(F.col(id_col).isNull(), F.lit(-1)).otherwise(number).cast("int"))


def placed_with_next(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """id, ``_text``, ``_range``, ``_last`` (1 for a copy of the next range's first document), ``_place`` and ``_next``, the next document's text.

    The documents are dealt to ranges of ids, with that copy at the end of each: one shuffle, after which windows and sums
    stay where the rows are.
    """
    ranged = in_ranges(docs.select(F.col(id_col), F.coalesce(F.col(text), F.lit("")).alias("_text")), id_col)
    # a row for each range: its first id, and the range before it (the last, for the first), which gets the copy
    along, all_ranges = Window.orderBy("_range"), Window.partitionBy()
    firsts = ranged.groupBy("_range").agg(F.min(id_col).alias("_least"))
    targets = firsts.select(F.col("_range").alias("_from"), "_least", F.coalesce(F.lag("_range").over(along), F.max("_range").over(all_ranges)).alias("_to"))
    copy = ranged.join(F.broadcast(targets), (F.col("_range") == F.col("_from")) & F.col(id_col).eqNullSafe(F.col("_least")))
    copy = copy.select(id_col, "_text", F.col("_to").alias("_range"), F.lit(1).alias("_last"))
    by_range = Window.partitionBy("_range").orderBy("_last", F.col(id_col).asc_nulls_first(), "_text")
    both = ranged.select(id_col, "_text", "_range", F.lit(0).alias("_last")).unionByName(copy)
    return both.select("*", F.row_number().over(by_range).alias("_place"), F.lead("_text").over(by_range).alias("_next"))


def edited_text() -> Column:
    """The text with its last quarter replaced by the beginning of the next."""
    return F.concat(F.expr("substring(_text, 1, length(_text) - cast(floor(length(_text) / 4) as int))"), F.expr("substring(coalesce(_next, ''), 1, cast(floor(length(_text) / 4) as int))"))


def with_edits(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next.

    The edited text has its last quarter replaced by the beginning of the next document by id; after the last comes the
    first. The lanes of a text, its edited text and the next one are added up side by side, where the rows are.
    """
    placed = placed_with_next(docs, id_col, text).where("_last = 0").select("_range", "_place", F.col(id_col).alias("_id"), F.length("_text").cast("long").alias("_n"), "_text", edited_text().alias("_edited"), F.coalesce("_next", F.lit("")).alias("_next"))
    keys = ["_range", "_place", "_id", "_n", "_sha"]
    tagged = F.array(*[F.struct(F.lit(k).alias("tag"), F.col(c).alias("text")) for k, c in enumerate(("_text", "_edited", "_next"))])
    each = placed.select("_range", "_place", "_id", "_n", F.sha2("_edited", 256).alias("_sha"), F.explode(tagged).alias("_x")).select(*keys, F.col("_x.tag").alias("_tag"), F.col("_x.text").alias("_x"))
    lanes = _sums(paragraphs(each, [*keys, "_tag"], sentences(F.col("_x"))), keys, 3)
    filled = F.col("_lane").isNotNull()
    total = lambda c: F.coalesce(F.sum(F.when(filled, c)), F.lit(0))
    least = lambda k: F.when(_same(F.col("_n0"), F.col("_s0"), F.col(f"_n{k}"), F.col(f"_s{k}")), F.least("_n0", f"_n{k}")).otherwise(0)
    sums = lanes.groupBy(*keys).agg(_dense(0).alias("_dense"), _dense(1).alias("_edited_dense"), *[total(F.col(f"_n{k}")).alias(f"_t{k}") for k in range(3)], *[total(least(k)).alias(f"_both{k}") for k in (1, 2)])
    near = lambda k: F.when(F.col("_t0") + F.col(f"_t{k}") == 0, F.lit(1.0)).otherwise(F.col(f"_both{k}") / (F.col("_t0") + F.col(f"_t{k}") - F.col(f"_both{k}")))
    return sums.select(
        F.col("_id").alias(id_col),
        F.col("_n").alias("n_chars"),
        F.col("_sha").alias("edited_sha256"),
        hex_lanes(F.col("_dense")).alias("fingerprint"),
        hex_lanes(F.col("_edited_dense")).alias("edited_fingerprint"),
        near(1).alias("near_edited"),
        near(2).alias("near_next"),
    )
