"""Samples of a table: by position, by stratum, by weight, by chance, until an estimate is sure.

Positions follow an order that the caller names, as files have none. They are found without a global window: rows are counted
by range, and numbered within their range.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.errors import SamplingError
from gaugeworks.operators.fields import fields


@dataclass(frozen=True)
class Sampling:
    """A strategy: none, random, reservoir, systematic, stratified, progressive, importance or multi_stage, with its settings."""

    kind: str = "none"
    size: int = 0
    interval: int = 0
    keys: tuple[str, ...] = ()
    weight: str = ""
    threshold: float = 0.0
    initial: int = 0
    confidence: float = 0.0
    maximum: int = 0
    stages: tuple["Sampling", ...] = field(default_factory=tuple)
    seed: int = 42


#: Keys that are looked at for each range's bound.
LOOKED_AT = 20


def positioned(df: DataFrame, order: list[str], name: str = "_position", most: int | None = None) -> DataFrame:
    """``df`` with each row's position from 0 in the order of ``order``, columns of any sortable type that should tell all rows apart.

    Ranges are cut by all order columns together, at quantiles of some keys that a hash picks. With ``most``, the rows of ranges that
    begin at that position or later are left out, before any is moved.
    """
    spark, parts = df.sparkSession, max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    key = F.struct(*[F.col(f"`{c}`").alias(f"k{k}") for k, c in enumerate(order)])
    keys = df.select(key.alias("k"))
    share = min(1.0, parts * LOOKED_AT / max(1, keys.count()))
    some = keys.where(F.pmod(F.xxhash64("k"), F.lit(1 << 40)) < int(share * (1 << 40))) if share < 1 else keys
    found = [r["k"] for r in some.orderBy("k").collect()]  # about LOOKED_AT for each range
    cuts = [x for k, x in enumerate(dict.fromkeys(found[i * len(found) // parts] for i in range(1, parts))) if found]
    number = F.lit(0)
    if cuts:
        # the bounds are one literal of the plan, written and read as JSON: any bounds will do as long as all rows meet the same
        table = spark.createDataFrame([(tuple(c),) for c in cuts], T.StructType([T.StructField("k", keys.schema["k"].dataType)]))
        text = table.agg(F.to_json(F.struct(F.array_sort(F.collect_list("k")).alias("cuts")))).first()[0]
        bounds = F.from_json(F.lit(text), T.StructType([T.StructField("cuts", T.ArrayType(keys.schema["k"].dataType))]))["cuts"]
        # the bounds up to the key, by halves: as many looks as the number of bounds has bits
        halves = F.array(*[F.lit(1 << b) for b in reversed(range(len(cuts).bit_length()))])
        number = F.aggregate(halves, F.lit(0), lambda at, step: F.when((at + step <= len(cuts)) & (F.get(bounds, at + step - 1) <= key), at + step).otherwise(at))
    ranged = df.withColumn("_range", number)
    counts = {r["_range"]: r["count"] for r in ranged.groupBy("_range").count().collect()}  # a row for each range
    before, starts = 0, {}
    for r in sorted(counts):
        starts[r], before = before, before + counts[r]
    if most is not None:
        starts = {r: at for r, at in starts.items() if at < most}
        ranged = ranged.where(F.col("_range").isin(*starts)) if starts else ranged.limit(0)
    start = F.element_at(F.create_map(*[F.lit(x) for s in starts.items() for x in s]), F.col("_range")) if starts else F.lit(0)
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*[F.col(f"`{c}`").asc_nulls_first() for c in order]))
    return ranged.withColumn(name, (place - 1 + start).cast("long")).drop("_range")


def systematic(df: DataFrame, interval: int, order: list[str]) -> DataFrame:
    """Every ``interval``-th row from the first; all rows for 0."""
    return df if interval <= 0 else positioned(df, order).where(F.col("_position") % interval == 0).drop("_position")


def stratified(df: DataFrame, keys: list[str], size: int, order: list[str]) -> DataFrame:
    """The first ``size`` rows of each stratum. Spark keeps ``size`` rows of a stratum in each task before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_first() for c in order]))
    return df.withColumn("_place", place).where(F.col("_place") <= size).drop("_place")


def importance(df: DataFrame, weight: str, threshold: float) -> DataFrame:
    """Rows whose weight is a number of ``threshold`` or more."""
    return df.where(F.col(weight).try_cast("double") >= threshold)


def random(df: DataFrame, size: int, seed: int = 42, keys: list[str] | None = None) -> DataFrame:
    """``size`` rows by chance, the same for the same rows: the least hashes of the rows (or of ``keys``) with the seed."""
    hashed = F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in keys or df.columns if df.schema[c].dataType.typeName() != "map"])
    return df.orderBy(hashed).limit(size)


def weighted(df: DataFrame, size: int, weight: str, seed: int = 42) -> DataFrame:
    """``size`` rows, each with a chance in proportion to its weight: the greatest of u ** (1 / weight), u by hash."""
    u = (F.pmod(F.xxhash64(F.lit(seed), *df.columns), F.lit(1 << 52)) + 1) / float(1 << 52)
    w = F.col(weight).try_cast("double")
    return df.where(w > 0).orderBy((F.log(u) / w).desc()).limit(size)


def reservoirs(df: DataFrame, key: str, size: int, seed: int = 42) -> DataFrame:
    """``size`` rows by chance of each key."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64(F.lit(seed), *df.columns)))
    return df.withColumn("_place", place).where(F.col("_place") <= size).drop("_place")


def progressive(df: DataFrame, initial: int, confidence: float, maximum: int, order: list[str]) -> DataFrame:
    """A beginning of the rows, doubled until every numeric column's standard error is within 1 - ``confidence`` of its mean."""
    size, maximum = max(1, initial), max(0, maximum)
    placed = positioned(df, order, most=maximum).where(F.col("_position") < maximum)
    numbers = [f for f in fields(df) if f.kind in ("Integer", "Float")]
    sizes = []
    while size < maximum:
        sizes.append(size)
        size *= 2
    if not sizes or not numbers:
        return placed.drop("_position")
    # the rows that each doubling adds are summed up once, then put together
    level = F.lit(0)
    for s in sizes:
        level = level + F.when(F.col("_position") >= s, 1).otherwise(0)
    wanted = [c.alias(f"{k}_{w}") for k, f in enumerate(numbers) for w, c in (("n", F.count(f.number)), ("m", F.avg(f.number)), ("s", F.var_pop(f.number) * F.count(f.number)))]
    added = {r["_level"]: r for r in placed.withColumn("_level", level).groupBy("_level").agg(*wanted).collect()}  # a row for each doubling
    whole = [(0, 0.0, 0.0)] * len(numbers)
    for at, size in enumerate(sizes):
        if r := added.get(at):
            whole = [_together(x, (r[f"{k}_n"], r[f"{k}_m"], r[f"{k}_s"])) for k, x in enumerate(whole)]
        errors = [math.sqrt(s / (n - 1) if n > 1 else 0.0) / math.sqrt(n) / abs(m) for n, m, s in whole if n and m]
        if errors and max(errors) <= 1 - confidence:
            return placed.where(F.col("_position") < size).drop("_position")
    return placed.drop("_position")


def _together(a: tuple[int, float, float], b: tuple[int, float, float]) -> tuple[int, float, float]:
    """Count, mean and sum of squares about the mean of two sets of numbers as one."""
    if not a[0] or not b[0]:
        return a if a[0] else (b[0], b[1] or 0.0, b[2] or 0.0)
    n, d = a[0] + b[0], b[1] - a[1]
    return n, a[1] + d * b[0] / n, a[2] + b[2] + d * d * a[0] * b[0] / n


def sampled(df: DataFrame, how: Sampling, order: list[str] | None = None) -> DataFrame:
    """``df`` by a strategy. In several stages filters come first, and at most one that fixes the size, last."""
    by = order or df.columns[:1]
    if how.kind == "none":
        return df
    if how.kind in ("random", "reservoir"):
        return random(df, how.size, how.seed)
    if how.kind == "systematic":
        return systematic(df, how.interval, by)
    if how.kind == "stratified":
        return stratified(df, [*how.keys], how.size, by)
    if how.kind == "importance":
        return importance(df, how.weight, how.threshold)
    if how.kind == "progressive":
        return progressive(df, how.initial, how.confidence, how.maximum, by)
    if how.kind == "multi_stage":
        sizes = [k for k, s in enumerate(how.stages) if s.kind in ("random", "reservoir", "progressive", "stratified")]
        if len(sizes) > 1 or sizes and sizes[0] != len(how.stages) - 1:
            raise SamplingError("of several stages one alone may fix the size, and it has to be the last")
        for stage in how.stages:
            df = sampled(df, stage, order)
        return df
    raise SamplingError(f"unknown sampling {how.kind!r}")


def adaptive(rows: int | None, megabytes: float) -> Sampling:
    """A strategy for a table's size: all rows of small tables, random ones of medium, every n-th of large tables."""
    if rows is None:
        return Sampling("systematic", interval=10) if megabytes > 1000 else Sampling()
    if rows <= 50_000:
        return Sampling()
    return Sampling("random", size=50_000) if rows <= 1_000_000 else Sampling("systematic", interval=max(1, rows // 100_000))


# sampling inside a database: SQL for a source that reads by query


def database_sampling(query: str, how: str, size: int, rows: int, key: str | None = None) -> str:
    """A query for a sample of another: random, systematic, stratified by ``key`` or by time along ``key``."""
    inner = f"({query}) AS sampled"
    if how == "random":
        return f"SELECT * FROM {inner} ORDER BY RANDOM() LIMIT {size}"
    step = max(1, rows // max(1, size))
    if how == "systematic":
        return f"SELECT * FROM (SELECT *, ROW_NUMBER() OVER () AS rn FROM {inner}) AS numbered WHERE rn % {step} = 1 % {step} LIMIT {size}"
    if key is None:
        raise SamplingError(f"{how}: a column is needed")
    if how == "stratified":
        return f"SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY {key} ORDER BY RANDOM()) AS rn FROM {inner}) AS numbered WHERE rn <= {max(1, size // 10)} LIMIT {size}"
    if how == "temporal":
        return f"SELECT * FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY {key}) AS rn FROM {inner}) AS numbered WHERE rn % {step} = 1 % {step} LIMIT {size}"
    raise SamplingError(f"unknown sampling {how!r}")


# fixed values: rows from which a sample of each kind stands for its table, and from which none is called small
REPRESENTATIVE = {"systematic": 1000, "stratified": 1000, "random": 500, "reservoir": 500, "temporal": 2000, "multi_stage": 1500}
SMALL, LARGE, HUGE = 1000, 100_000, 1_000_000


@dataclass(frozen=True)
class SampleInfo:
    total_rows: int
    sampled_rows: int
    kind: str = "random"

    @property
    def ratio(self) -> float:
        return self.sampled_rows / self.total_rows if self.total_rows else 1.0

    @property
    def margin(self) -> float:
        """The width that a share's 95 % interval has about: 1.96 by the root of the rows; 1 without rows."""
        return 1.96 / math.sqrt(self.sampled_rows) if self.sampled_rows else 1.0

    @property
    def representative(self) -> bool:
        return self.sampled_rows >= REPRESENTATIVE.get(self.kind, SMALL)

    def warning(self) -> str | None:
        if not self.representative:
            return f"{self.sampled_rows} rows are few for a {self.kind} sample"
        return f"shares are known to {self.margin:.2f} only" if self.margin > 0.1 else None

    def advice(self) -> list[str]:
        """What would make the sample tell more."""
        out = []
        if self.sampled_rows < SMALL:
            out.append(f"take {SMALL} rows or more")
        if self.ratio < 0.01 and self.total_rows > LARGE:
            out.append("sample each stratum of a table as large as this")
        if self.kind == "random" and self.total_rows > HUGE:
            out.append("take every n-th row, or a reservoir, of a table as large as this")
        if self.kind == "temporal" and self.sampled_rows < REPRESENTATIVE["temporal"]:
            out.append("a sample in time needs more rows to show how it changes")
        return out


def value_reservoirs(df: DataFrame, columns: list[str] | None = None, size: int = 10_000, seed: int = 42) -> DataFrame:
    """``column`` and ``value``: of each column ``size`` values by chance, repeats included, nulls left out; the same for the same rows.

    Each task keeps its ``size`` least hashes of row and seed, so that what is moved doesn't grow with the rows.
    """
    whole = F.xxhash64(F.lit(seed), *[F.col(f"`{f.name}`") for f in df.schema.fields if f.dataType.typeName() != "map"])
    parts = []
    for f in fields(df):
        if columns is None or f.name in columns:
            cells = df.select(F.lit(f.name).alias("column"), f.text.alias("value"), whole.alias("_hash")).where("value is not null")
            parts.append(cells.orderBy("_hash", "value").limit(size).drop("_hash"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def shrunk(df: DataFrame, megabytes: float, ratio: float, order: list[str]) -> tuple[DataFrame, bool]:
    """``df``, and whether it was cut: a table whose texts take more than ``megabytes`` is left with every n-th row, ``ratio`` of them at most."""
    text = [F.coalesce(F.octet_length(f.text), F.lit(0)) for f in fields(df)]
    size, rows = df.agg(F.coalesce(F.sum(sum(text[1:], text[0])), F.lit(0)), F.count(F.lit(1))).first()
    if size // (1 << 20) <= megabytes:
        return df, False
    wanted = int(rows * ratio)
    if not wanted:
        return df.limit(0), True
    step = rows // wanted
    if step <= 1:
        return df, False
    return positioned(df, order).where((F.col("_position") % step == 0) & (F.col("_position") < step * wanted)).drop("_position"), True
