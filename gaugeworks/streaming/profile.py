"""Profiles of streams: each micro-batch is folded into one small mergeable state for each column.

Counts, sums and ranges add up, moments merge by their central sums, distinct values by HyperLogLog, quantiles by KLL sketch. A
batch is folded once, by its number, so a batch that comes again after a restart changes nothing. With a checkpoint the state is
written to ``STATE_DIR`` within it after each fold, before the batch counts as done, and read at the start; a checkpoint that
has done batches which the state lacks is refused. Conditions are looked at after each batch, and end the stream when they hold.
"""

from __future__ import annotations

import json
import math
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.errors import StateError
from gaugeworks.operators import aggregates as A
from gaugeworks.functions.predicates import looks_like_date
from gaugeworks.operators.fields import fields
from gaugeworks.operators.frequencies import cell_masks
from gaugeworks.streaming.limits import resident_memory


#: Values of a text column that its dates are told by; facts that add up.
FIRST = 100
ADDED = ("total", "nulls", "bytes", "integers", "floats", "booleans", "dates", "seen", "like_dates", "class_numeric", "class_date", "class_boolean", "class_text", "both", "dots", "commas", "encoding")


@dataclass
class ColumnState:
    total: int = 0
    nulls: int = 0
    n: int = 0
    mean: float = 0.0
    m2: float = 0.0
    low: float | None = None
    high: float | None = None
    min_length: int | None = None
    max_length: int | None = None
    bytes: int = 0
    integers: int = 0
    floats: int = 0
    booleans: int = 0
    dates: int = 0
    sketch: str = ""
    quantiles: str = ""
    #: Of a text column's first ``FIRST`` values how many look like dates, as they stand.
    seen: int = 0
    like_dates: int = 0
    m3: float = 0.0
    m4: float = 0.0
    class_numeric: int = 0
    class_date: int = 0
    class_boolean: int = 0
    class_text: int = 0
    both: int = 0
    dots: int = 0
    commas: int = 0
    encoding: int = 0
    #: Counts of pattern masks.
    masks: dict[str, int] = field(default_factory=dict)

    def merge(self, o: ColumnState) -> ColumnState:
        """Both together: central sums by the pairwise rules."""
        a, b, d = self.n, o.n, o.mean - self.mean
        n = a + b
        added = {k: getattr(self, k) + getattr(o, k) for k in ADDED}
        m3 = self.m3 + o.m3 + d**3 * a * b * (a - b) / n**2 + 3 * d * (a * o.m2 - b * self.m2) / n if n else 0.0
        m4 = self.m4 + o.m4 + d**4 * a * b * (a * a - a * b + b * b) / n**3 + 6 * d * d * (a * a * o.m2 + b * b * self.m2) / n**2 + 4 * d * (a * o.m3 - b * self.m3) / n if n else 0.0
        pick = lambda f, a, b: a if b is None else b if a is None else f(a, b)
        return ColumnState(
            n=n, m3=m3, m4=m4, **added, masks={m: self.masks.get(m, 0) + o.masks.get(m, 0) for m in {**self.masks, **o.masks}},
            mean=self.mean + d * o.n / n if n else 0.0, m2=self.m2 + o.m2 + d * d * self.n * o.n / n if n else 0.0,
            low=pick(min, self.low, o.low), high=pick(max, self.high, o.high),
            min_length=pick(min, self.min_length, o.min_length), max_length=pick(max, self.max_length, o.max_length),
            sketch=self.sketch or o.sketch, quantiles=self.quantiles or o.quantiles,
        )

    @property
    def variance(self) -> float | None:
        return None if not self.n else self.m2 / (self.n - 1) if self.n > 1 else 0.0

    @property
    def data_type(self) -> str:
        """A text column's type by what its values say, dates before booleans, and dates by its first values; a typed one's own."""
        n = self.total - self.nulls
        if not n:
            return "String"
        if self.integers == n:
            return "Integer"
        if self.floats / n > 0.8:
            return "Float"
        if (self.like_dates / self.seen if self.seen else self.dates / n) > 0.7:
            return "Date"
        return "Boolean" if self.booleans / n >= 0.9 else "String"


@dataclass
class StreamState:
    rows: int = 0
    bytes: int = 0
    last_batch: int = -1
    columns: dict[str, ColumnState] = field(default_factory=dict)
    #: Rows since the columns' types last changed.
    stable_rows: int = 0
    #: Rows without a null cell, and a sketch of the rows' hashes.
    complete: int = 0
    row_sketch: str = ""

    def fingerprint(self) -> str:
        return "|".join(f"{n}:{c.data_type}" for n, c in self.columns.items())

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> StreamState:
        doc = json.loads(text)
        return cls(**(doc | {"columns": {n: ColumnState(**c) for n, c in doc["columns"].items()}}))


# conditions that end a stream


@dataclass(frozen=True)
class Stop:
    """``max_rows``, ``max_bytes``, ``stable`` (rows without a change of types), ``confidence`` (of the means), ``memory`` (the share
    ``limit`` of ``bytes`` that this process holds), ``any``, ``all``, ``never``."""

    kind: str = "never"
    limit: float = 0
    parts: tuple["Stop", ...] = ()
    bytes: int = 0

    def reason(self, s: StreamState) -> str | None:
        if self.kind == "any":
            return next((r for p in self.parts if (r := p.reason(s))), None)
        if self.kind == "all":
            told = [p.reason(s) for p in self.parts]
            return " and ".join(told) if told and all(told) else None
        holds = {
            "never": lambda: False,
            "max_rows": lambda: s.rows >= self.limit,
            "max_bytes": lambda: s.bytes >= self.limit,
            "stable": lambda: s.stable_rows >= self.limit,
            "memory": lambda: self.bytes > 0 and resident_memory() > self.limit * self.bytes,
            "confidence": lambda: (e := standard_errors(s)) and max(e) <= 1 - self.limit,
        }[self.kind]()
        return self.kind if holds else None

    def rows(self) -> int | None:
        """The rows at which the condition holds whatever they are; None if rows alone don't make it hold."""
        if self.kind == "max_rows":
            return int(self.limit)
        told = [r for p in self.parts if (r := p.rows()) is not None]
        if self.kind == "any" and told:
            return min(told)
        return max(told) if self.kind == "all" and told and len(told) == len(self.parts) else None


def schema_inference() -> Stop:
    return Stop("any", parts=(Stop("max_rows", 10_000), Stop("stable", 1000)))


def quality_sample() -> Stop:
    return Stop("any", parts=(Stop("max_rows", 50_000), Stop("max_bytes", 50 << 20), Stop("confidence", 0.95)))


def standard_errors(s: StreamState) -> list[float]:
    return [math.sqrt(c.variance / c.n) / abs(c.mean) for c in s.columns.values() if c.data_type in ("Integer", "Float") and c.n > 1 and c.mean]


# the state's files

#: Folder of the states within a checkpoint; quartiles that a result has.
STATE_DIR, QUARTILES = "profile_state", (("q1", 0.25), ("median", 0.5), ("q3", 0.75))


def _files(spark: SparkSession, folder: str) -> tuple:
    """The folder's file system, its path, and the paths in it that are named by a number, by that number."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    found = [x.getPath() for x in fs.listStatus(path)] if fs.exists(path) else []
    return fs, path, {int(p.getName()): p for p in found if p.getName().isdigit()}


def save_state(spark: SparkSession, checkpoint: str, state: StreamState) -> None:
    """Writes the state under its batch's number; older ones go when it is whole."""
    fs, folder, old = _files(spark, f"{checkpoint}/{STATE_DIR}")
    if state.last_batch in old:  # the batch came again
        return
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    part, whole = path(folder, "_part"), path(folder, str(state.last_batch))
    out = fs.create(part, True)
    try:
        out.write(bytearray(state.to_json().encode()))
    finally:
        out.close()
    if not fs.rename(part, whole):
        raise StateError(f"{whole.toString()}: the state can't be written")
    for batch, p in old.items():
        if batch < state.last_batch:
            fs.delete(p, False)


def load_state(spark: SparkSession, checkpoint: str) -> StreamState | None:
    """The state of the latest batch, if there is one."""
    fs, _, found = _files(spark, f"{checkpoint}/{STATE_DIR}")
    if not found:
        return None
    source = fs.open(found[max(found)])
    try:
        return StreamState.from_json(bytes(source.readAllBytes()).decode())
    finally:
        source.close()


def last_commit(spark: SparkSession, checkpoint: str) -> int:
    """The last batch that the checkpoint counts as done; -1 if there is none."""
    return max(_files(spark, f"{checkpoint}/commits")[2], default=-1)


# folding


def _first_values(df: DataFrame, f, most: int) -> tuple[int, int]:
    """How many of a text column's first values there are, up to ``most``, and how many look like dates."""
    head = df.select(f.text.alias("t")).where(~A.P.is_null_like(F.col("t"))).limit(most)
    return tuple(head.agg(F.count(F.lit(1)), A.count_if(looks_like_date(F.col("t")))).first())


def fold_columns(df: DataFrame, before: dict[str, ColumnState] | None = None) -> dict[str, ColumnState]:
    """The state of one batch: one aggregate over its rows, and the first values of text columns that few were seen of."""
    found, wanted = fields(df), {}
    for k, f in enumerate(found):
        null, size = A.null_cell(f), F.octet_length(f.text)
        wanted |= {
            f"{k}_total": F.count(F.lit(1)), f"{k}_nulls": A.count_if(null), f"{k}_n": F.count(f.number), f"{k}_mean": F.coalesce(F.avg(f.number), F.lit(0.0)),
            f"{k}_m2": F.coalesce(F.var_pop(f.number) * F.count(f.number), F.lit(0.0)),
            f"{k}_m3": F.coalesce(F.skewness(f.number) * F.pow(F.var_pop(f.number), 1.5) * F.count(f.number), F.lit(0.0)),
            f"{k}_m4": F.coalesce((F.kurtosis(f.number) + 3) * F.pow(F.var_pop(f.number), 2.0) * F.count(f.number), F.lit(0.0)),
            f"{k}_low": F.min(f.number), f"{k}_high": F.max(f.number),
            f"{k}_min_length": F.min(F.when(~null, size)), f"{k}_max_length": F.max(F.when(~null, size)), f"{k}_bytes": F.coalesce(F.sum(size), F.lit(0)),
            f"{k}_sketch": F.hex(F.hll_sketch_agg(F.when(~null, f.text), F.lit(14))),
            f"{k}_quantiles": F.hex(F.kll_sketch_agg_double(F.when(~F.isnan(f.number.cast("double")), f.number.cast("double")))),
        }
        if f.kind is None:
            c = A.lexical_counts(f.text)
            wanted |= {f"{k}_{n}": c[n] for n in ("integers", "floats", "booleans", "dates", "class_numeric", "class_date", "class_boolean", "class_text")}
            dots, commas = [F.length(f.text) - F.length(F.replace(f.text, F.lit(x), F.lit(""))) for x in ".,"]
            wanted |= {f"{k}_both": A.count_if(~null & (dots > 0) & (commas > 0)), f"{k}_dots": A.count_if(~null & (dots == 1) & (commas == 0)), f"{k}_commas": A.count_if(~null & (dots == 0) & (commas == 1)), f"{k}_encoding": A.count_if(~null & A.P.has_encoding_artifact(f.text))}
        else:
            some = A.count_if(~null)
            is_kind = lambda *kinds, f=f, some=some: some if f.kind in kinds else F.lit(0).cast("long")
            wanted |= {f"{k}_integers": is_kind("Integer"), f"{k}_floats": is_kind("Integer", "Float"), f"{k}_booleans": is_kind("Boolean"), f"{k}_dates": is_kind("Date")}
    got = A.one_row(df, wanted)
    out = {f.name: ColumnState(**{n.partition("_")[2]: v for n, v in got.items() if n.partition("_")[0] == str(k)}) for k, f in enumerate(found)}
    for r in cell_masks(df).collect() if found else ():
        out[r["column"]].masks[str(r["mask"])] = r["n"]
    for f in found:
        c, had = out[f.name], (before or {}).get(f.name, ColumnState()).seen
        if f.kind is None and had < FIRST and c.total > c.nulls:
            c.seen, c.like_dates = _first_values(df, f, FIRST - had)
    return out


def fold(state: StreamState, df: DataFrame, batch: int) -> StreamState:
    """The state with a batch; as it was if the batch was folded before."""
    if batch <= state.last_batch:
        return state
    new, spark = fold_columns(df, state.columns), df.sparkSession
    rows = max((c.total for c in new.values()), default=0)
    columns = {n: state.columns.get(n, ColumnState(total=state.rows, nulls=state.rows)).merge(new.get(n, ColumnState(total=rows, nulls=rows))) for n in [*state.columns, *[n for n in new if n not in state.columns]]}
    for attribute, union in (("sketch", F.hll_union_agg), ("quantiles", F.kll_merge_agg_double)):
        both = [(n, x) for n in columns for x in (getattr(state.columns.get(n, ColumnState()), attribute), getattr(new.get(n, ColumnState()), attribute)) if x]
        if both:
            united = spark.createDataFrame(both, "n string, x string").groupBy("n").agg(F.hex(union(F.unhex("x"))).alias("x"))
            for r in united.collect():
                setattr(columns[r["n"]], attribute, r["x"])
    out = StreamState(state.rows + rows, state.bytes + sum(c.bytes for c in new.values()), batch, columns, complete=state.complete, row_sketch=state.row_sketch)
    if rows:
        whole = ~reduce(lambda a, b: a | b, [A.null_cell(f) for f in fields(df)])
        got = df.agg(A.count_if(whole), F.hex(F.hll_sketch_agg(F.xxhash64(*[f.text for f in fields(df)]), F.lit(14)))).first()
        out.complete += got[0]
        both = spark.createDataFrame([(x,) for x in (state.row_sketch, got[1]) if x], "x string")
        out.row_sketch = both.agg(F.hex(F.hll_union_agg(F.unhex("x")))).first()[0]
    out.stable_rows = state.stable_rows + rows if out.fingerprint() == state.fingerprint() else 0
    return out


def result(state: StreamState, spark: SparkSession) -> DataFrame:
    """One row for each column; the quartiles are those of the sketch."""
    rows = [(n, c.data_type, c.total, c.nulls, c.n, c.low, c.high, c.mean if c.n else None, c.variance, c.min_length, c.max_length, c.sketch, c.quantiles if c.n else None) for n, c in state.columns.items()]
    df = spark.createDataFrame(rows, "column string, data_type string, total_count long, null_count long, n long, min double, max double, mean double, variance double, min_length int, max_length int, sketch string, quantiles string")
    for name, rank in QUARTILES:
        df = df.withColumn(name, F.kll_sketch_get_quantile_double(F.unhex(F.when(F.col("quantiles") != "", F.col("quantiles"))), F.lit(rank)))
    return df.withColumn("distinct_count", F.when(F.col("sketch") != "", F.hll_sketch_estimate(F.unhex("sketch"))).otherwise(0)).drop("sketch", "quantiles")


def profile_stream(stream: DataFrame, stop: Stop | None = None, checkpoint: str | None = None, state: StreamState | None = None, progress: Callable[[str, dict], None] | None = None, available_now: bool = True, interval: float = 0.0) -> tuple[StreamState, str | None]:
    """Folds a streaming DataFrame until it ends or a condition holds; the state, and why it ended early if it did.

    With a checkpoint it goes on from the state that was saved there, unless ``state`` is given. ``progress`` is told of the
    start, the schema, each batch (those within ``interval`` seconds of the last one told are left out), of warnings and the end.
    """
    spark, why, tell, told = stream.sparkSession, [None], progress or (lambda *_: None), [0.0]
    if checkpoint and state is None:
        state = load_state(spark, checkpoint)
    held = [state or StreamState()]
    if checkpoint and held[0].last_batch < (done := last_commit(spark, checkpoint)):
        raise StateError(f"{checkpoint}: batches up to {done} are done, but the state ends at {held[0].last_batch}")
    stop = stop or Stop()

    def each(df: DataFrame, batch: int) -> None:
        if why[0]:
            if checkpoint:
                raise StateError("the profile has ended")  # else the batch would count as done
            return
        types = held[0].fingerprint()
        held[0] = fold(held[0], df, batch)
        if not types and held[0].columns:
            tell("schema", {"columns": {n: c.data_type for n, c in held[0].columns.items()}})
        elif types and held[0].fingerprint() != types:
            tell("warning", {"batch": batch, "message": "types changed", "columns": {n: c.data_type for n, c in held[0].columns.items()}})
        if checkpoint and held[0].last_batch == batch:
            save_state(spark, checkpoint, held[0])
        if time.monotonic() - told[0] >= interval:
            told[0] = time.monotonic()
            tell("batch", {"batch": batch, "rows": held[0].rows, "bytes": held[0].bytes})
        why[0] = stop.reason(held[0])

    writer = stream.writeStream.foreachBatch(each)
    writer = writer.option("checkpointLocation", checkpoint) if checkpoint else writer
    query = (writer.trigger(availableNow=True) if available_now else writer).start()
    tell("started", {"id": str(query.id)})
    try:
        while query.isActive and not why[0]:
            time.sleep(0.05)
        if why[0]:
            query.stop()
        elif query.exception():
            raise query.exception()
    finally:
        if query.isActive:
            query.stop()
    tell("finished", {"rows": held[0].rows, "reason": why[0]})
    return held[0], why[0]


def windowed_profile(stream: DataFrame, time_column: str, value: str, width: str = "1 hour", late: str = "10 minutes", by: list[str] | None = None) -> DataFrame:
    """Counts, nulls and moments of a number for each window of time; rows later than ``late`` are left out. For streams and tables."""
    x = F.col(value).cast("double")
    made = stream.withWatermark(time_column, late).groupBy(F.window(time_column, width).alias("w"), *(by or []))
    out = made.agg(F.count(F.lit(1)).alias("rows"), A.count_if(x.isNull()).alias("nulls"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *(by or []), "rows", "nulls", "min", "max", "mean")
