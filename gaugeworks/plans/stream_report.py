"""A report from a stream's state: the same document that a table's profile gives, by what adds up over batches."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gaugeworks.functions import patterns as R
from gaugeworks.operators import rules
from gaugeworks.operators.aggregates import moments_of
from gaugeworks.plans import quality as qual
from gaugeworks.plans.report import ColumnProfile, Execution, Report
from gaugeworks.streaming.profile import QUARTILES, ColumnState, StreamState

CLASSES = ("numeric", "date", "boolean", "text")


def stream_report(state: StreamState, spark: SparkSession, name: str = "stream", reason: str | None = None, locale: str | None = None, thresholds: qual.Thresholds | None = None) -> Report:
    """Distinct values, quartiles and duplicate rows are those of sketches. Modes, outliers, dates' order and decimals need a second
    look at the rows and aren't told, nor are accuracy, timeliness and precision assessed."""
    t = thresholds or qual.Thresholds()
    told = _sketches(state, spark)
    columns = [_column(n, c, told.get(n, {}), locale) for n, c in state.columns.items()]
    q = qual.Quality(low_sample_warning=state.rows < qual.LEAST_ROWS, weights=dict(t.weights), exact=False, sketched={"uniqueness": ["duplicate_rows", "key_distinct", "high_cardinality_columns"]})
    nulls = {n: c.nulls for n, c in state.columns.items()}
    q.completeness = qual.Completeness(state.rows * len(columns), sum(nulls.values()), state.rows, state.complete, [n for n, k in nulls.items() if state.rows and k / state.rows > t.null_column])
    values = sum(c.total - c.nulls for c in state.columns.values())
    violations = sum(c.both + min(c.dots, c.commas) for c in state.columns.values())
    q.consistency = qual.Consistency(values, sum(_conforming(n, c) for n, c in state.columns.items()), violations, sum(c.encoding for c in state.columns.values()), values)
    keys = [n for n in state.columns if rules.likely_id_name(n)]
    distinct = {n: told.get(n, {}).get("distinct", 0) for n in state.columns}
    wide = [n for n in state.columns if n not in keys and state.rows and distinct[n] / state.rows > t.high_cardinality]
    duplicates = max(0, state.rows - told[None]["distinct"]) if None in told else None
    q.uniqueness = qual.Uniqueness(state.rows, duplicates, keys[0] if keys else None, min(state.rows, distinct[keys[0]]) if keys else None, state.rows if keys else None, wide)
    strong = []
    for c in columns:
        best = [p for p in c.patterns if p["confidence"] >= t.pattern_confidence][:1]
        n = c.total_count - c.null_count
        strong += [(c.name, p["name"], n, min(p["match_count"], n)) for p in best]
    q.validity = qual.Validity(strong)
    return Report(
        id=uuid.uuid4().hex, timestamp=dt.datetime.now(dt.UTC).isoformat(), source={"identifier": name, "format": "stream", "kind": "stream", "bytes": state.bytes, "batches": state.last_batch + 1}, columns=columns,
        execution=Execution(rows_processed=state.rows, columns=len(columns), source_exhausted=reason is None, truncation_reason=reason), quality=q.as_dict(), dimension_scores=q.dimension_scores(),
    )


def _sketches(state: StreamState, spark: SparkSession) -> dict[str | None, dict]:
    """Estimates by column, and of the rows under None: one small job."""
    rows = [(n, c.sketch, c.quantiles if c.n else None) for n, c in state.columns.items()] + ([(None, state.row_sketch, None)] if state.row_sketch else [])
    if not rows:
        return {}
    df = spark.createDataFrame(rows, "n string, sketch string, quantiles string")
    quantile = lambda share: F.kll_sketch_get_quantile_double(F.unhex(F.when(F.col("quantiles") != "", F.col("quantiles"))), F.lit(share))
    made = df.select("n", F.coalesce(F.when(F.col("sketch") != "", F.hll_sketch_estimate(F.unhex("sketch"))), F.lit(0)).alias("distinct"), *[quantile(share).alias(name) for name, share in QUARTILES])
    return {r["n"]: r.asDict() for r in made.collect()}


def _column(name: str, c: ColumnState, told: dict, locale: str | None) -> ColumnProfile:
    kind, n, stats = c.data_type, c.total - c.nulls, {}
    classes = {k: getattr(c, f"class_{k}") for k in CLASSES}
    invalid = None
    if kind in ("Integer", "Float"):
        invalid = n - c.n
        stats = {"min": c.low, "max": c.high, "mean": c.mean if c.n else None, **moments_of(c.n, c.mean, 0.0, c.m2, c.m3, c.m4), "median": told.get("median"), "is_approximate": True}
        stats["quartiles"] = {"q1": told["q1"], "q2": told["median"], "q3": told["q3"], "iqr": told["q3"] - told["q1"]} if c.n >= 4 and told.get("q1") is not None else None
    elif kind == "String" and c.min_length is not None:
        stats = {"min_length": c.min_length, "max_length": c.max_length, "avg_length": c.bytes / n if n else None, "most_frequent": [], "least_frequent": []}
    dominant = max(classes, key=classes.get) if sum(classes.values()) else None
    return ColumnProfile(
        name=name, data_type=kind, total_count=c.total, null_count=c.nulls, unique_count=min(n, told.get("distinct", 0)), unique_count_is_approximate=True, invalid_count=invalid,
        type_homogeneity=classes | {"dominant": dominant, "dominant_share": classes[dominant] / sum(classes.values())} if dominant else None, stats=stats, patterns=R.detect({int(m): k for m, k in c.masks.items()}, locale),
    )


def _conforming(name: str, c: ColumnState) -> int:
    """Values that are what their column is; all of a typed column's."""
    n, kind = c.total - c.nulls, c.data_type
    classes = [getattr(c, f"class_{k}") for k in CLASSES]
    if not sum(classes):
        return n
    if kind in ("Integer", "Float", "Boolean"):
        return {"Integer": c.integers, "Float": c.floats, "Boolean": c.booleans}[kind]
    return c.class_date if kind == "Date" or rules.likely_date_name(name) else max(classes)
