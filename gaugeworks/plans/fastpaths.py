"""Answers that need no profile: schema, row count, structure."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.operators import aggregates as A
from gaugeworks.operators import frequencies as Q
from gaugeworks.operators.fields import fields
from gaugeworks.sources import files, memory

SCHEMA_ROWS, FULL_COUNT_BYTES, WINDOWS, WINDOW_BYTES = 1000, 10 << 20, 16, 1 << 16


@dataclass(frozen=True)
class SchemaResult:
    columns: list[tuple[str, str]]
    rows_sampled: int
    truncated: bool


@dataclass(frozen=True)
class RowCount:
    count: int
    exact: bool
    method: str
    relative_error: float | None = None


@dataclass(frozen=True)
class ColumnSummary:
    name: str
    data_type: str
    null_count: int
    distinct_count: int


@dataclass(frozen=True)
class Structure:
    columns: list[ColumnSummary]
    rows: RowCount
    rows_sampled: int
    warnings: list[str] = field(default_factory=list)


def column_types(df: DataFrame) -> list[tuple[str, str]]:
    """The columns' types, those of text columns by what their cells say."""
    found = fields(df)
    texts = [f.name for f in found if f.kind is None]
    told = {r["column"]: r["data_type"] for r in Q.lexical_profile(df, texts).collect()} if texts else {}
    return [(f.name, f.kind or told[f.name]) for f in found]


def infer_schema(spark: SparkSession, source: object, rows: int = SCHEMA_ROWS, **kw) -> SchemaResult:
    """Types from the first rows; a Parquet file's from its footer."""
    if isinstance(source, str) and (kw.get("format") or files.detect_format(source)) == "parquet":
        df, _ = files.read_parquet(spark, source)
        if all(f.kind for f in fields(df)):
            return SchemaResult([(f.name, f.kind) for f in fields(df)], 0, False)
        return SchemaResult([(f.name, f.kind or "String") for f in fields(df)], 0, False)
    df, _ = files.read_path(spark, source, **kw) if isinstance(source, str) else memory.to_frame(spark, source)
    head = df.limit(rows + 1)
    n = head.count()
    return SchemaResult(column_types(df.limit(rows)), min(n, rows), n > rows)


def quick_row_count(spark: SparkSession, source: object, estimate: bool = True, **kw) -> RowCount:
    """Parquet rows from the footers, small text files counted, larger ones estimated from windows of bytes across the file."""
    if not isinstance(source, str):
        df, _ = memory.to_frame(spark, source)
        return RowCount(df.count(), True, "scan")
    kind = kw.get("format") or files.detect_format(source)
    if kind == "parquet":
        return RowCount(spark.read.parquet(source).count(), True, "footer")
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(source)
    status = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path)
    size = status.getLen()
    if not estimate or status.isDirectory() or size < FULL_COUNT_BYTES or kind == "json":
        df, _ = files.read_path(spark, source, **kw)
        return RowCount(df.count(), True, "scan")
    stream = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(path)
    densities = []
    for k in range(WINDOWS):
        at = int(k * (size - WINDOW_BYTES) / (WINDOWS - 1))
        stream.seek(at)
        raw = bytes(stream.readNBytes(WINDOW_BYTES))
        densities.append(raw.count(b"\n") / len(raw))
    stream.close()
    mean = sum(densities) / WINDOWS
    error = (sum((d - mean) ** 2 for d in densities) / (WINDOWS - 1) / WINDOWS) ** 0.5
    header = kind == "csv"
    return RowCount(max(0, round(mean * size) - header), False, "windows", error / mean if mean else None)


def analyze_structure(spark: SparkSession, source: object, rows: int = SCHEMA_ROWS, **kw) -> Structure:
    """Types, nulls and distinct values of the first rows, the row count, and what to be aware of."""
    df, info = files.read_path(spark, source, **kw) if isinstance(source, str) else memory.to_frame(spark, source)
    count = quick_row_count(spark, source, **kw)
    head = df.limit(rows)
    found = fields(head)
    facts = A.one_row(head, {"n": F.count(F.lit(1))} | {f"{k}_{w}": c for k, f in enumerate(found) for w, c in (("null", A.count_if(A.null_cell(f))), ("distinct", F.count_distinct(F.when(~A.null_cell(f), f.text))))})
    types = dict(column_types(head))
    warnings = [] if count.exact else ["row_count_estimated"]
    warnings += ["structure_sample_truncated"] if count.count > rows else []
    warnings += [f"malformed_lines_skipped:{info.error_count}"] if info.error_count else []
    return Structure([ColumnSummary(f.name, types[f.name], facts[f"{k}_null"], facts[f"{k}_distinct"]) for k, f in enumerate(found)], count, facts["n"], warnings)


