"""Rows that the caller holds: dicts, lists, bytes, pandas, Arrow."""

from __future__ import annotations

import io
import json
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.errors import CsvError, DuplicateColumns, ParquetError, SchemaError, UnsupportedSource
from gaugeworks.sources.files import CsvOptions, SourceInfo, _from_records, detect_delimiter, json_elements, json_records, parse_csv_chunk, repaired


def cell_text(value: object) -> str | None:
    """A value as text: None and NaN are null, booleans in lower case, nested values as compact JSON with sorted keys."""
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (dict, list, tuple)):
        return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str)
    return str(value)


def _text_frame(spark: SparkSession, names: list[str], rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, T.StructType([T.StructField(n, T.StringType()) for n in names]))


def from_columns(spark: SparkSession, columns: dict[str, list]) -> DataFrame:
    if len({len(v) for v in columns.values()}) > 1:
        raise SchemaError("columns of different lengths")
    return _text_frame(spark, [*map(str, columns)], [tuple(map(cell_text, r)) for r in zip(*columns.values(), strict=True)])


def from_records(spark: SparkSession, records: list[dict]) -> DataFrame:
    """Columns in the order in which their names first appear; absent values are null."""
    names = [*dict.fromkeys(str(k) for r in records for k in r)]
    return _text_frame(spark, names, [tuple(cell_text(r.get(n)) for n in names) for r in records])


def from_bytes(spark: SparkSession, raw: bytes, format: str = "csv", csv_options: CsvOptions | None = None, strict: bool = False) -> tuple[DataFrame, SourceInfo]:
    """Bytes of any file format. They are the driver's own, so it cuts them into records; Spark gets these, on any cluster."""
    info = SourceInfo("bytes", format, "bytes")
    if format == "parquet":
        import pyarrow as pa
        import pyarrow.parquet as pq

        try:
            df = from_arrow(spark, pq.read_table(io.BytesIO(raw)))
        except (pa.ArrowInvalid, OSError) as e:
            raise ParquetError(f"bytes: {e}") from None
        info.columns = df.columns
        return df, info
    if format == "csv":
        return _csv_bytes(spark, raw, csv_options or CsvOptions(flexible=not strict), info)
    if format not in ("json", "jsonl"):
        raise UnsupportedSource(f"bytes: unknown format {format}")
    text = raw.decode("utf-8", "replace").removeprefix("\ufeff")
    lines, fault = json_elements(text) if format == "json" else (text.split("\n"), None)
    records = json_records(spark.createDataFrame([(x,) for x in [*lines, *([fault] if fault else [])]], "value string"))
    counts = records.agg(F.count(F.when(F.col("ok"), 1)).alias("good"), F.count(F.when(~F.col("ok"), 1)).alias("bad")).first()
    info.error_count = counts["bad"]
    return _from_records(records, counts, info, strict)


def _csv_bytes(spark: SparkSession, raw: bytes, o: CsvOptions, info: SourceInfo) -> tuple[DataFrame, SourceInfo]:
    sep = o.delimiter or detect_delimiter(raw)
    text = raw.decode(o.encoding, "replace").removeprefix("\ufeff")
    names, rows, _ = parse_csv_chunk(text, sep, o.header, CsvOptions(**{**o.__dict__, "flexible": True}))
    names = [x.strip() for x in names] if names else [f"column_{k}" for k in range(len(rows[0]))] if rows else []
    info.columns, info.details = names, {"delimiter": sep, "encoding": o.encoding}
    info.ragged_rows = sum(len(r) != len(names) for r in rows)
    if info.ragged_rows and not o.flexible:
        raise CsvError(f"bytes: {info.ragged_rows} rows have another number of fields than the header")
    fit = (lambda r: repaired(r, len(names), sep)) if o.repair else (lambda r: (r + [""] * (len(names) - len(r)))[: len(names)])
    return _text_frame(spark, names, [tuple(fit(r)) for r in rows]) if names else spark.createDataFrame([], T.StructType([])), info


def from_arrow(spark: SparkSession, table) -> DataFrame:
    """An Arrow table, or anything that gives one through ``__arrow_c_stream__``."""
    import pyarrow as pa

    return spark.createDataFrame(table if isinstance(table, pa.Table) else pa.table(table))


def to_frame(spark: SparkSession, source: object) -> tuple[DataFrame, SourceInfo]:
    """Any source that isn't a path."""
    kind = type(source).__name__
    if isinstance(source, DataFrame):
        return source, SourceInfo("dataframe", "dataframe", "dataframe", source.columns)
    if isinstance(source, dict):
        df = from_columns(spark, source)
    elif isinstance(source, list):
        df = from_records(spark, source)
    elif isinstance(source, (bytes, io.BytesIO)):
        return from_bytes(spark, source if isinstance(source, bytes) else source.getvalue())
    elif type(source).__module__.startswith("pandas"):
        if len(set(source.columns)) < len(source.columns):
            raise DuplicateColumns("duplicate column names")
        df = from_arrow(spark, _pandas_table(source))
    elif hasattr(source, "__arrow_c_stream__") or kind == "Table":
        df = from_arrow(spark, source)
    else:
        raise UnsupportedSource(f"{kind}: not a source of rows")
    return df, SourceInfo(kind, "memory", "memory", df.columns)


def _pandas_table(frame):
    import pyarrow as pa

    return pa.Table.from_pandas(frame, preserve_index=False)
