"""Files as DataFrames: formats, CSV dialects, ragged rows, JSON records, Parquet footers.

Paths are read by Spark, so they may lie in any store that it knows. What is looked at before that, a file's first bytes,
comes through Spark's binary reader as well.
"""

from __future__ import annotations

import csv
import io
import json
import re
import statistics
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from itertools import islice
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.errors import CsvError, DuplicateColumns, EncodingError, FormatError, JsonError, MalformedRecords, MissingFile, ParquetError, RecoveryFailed, SchemaError, UnsupportedSource
from gaugeworks.operators.fields import duplicate_names

# fixed values: formats by the ending of a name, delimiters in the order in which ties are settled
FORMATS = {"csv": "csv", "tsv": "csv", "txt": "csv", "json": "json", "jsonl": "jsonl", "ndjson": "jsonl", "parquet": "parquet"}
DELIMITERS = (",", ";", "\t", "|")
HEAD_BYTES, HEAD_RECORDS, MOST_FOOTERS = 4096, 5, 256
#: Bytes that are read at a bound to find a line's end, and bytes of a file that one task reads at once.
LOOKED_AT, STRETCH = 1 << 16, 1 << 25


@dataclass
class SourceInfo:
    """Where rows come from, and what its reading left out."""

    identifier: str
    format: str
    kind: str = "file"
    columns: list[str] = field(default_factory=list)
    ragged_rows: int = 0
    error_count: int = 0
    details: dict = field(default_factory=dict)


def detect_format(path: str) -> str:
    """By the name's ending; without one CSV; another one is unknown."""
    ending = PurePosixPath(path.rstrip("/")).suffix.lower().lstrip(".")
    return FORMATS.get(ending, "unknown") if ending else "csv"


def head(spark: SparkSession, path: str, size: int = HEAD_BYTES) -> bytes:
    """The first bytes of a file, or of the first file of a folder. No more than these are read."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(where):
        raise MissingFile(f"{path}: no such file")
    if system.getFileStatus(where).isDirectory():
        inside = sorted(str(s.getPath()) for s in system.listStatus(where) if s.isFile() and not s.getPath().getName().startswith(("_", ".")))
        if not inside:
            return b""
        where = jvm.org.apache.hadoop.fs.Path(inside[0])
    stream = system.open(where)
    try:
        return bytes(stream.readNBytes(size))
    finally:
        stream.close()


def detect_delimiter(sample: bytes) -> str:
    """The candidate that cuts the first records into the most alike numbers of fields."""
    text = sample[:HEAD_BYTES].decode("utf-8", "replace").removeprefix("﻿")
    best, chosen = (False, 0.0, 0), ","
    for sign in DELIMITERS:
        rows = [r for r in csv.reader(io.StringIO(text), delimiter=sign) if any(x.strip() for x in r)][:HEAD_RECORDS]
        if not rows:
            continue
        sizes = [len(r) for r in rows]
        usual = statistics.mode(sizes)
        score = (usual > 1, sizes.count(usual) / len(sizes), usual)
        if score > best:
            best, chosen = score, sign
    return chosen


@dataclass(frozen=True)
class EncodingDiagnosis:
    encoding: str
    first_bad_byte: int | None


def diagnose_encoding(raw: bytes) -> EncodingDiagnosis | None:
    """What bytes that aren't UTF-8 probably are; None if they are UTF-8."""
    for mark, name in ((b"\xff\xfe", "utf-16le"), (b"\xfe\xff", "utf-16be")):
        if raw.startswith(mark):
            return EncodingDiagnosis(name, 0)
    try:
        raw.decode("utf-8")
    except UnicodeDecodeError as e:
        if e.end == len(raw) and e.reason == "unexpected end of data":
            return None  # a sign cut off by the sample's end
        return EncodingDiagnosis("windows-1252" if any(0x80 <= b <= 0x9F for b in raw) else "latin-1", e.start)
    return None


def _names(spark: SparkSession, path: str, sep: str, quote: str, header: bool, encoding: str) -> list[str]:
    try:
        raw = head(spark, path, 1 << 16).decode("utf-8" if encoding.lower() == "utf-8" else encoding, "replace").removeprefix("﻿")
    except LookupError:
        raise EncodingError(f"{encoding}: no such encoding") from None
    first = next((r for r in csv.reader(io.StringIO(raw), delimiter=sep, quotechar=quote or '"') if r), [])
    names = [x.strip() for x in first] if header else [f"column_{k}" for k in range(len(first))]
    if twice := duplicate_names(names):
        raise DuplicateColumns(f"duplicate column names: {', '.join(twice)}")
    return names


@dataclass
class CsvOptions:
    delimiter: str | None = None
    quote: str = '"'
    header: bool = True
    flexible: bool = True
    trim: bool = False
    encoding: str = "UTF-8"
    #: Whether fields may hold line breaks; None looks into the file, which is split among tasks if none does.
    multiline: bool | None = None
    #: Whether a row of one field more than the header has its last two joined again, as if the delimiter weren't quoted.
    repair: bool = True


RAGGED = "_ragged"


def has_quoted_breaks(spark: SparkSession, path: str, quote: str) -> bool:
    """Whether any line has an odd number of quotes, as those have that a quoted line break cuts. One pass, split among tasks."""
    if not quote:
        return False
    c = F.col("value")
    return spark.read.text(path).where(F.pmod(F.length(c) - F.length(F.replace(c, F.lit(quote), F.lit(""))), F.lit(2)) == 1).limit(1).count() > 0


def read_csv(spark: SparkSession, path: str, options: CsvOptions | None = None) -> tuple[DataFrame, SourceInfo]:
    """All columns as text. Short rows are filled with empty texts, long rows cut, and both counted; a strict reading refuses them.

    Of a row with one field too many the last two are joined by the delimiter, unless ``repair`` is off. Files without a
    quoted line break are split among tasks.
    """
    o = options or CsvOptions()
    sample = head(spark, path)
    sep = o.delimiter or detect_delimiter(sample)
    names = _names(spark, path, sep, o.quote, o.header, o.encoding)
    info = SourceInfo(path, "csv", columns=names, details={"delimiter": sep, "encoding": o.encoding})
    if not names:
        return spark.createDataFrame([], T.StructType([])), info
    multiline = has_quoted_breaks(spark, path, o.quote) if o.multiline is None else o.multiline
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names] + [T.StructField(RAGGED, T.StringType())])
    dialect = {"sep": sep, "quote": o.quote, "escape": o.quote, "ignoreLeadingWhiteSpace": o.trim, "ignoreTrailingWhiteSpace": o.trim, "nullValue": "\x00", "emptyValue": ""}
    rows = spark.read.schema(schema).options(**dialect, header=o.header, multiLine=multiline, encoding=o.encoding, mode="PERMISSIVE", columnNameOfCorruptRecord=RAGGED, enforceSchema=True).csv(path)
    columns = [F.col(f"`{n}`") for n in names]
    # the reader marks a row only if it parses it: all columns are asked for with the mark
    whole = F.length(F.concat_ws("", *columns)) >= 0
    info.ragged_rows = rows.agg(F.count(F.when(F.col(RAGGED).isNotNull() & whole, 1))).first()[0]
    if info.ragged_rows and not o.flexible:
        raise CsvError(f"{path}: {info.ragged_rows} rows have another number of fields than the header")
    if not info.ragged_rows:
        return rows.select(*columns), info
    ragged = F.col(RAGGED).isNotNull()
    filled = [F.when(ragged, F.coalesce(c, F.lit(""))).otherwise(c).alias(n) for n, c in zip(names, columns, strict=True)]
    if o.repair:
        wide = T.StructType([T.StructField(f"f{k}", T.StringType()) for k in range(len(names) + 2)])
        again = F.from_csv(F.col(RAGGED), wide.simpleString()[7:-1].replace(":", " "), {k: str(v).lower() if isinstance(v, bool) else v for k, v in dialect.items()})
        last, one_more = again[f"f{len(names) - 1}"], again[f"f{len(names)}"].isNotNull() & again[f"f{len(names) + 1}"].isNull()
        filled[-1] = F.when(ragged & one_more, F.concat(F.coalesce(last, F.lit("")), F.lit(sep), again[f"f{len(names)}"])).when(ragged, F.coalesce(columns[-1], F.lit(""))).otherwise(columns[-1]).alias(names[-1])
    return rows.select(*filled), info


def read_csv_with_recovery(spark: SparkSession, path: str, options: CsvOptions | None = None) -> tuple[DataFrame, SourceInfo, list[str]]:
    """A strict reading, else a flexible one, else with other delimiters and encodings: the first that gives rows. Tells what was tried."""
    o, tried = options or CsvOptions(), []
    diagnosis = diagnose_encoding(head(spark, path, 1 << 20))
    attempts = [CsvOptions(**{**o.__dict__, "flexible": False}), CsvOptions(**{**o.__dict__, "flexible": True})]
    attempts += [CsvOptions(**{**o.__dict__, "delimiter": d, "flexible": True}) for d in DELIMITERS if d != o.delimiter]
    if diagnosis:
        attempts.insert(0, CsvOptions(**{**o.__dict__, "encoding": diagnosis.encoding, "flexible": True}))
    for a in attempts:
        tried.append(f"{'flexible' if a.flexible else 'strict'}, delimiter {a.delimiter or 'detected'}, {a.encoding}")
        try:
            df, info = read_csv(spark, path, a)
            return df, info, tried
        except (MalformedRecords, SchemaError):
            continue
    raise RecoveryFailed(f"{path}: not readable as CSV; tried {'; '.join(tried)}", tried)


@dataclass(frozen=True)
class CsvDiagnostics:
    """What a CSV file's lines look like, before any is parsed."""

    total_lines: int
    empty_lines: int
    null_bytes: int
    unmatched_quotes: int
    most_common_field_count: int
    consistent_field_rows: int
    inconsistent_field_rows: int
    field_count_variations: int
    delimiter: str
    encoding: EncodingDiagnosis | None


def validate_csv(spark: SparkSession, path: str, options: CsvOptions | None = None) -> CsvDiagnostics:
    """The file's lines by their number of fields, with what makes a reading fail: one aggregate over the lines."""
    o = options or CsvOptions()
    sep = o.delimiter or detect_delimiter(head(spark, path))
    found = line_shapes(spark.read.text(path), sep).collect()  # a row for each number of fields
    empty = sum(r["lines"] for r in found if r["fields"] is None)
    shapes = {r["fields"]: r for r in found if r["fields"] is not None}
    total = sum(r["lines"] for r in shapes.values())
    # the least of several numbers that are as frequent
    usual, most = max(((k, r["lines"]) for k, r in shapes.items()), key=lambda x: (x[1], -x[0]), default=(0, 0))
    return CsvDiagnostics(total, empty, sum(r["null_bytes"] for r in shapes.values()), sum(r["unmatched_quotes"] for r in shapes.values()), usual, most, total - most, len(shapes), sep, diagnose_encoding(head(spark, path, 1 << 20)))


def line_shapes(lines: DataFrame, delimiter: str, column: str = "value") -> DataFrame:
    """``fields`` (null for blank lines), ``lines``, ``null_bytes``, ``unmatched_quotes``: lines by their number of fields outside quotes."""
    c = F.col(column)
    count = lambda x, sign: F.length(x) - F.length(F.replace(x, F.lit(sign), F.lit("")))
    fields = F.when(F.btrim(c, F.lit(" \t\r\n")) != "", count(F.regexp_replace(c, '"[^"]*"', ""), delimiter) + 1)
    flag = lambda x: F.sum(F.when(x, 1).otherwise(0))
    return lines.groupBy(fields.alias("fields")).agg(F.count(F.lit(1)).alias("lines"), flag(F.contains(c, F.lit("\x00"))).alias("null_bytes"), flag(F.pmod(count(c, '"'), F.lit(2)) == 1).alias("unmatched_quotes"))


def parse_csv_chunk(data: str, delimiter: str = ",", header: bool = True, options: CsvOptions | None = None) -> tuple[list[str] | None, list[list[str]], int]:
    """Names, records and the number of records left out of a piece of CSV that the caller holds. A strict reading leaves ragged ones out."""
    o = options or CsvOptions()
    rows = [[x.strip() for x in r] if o.trim else r for r in csv.reader(io.StringIO(data), delimiter=delimiter, quotechar=o.quote or '"') if r]
    names = rows.pop(0) if header and rows else None
    if names and (twice := duplicate_names(names)):
        raise DuplicateColumns(f"duplicate column names: {', '.join(twice)}")
    width = len(names) if names else len(rows[0]) if rows else 0
    kept = rows if o.flexible else [r for r in rows if len(r) == width]
    return names, kept, len(rows) - len(kept)


def repaired(row: list[str], width: int, delimiter: str) -> list[str]:
    """A record of ``width`` fields: filled, cut, or with the last two joined if there is one too many."""
    if len(row) == width + 1:
        return [*row[: width - 1], f"{row[width - 1]}{delimiter}{row[width]}"]
    return (row + [""] * (width - len(row)))[:width]


def _cut(read: Callable[[int, int], bytes], at: int, total: int, size: int) -> Iterator[tuple[int, int]]:
    """Stretches of about ``size`` bytes from ``at`` to ``total`` that end with a line each; ``read`` gives bytes from a place. None is read twice."""
    held, first = b"", at
    while at < total:
        end = at + max(1, size)
        look = end - 1
        while end < total:
            if not first <= look < first + len(held):
                held, first = read(look, LOOKED_AT), look
                if not held:
                    raise EOFError(f"no byte at {look} of {total}")
            if (k := held.find(b"\n", look - first)) >= 0:
                end = first + k + 1
                break
            look = first + len(held)
            end = look + 1
        end = min(end, total)
        yield at, end
        at = end


def chunk_bounds(spark: SparkSession, path: str, size: int) -> list[tuple[int, int]]:
    """Stretches of about ``size`` bytes of a file that end with a line each. Only what is around the bounds is read, and that once."""

    def read(at: int, n: int) -> bytes:
        stream.seek(at)
        return bytes(stream.readNBytes(n))

    total = file_size(spark, path)
    with opened(spark, path) as stream:
        return [*_cut(read, 0, total, size)]


def read_chunks(spark: SparkSession, path: str, size: int) -> DataFrame:
    """``file``, ``start``, ``content``: all stretches of about ``size`` bytes of a file, or of a folder's files, that end with a line each.

    The driver cuts files of more than ``STRETCH`` bytes, which costs a look at each bound; a task reads a stretch at once and cuts it further.
    """
    found = [(f, *b) for f, n in _files(spark, path) for b in (chunk_bounds(spark, f, STRETCH) if n > STRETCH else [(0, n)])]

    def cut(batches):
        import pyarrow as pa
        from pyarrow import fs

        for batch in batches:
            for r in batch.to_pylist():
                system, place = fs.FileSystem.from_uri(r["file"]) if "://" in r["file"] or r["file"].startswith("file:") else (fs.LocalFileSystem(), r["file"])
                with system.open_input_file(place) as stream:
                    raw = stream.read_at(r["end"] - r["start"], r["start"])
                cuts = _cut(lambda at, n: raw[at : at + n], 0, len(raw), size)
                while some := [*islice(cuts, max(1, (1 << 22) // max(1, size)))]:
                    yield pa.record_batch([pa.array([r["file"]] * len(some)), pa.array([r["start"] + a for a, _ in some]), pa.array([raw[a:b] for a, b in some], pa.binary())], ["file", "start", "content"])

    return spark.createDataFrame(found, "file string, start long, end long").mapInArrow(cut, "file string, start long, content binary")


def _files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Addresses and sizes of a file, or of a folder's files, those that aren't empty."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(where):
        raise MissingFile(f"{path}: no such file")
    inside = [s for s in system.listStatus(where) if s.isFile()]
    if system.getFileStatus(where).isDirectory():
        inside = [s for s in inside if not s.getPath().getName().startswith(("_", "."))]
    # Hadoop writes local addresses with one slash
    return sorted((re.sub(r"\Afile:/(?!/)", "file:///", str(s.getPath())), s.getLen()) for s in inside if s.getLen())


def read_chunk(spark: SparkSession, path: str, bounds: tuple[int, int]) -> bytes:
    with opened(spark, path) as stream:
        stream.seek(bounds[0])
        return bytes(stream.readNBytes(bounds[1] - bounds[0]))


def file_size(spark: SparkSession, path: str) -> int:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(where):
        raise MissingFile(f"{path}: no such file")
    return system.getContentSummary(where).getLength()


@contextmanager
def opened(spark: SparkSession, path: str) -> Iterator:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(where)
    try:
        yield stream
    finally:
        stream.close()


def json_records(lines: DataFrame, column: str = "value") -> DataFrame:
    """``ok`` and ``record`` (a map of flattened texts) of each line that isn't blank.

    A line is good if it is one JSON object: its keys are asked for, as the parser alone takes two objects on a line for one.
    """
    text = F.btrim(F.col(column), F.lit(" \t\r\n"))
    rows = lines.where(F.length(text) > 0)
    ok = F.json_object_keys(text).isNotNull() & ~text.rlike(r"\}\s*\{")
    return rows.select(F.coalesce(ok, F.lit(False)).alias("ok"), F.from_json(text, "map<string,string>").alias("record"), F.json_object_keys(text).alias("keys"), F.monotonically_increasing_id().alias("line"))


def read_jsonl(spark: SparkSession, path: str, strict: bool = False) -> tuple[DataFrame, SourceInfo]:
    """One object for each line; nested values as compact JSON, keys in the order in which they first appear, absent ones null.

    Other lines are counted, or refused by a strict reading. A file of none but such lines is an error.
    """
    records = json_records(spark.read.text(path))
    counts = records.agg(F.count(F.when(F.col("ok"), 1)).alias("good"), F.count(F.when(~F.col("ok"), 1)).alias("bad")).first()
    info = SourceInfo(path, "jsonl", error_count=counts["bad"])
    return _from_records(records, counts, info, strict)


def _from_records(records: DataFrame, counts, info: SourceInfo, strict: bool) -> tuple[DataFrame, SourceInfo]:
    if counts["bad"] and (strict or not counts["good"]):
        raise JsonError(f"{info.identifier}: {counts['bad']} records aren't JSON objects")
    good = records.where("ok")
    # keys in the order in which they first appear, by line and place; those of a column set are few
    seen = good.select("line", F.posexplode("keys").alias("at", "key")).groupBy("key").agg(F.min(F.struct("line", "at")).alias("first"))
    places = seen.orderBy("first").collect()
    info.columns = [r["key"] for r in places]
    value = lambda k: F.element_at("record", F.lit(k))
    return good.select(*[F.coalesce(value(k), F.lit("")).alias(k) for k in info.columns]), info


def _no_constant(name: str) -> None:
    raise ValueError(f"{name}: no number of JSON")


_DECODER = json.JSONDecoder(parse_constant=_no_constant)
_BLANK = re.compile(r"[ \t\r\n]*")


def json_elements(text: str) -> tuple[list[str], str | None]:
    """The elements of an array, or the one object that a document is, and what ends the document too early, if anything does.

    Elements before a fault are whole. A document without any element before its fault isn't JSON.
    """
    blank = lambda at: _BLANK.match(text, at).end()
    at = blank(1 if text.startswith("\ufeff") else 0)
    if not text.startswith("[", at):
        try:
            _, end = _DECODER.raw_decode(text, at)
        except ValueError as e:
            raise JsonError(f"not a JSON document: {e}") from None
        return [text[at:end]], None if blank(end) == len(text) else "content after the document"
    out, fault, at = [], None, blank(at + 1)
    closed = text.startswith("]", at)
    while not closed:
        try:
            _, end = _DECODER.raw_decode(text, at)
        except ValueError:
            fault = "a comma with no element after it" if text[at : at + 1] in ("]", ",") else "an element that isn't JSON" if at < len(text) else "no closing bracket"
            break
        out.append(text[at:end])
        at = blank(end)
        if text.startswith("]", at):
            closed = True
        elif text.startswith(",", at):
            at = blank(at + 1)
        else:
            fault = "no closing bracket" if at >= len(text) else "no comma between elements"
            break
    if closed and blank(at + 1) < len(text):
        fault = "content after the document"
    if fault and not out:
        raise JsonError(f"not a JSON document: {fault}")
    return out, fault


def read_json(spark: SparkSession, path: str, strict: bool = False) -> tuple[DataFrame, SourceInfo]:
    """A document: an array of objects, or one object as one record. A file is one task, as nothing tells where an element begins.

    Elements that aren't objects count as errors, and so does what breaks the array off: what stands before it is kept. A
    strict reading refuses both.
    """
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for text in batch.column(0).to_pylist():
                found, fault = json_elements(text)
                for k in range(0, max(1, len(found)), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(found[k : k + 10_000], pa.string())], names=["value"])
                if fault:
                    yield pa.RecordBatch.from_arrays([pa.array([fault])], names=["value"])  # no object: an error

    elements = spark.read.text(path, wholetext=True).mapInArrow(run, "value string")
    records = json_records(elements)
    try:
        counts = records.agg(F.count(F.when(F.col("ok"), 1)).alias("good"), F.count(F.when(~F.col("ok"), 1)).alias("bad")).first()
    except Exception as e:
        if "not a JSON document" in str(e):
            raise JsonError(f"{path}: not a JSON document") from None
        raise
    return _from_records(records, counts, SourceInfo(path, "json", error_count=counts["bad"]), strict)


def parquet_footer(spark: SparkSession, path: str) -> dict:
    """Row groups, rows, compression, version and sizes, from the footers alone; of a folder with over ``MOST_FOOTERS`` files the number of files."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    if not re.match(r"[a-z0-9]+://", path):
        path = "file://" + (path if path.startswith("/") else str(PurePosixPath.cwd() / path))
    system, where = fs.FileSystem.from_uri(path)
    files = [where] if system.get_file_info(where).type == fs.FileType.File else sorted(i.path for i in system.get_file_info(fs.FileSelector(where)) if i.path.endswith(".parquet"))
    if len(files) > MOST_FOOTERS:
        return {"num_files": len(files)}
    groups = rows = packed = plain = 0
    codecs, version = set(), None
    for f in files:
        meta = pq.read_metadata(f, filesystem=system)
        groups, rows, version = groups + meta.num_row_groups, rows + meta.num_rows, meta.format_version
        for g in range(meta.num_row_groups):
            for c in range(meta.num_columns):
                col = meta.row_group(g).column(c)
                packed, plain = packed + col.total_compressed_size, plain + col.total_uncompressed_size
                codecs.add(col.compression)
    return {"num_row_groups": groups, "num_rows": rows, "compression": sorted(codecs), "version": version, "compressed_size_bytes": packed, "uncompressed_size_bytes": plain}


def read_parquet(spark: SparkSession, path: str) -> tuple[DataFrame, SourceInfo]:
    first = head(spark, path, 4)
    if first and first != b"PAR1":
        raise ParquetError(f"{path}: not a Parquet file")
    df = spark.read.parquet(path)
    info = SourceInfo(path, "parquet", columns=df.columns)
    try:
        info.details |= parquet_footer(spark, path)
    except (OSError, ValueError, ImportError):  # a store that Spark alone knows
        pass
    return df, info


def read_path(spark: SparkSession, path: str, format: str | None = None, csv_options: CsvOptions | None = None, strict: bool = False) -> tuple[DataFrame, SourceInfo]:
    kind = format or detect_format(path)
    if kind == "csv":
        return read_csv(spark, path, csv_options)
    if kind == "jsonl":
        return read_jsonl(spark, path, strict)
    if kind == "json":
        return read_json(spark, path, strict)
    if kind == "parquet":
        return read_parquet(spark, path)
    raise UnsupportedSource(f"{path}: unknown format")
