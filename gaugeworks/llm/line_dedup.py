"""Line dedup: lines that many documents hold stay in one of them.

Lines are hashed; the hashes are range-partitioned with a secondary sort by document and position, and each partition is
streamed: the first document of a hash is its keeper, the lines of the others are dropped once enough documents were
seen. The ranges cut by (hash, document), so that a line that a third of all documents hold is dealt over many
partitions; what a cut leaves undecided, at most two hashes a partition, is settled from the partitions' counts. What
comes back for each document is a compressed bitmap of kept lines, no text.

A line's key is the line without ASCII white space at its ends, A-Z in lower case. Keys of fewer than ``min_chars`` code
points never go. The keeper is the largest id; all lines of the key stay there. Null and empty texts are one empty line.
Null ids count as one document, smaller than all others. Rows that repeat an id are parts of one document; each has its
own bitmap. Bitmaps are zlib-compressed, the first line in the highest bit.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from gaugeworks.llm._io import written
from gaugeworks.llm._rows import batches_with, fresh, text_column

_SPACE = " \t\n\x0b\x0c\r"


def _row_hash(text: str) -> int:
    """As Spark's ``xxhash64``."""
    h = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), 42)
    return h - (1 << 64) if h >> 63 else h


def line_hashes(docs: DataFrame, id_col: str, text: str, min_chars: int) -> DataFrame:
    """hash, more (96 bits together), id, row (hash of the text) and line of each line whose key is long enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_with(batches):
            high, low, ids, rows, places = [], [], [], [], []
            for i, x in zip(batch.column(id_col).to_pylist(), text_column(batch, text), strict=True):
                own = _row_hash(x or "")
                for k, line in enumerate((x or "").split("\n")):
                    if len(line) >= min_chars and len(key := line.strip(_SPACE)) >= min_chars:
                        h = xxhash.xxh3_128_intdigest(key.encode("utf-8", "surrogatepass").lower())
                        high.append((h >> 64) - (1 << 63))
                        low.append((h & 0xFFFFFFFF) - (1 << 31))
                        ids.append(i)
                        rows.append(own)
                        places.append(k)
            if ids:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(high, pa.int64()), pa.array(low, pa.int32()), pa.array(ids, batch.column(id_col).type), pa.array(rows, pa.int64()), pa.array(places, pa.int32())],
                    names=["hash", "more", "id", "row", "line"],
                )

    schema = T.StructType([T.StructField("hash", T.LongType()), T.StructField("more", T.IntegerType()), T.StructField("id", docs.schema[id_col].dataType), T.StructField("row", T.LongType()), T.StructField("line", T.IntegerType())])
    return docs.select(id_col, text).mapInArrow(run, schema)


def _stream(least: int, id_type: pa.DataType):
    """Decides on the lines of one sorted partition.

    Out come lines to drop (state 0), undecided lines of a hash that began in an earlier partition (1), and the first
    lines of one that may go on in a later partition (2), each first line of a document there with ``n`` = 1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = doc = None
        opening, seen = True, 0  # opening: the partition's first hash, which may have begun before
        held: list[tuple] = []  # lines of the current hash that aren't decided: of fewer than `least` documents
        keeper: object = None

        for batch in batches:
            out: list[tuple] = []
            columns = [batch.column(c).to_pylist() for c in ("hash", "more", "id", "row", "line")]
            for h, m, i, row, line in zip(*columns, strict=True):
                if (h, m) != key:
                    opening = key is None
                    key, doc, seen, held, keeper = (h, m), (), 0, [], i
                new = (i,) != doc
                if new:
                    doc, seen = (i,), seen + 1
                if opening:
                    out.append((h, m, i, row, line, 1, int(new)))
                elif seen >= least:
                    for x in held:
                        if x[2] != keeper:
                            out.append((*x, 0, 0))
                    held = []
                    out.append((h, m, i, row, line, 0, 0))
                else:
                    held.append((h, m, i, row, line))
            if out:
                yield _batch(out, id_type)
        if key is not None and not opening:
            # fewer than `least` documents so far: the next partition may have more; else the keeper alone has to be told
            first = [((*x, 2, int(k == 0 or held[k - 1][2] != x[2]))) for k, x in enumerate(held)] or [(*key, keeper, 0, -1, 2, seen)]
            yield _batch(first, id_type)

    return run


def _batch(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), id_type, pa.int64(), pa.int32(), pa.int8(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["hash", "more", "id", "row", "line", "state", "n"])


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_docs: int = 5, min_chars: int = 40) -> DataFrame:
    """id, row, line of each line that goes."""
    lines = written(line_hashes(docs, id_col, text, min_chars), "line-hashes")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lines.repartitionByRange(parts, F.col("hash"), F.col("more"), F.col("id").desc_nulls_last()).sortWithinPartitions(F.col("hash"), F.col("more"), F.col("id").desc_nulls_last(), F.col("line"))
    schema = T.StructType([*lines.schema.fields, T.StructField("state", T.ByteType()), T.StructField("n", T.LongType())])
    decided = dealt.mapInArrow(_stream(min_docs, to_arrow_type(docs.schema[id_col].dataType)), schema)
    decided = written(decided, "lines")
    # at most two hashes a partition are open, so their sums can be broadcast
    open_rows = decided.where("state > 0")
    sums = open_rows.groupBy("hash", "more").agg(F.sum("n").alias("docs"), F.max("id").alias("keeper")).where(F.col("docs") >= min_docs)
    late = open_rows.where("line >= 0").join(F.broadcast(sums), ["hash", "more"]).where(~F.col("id").eqNullSafe(F.col("keeper")))
    return decided.where("state = 0").select("id", "row", "line").unionByName(late.select("id", "row", "line"))


def _marked(docs: DataFrame, id_col: str, text: str, min_docs: int, min_chars: int) -> tuple[DataFrame, str]:
    """``docs`` with the numbers of the lines that go, or null, and that column's name."""
    dropped, row, by_id, by_row = (fresh(docs.columns, n) for n in ("_dropped", "_own_row", "_line_id", "_line_row"))
    lines = dropped_lines(docs, id_col, text, min_docs, min_chars).groupBy(F.col("id").alias(by_id), F.col("row").alias(by_row)).agg(F.collect_set("line").alias(dropped))
    hashed = docs.withColumn(row, F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    return hashed.join(lines, F.col(id_col).eqNullSafe(F.col(by_id)) & (F.col(row) == F.col(by_row)), "left").drop(by_id, by_row, row), dropped


def _kept(text: str | None, dropped: list[int] | None) -> tuple[np.ndarray, str]:
    lines = (text or "").split("\n")
    keep = np.ones(len(lines), bool)
    if not dropped:
        return keep, text or ""
    keep[dropped] = False
    return keep, "\n".join([line for line, k in zip(lines, keep.tolist(), strict=True) if k])


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_docs: int = 5, min_chars: int = 40) -> DataFrame:
    """For each row: id, n_lines, n_dropped, keep (bitmap) and kept_sha256, the digest of the kept lines."""
    marked, dropped = _marked(docs.select(id_col, text), id_col, text, min_docs, min_chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_with(batches):
            made = [_kept(x, d) for x, d in zip(text_column(batch, text), batch.column(dropped).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(id_col),
                    pa.array([len(k) for k, _ in made], pa.int64()),
                    pa.array([int(len(k) - k.sum()) for k, _ in made], pa.int64()),
                    pa.array([zlib.compress(np.packbits(k).tobytes()) for k, _ in made], pa.binary()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for _, x in made], pa.string()),
                ],
                names=[id_col, "n_lines", "n_dropped", "keep", "kept_sha256"],
            )

    fields = [docs.schema[id_col], T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("keep", T.BinaryType()), T.StructField("kept_sha256", T.StringType())]
    return marked.mapInArrow(run, T.StructType(fields))


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", chars: str | None = "n_chars", min_docs: int = 5, min_chars: int = 40) -> DataFrame:
    """``docs`` with the dropped lines gone from ``text`` and ``chars``, if there is such a column, counted anew. Null texts stay null."""
    marked, dropped = _marked(docs, id_col, text, min_docs, min_chars)

    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_with(batches):
            texts = [x if d is None else _kept(x, d)[1] for x, d in zip(text_column(batch, text), batch.column(dropped).to_pylist(), strict=True)]
            new = {text: pa.array(texts, batch.schema.field(text).type)}
            if chars in columns:
                counts = [c if d is None else len(x) for x, c, d in zip(texts, batch.column(chars).to_pylist(), batch.column(dropped).to_pylist(), strict=True)]
                new[chars] = pa.array(counts, batch.schema.field(chars).type)
            yield pa.RecordBatch.from_arrays([new.get(c, batch.column(c)) for c in columns], names=columns)

    return marked.mapInArrow(run, docs.schema)
