"""WARC records in ZIP-packaged archives: a writer, and a reader that takes records by range.

An archive is a ZIP file with stored members: ``archive/data.warc.gz``, one gzip member for each record, and
``indexes/index.cdxj``, one line for each record with its offset and length there. The reader parses the end record, the
ZIP64 end record where there is one and the central directory, finds where the stored members begin, reads the index, and
then reads each record's own bytes; nothing is extracted. The records are dealt to tasks by stretches of ``READ_BYTES``, as many
tasks as the bytes to be read call for, so that one archive is read by many.

Payloads are UTF-8. A payload of ``MIN_REVISIT`` bytes or more that several pages have is stored once, by the page with the
smallest id; the others' records are revisits without a payload. Null payloads are empty. Rows with null ids come after all
others; rows that repeat id and payload are written alike. Line breaks in addresses become blanks, null addresses are empty.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm._io import file_system, new_path, written
from gaugeworks.llm._joins import split_join
from gaugeworks.llm._rows import batches_with

MIN_REVISIT = 100
#: Bytes from which a task begins another archive; bytes of an archive that are read together, and by one task about; bytes
#: of an index that are held at once.
ARCHIVE_BYTES, READ_BYTES, TASK_BYTES, INDEX_BYTES = 1 << 30, 1 << 20, 64 << 20, 4 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
_DATE = "2024-01-01T00:00:00Z"


# writing


def record_id(page: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}:{digest}')}>"


def warc_record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page, digest)}",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http;msgtype=response",
    ]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
        block += b"\r\n"
    else:
        block += f"Content-Length: {len(payload)}\r\n\r\n".encode() + payload
    head += [f"X-Payload-Length: {len(payload)}", *([] if page is None else [f"X-Page: {page}"]), f"Content-Length: {len(block)}"]
    return "\r\n".join([*head, "", ""]).encode() + block + b"\r\n\r\n"


class ArchiveWriter:
    """Writes records to one archive, its index at the end."""

    def __init__(self, uri: str):
        system, path = file_system(uri)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        self.uri, self.out = uri, system.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self.at, self.lines = 0, []

    def add(self, page: int | None, url: str | None, record: bytes) -> None:
        packed = gzip.compress(record, 1, mtime=0)
        self.data.write(packed)
        self.lines.append(json.dumps({"url": url, "page": page, "offset": self.at, "length": len(packed)}))
        self.at += len(packed)

    def close(self) -> None:
        self.data.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "".join(x + "\n" for x in self.lines))
        self.zip.close()
        self.out.close()


def write_archives(pages: DataFrame, id_col: str = "page_id", url: str = "url", payload: str = "html", folder: str | None = None) -> DataFrame:
    """Writes archives below ``folder`` (a new one in the shared folder if none is named) and returns their paths and record counts.

    Every attempt of a task writes files of its own; the table of paths has those of the attempts that counted.
    """
    folder = folder or new_path(pages.sparkSession, "archives")
    html = F.coalesce(F.col(payload), F.lit(""))
    digest = F.sha2(html, 256)
    each = written(pages.where(F.octet_length(html) >= MIN_REVISIT).select(F.col(id_col).alias("page"), digest.alias("digest")), "digests")
    first = each.groupBy("digest").agg(F.min("page").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    # only ids and digests meet by digest, those of pages with very many copies where they are; the payloads are dealt by page
    again = split_join(each, first, ["digest"]).where(~F.col("page").eqNullSafe(F.col("first"))).select(F.col("page").alias("_page"), F.col("digest").alias("_digest"), "first").distinct()
    rows = pages.select(F.col(id_col).alias("page"), F.col(url).alias("url"), html.alias("html"), digest.alias("digest"))
    marked = rows.join(again, F.col("page").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest")), "left")
    ready = marked.select("page", "url", "html", "digest", "first", F.col("_digest").isNotNull().alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths, counts, writer = [], [], None
        for batch in batches_with(batches):
            for r in batch.to_pylist():
                if writer is None or writer.at >= ARCHIVE_BYTES:
                    if writer:
                        writer.close()
                    writer = ArchiveWriter(f"{folder}/{uuid.uuid4().hex}.wacz")
                    paths.append(writer.uri)
                    counts.append(0)
                writer.add(r["page"], r["url"], warc_record(r["page"], r["url"], r["html"].encode(), r["digest"], r["first"], r["revisit"]))
                counts[-1] += 1
        if writer:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(counts, pa.int64())], names=["path", "n_records"])

    return written(ready.mapInArrow(run, "path string, n_records long"), "manifest")


# reading


def _read(f: pa.NativeFile, at: int, size: int) -> bytes:
    f.seek(at)
    return f.read(size)


def members(f: pa.NativeFile) -> dict[str, tuple[int, int]]:
    """Where the stored members of a ZIP file begin, and their sizes. Compressed members are left out."""
    size = f.size()
    tail_at = max(0, size - 65_557)
    tail = _read(f, tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory: not a ZIP file")
    entries, length, start = struct.unpack_from("<HII", tail, end + 10)
    if end >= 20 and tail[end - 20 : end - 16] == b"PK\x06\x07":
        at = struct.unpack_from("<Q", tail, end - 12)[0]
        far = _read(f, at, 56)
        if far[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory where its locator says")
        entries, length, start = struct.unpack_from("<QQQ", far, 32)
    directory, out, at = _read(f, start, length), {}, 0
    for _ in range(entries):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method, packed, plain, name, extra, comment = struct.unpack_from("<H8xIIHHH", directory, at + 10)
        offset = struct.unpack_from("<I", directory, at + 42)[0]
        title = directory[at + 46 : at + 46 + name].decode("utf-8", "replace")
        more, k = directory[at + 46 + name : at + 46 + name + extra], 0
        while k + 4 <= len(more):
            kind, n = struct.unpack_from("<HH", more, k)
            if kind == 1:  # ZIP64: those of the three that don't fit, in this order
                wide = iter(struct.unpack_from(f"<{n // 8}Q", more, k + 4))
                plain = next(wide) if plain == 0xFFFFFFFF else plain
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                offset = next(wide) if offset == 0xFFFFFFFF else offset
            k += 4 + n
        if method == 0:
            local = _read(f, offset, 30)
            if local[:4] != b"PK\x03\x04":
                raise ValueError(f"{title}: no member where the directory says")
            own_name, own_extra = struct.unpack_from("<HH", local, 26)
            out[title] = offset + 30 + own_name + own_extra, packed
        at += 46 + name + extra + comment
    return out


def index_lines(f: pa.NativeFile, at: int, size: int) -> Iterator[list[bytes]]:
    """The lines of an index member, block by block."""
    rest, end = b"", at + size
    while at < end:
        block = _read(f, at, min(INDEX_BYTES, end - at))
        if not block:
            raise ValueError("an index ends before its size")
        at += len(block)
        *lines, rest = (rest + block).split(b"\n")
        yield [x for x in lines if x.strip()]
    if rest.strip():
        yield [rest]


def record_places(manifest: DataFrame) -> DataFrame:
    """path, at (in the file) and size of each record of the archives in ``path``, from their indexes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                system, name = file_system(path)
                with system.open_input_file(name) as f:
                    found = members(f)
                    (data, _), (index, size) = found[DATA], found[INDEX]
                    for lines in index_lines(f, index, size):
                        some = [json.loads(x) for x in lines]
                        yield pa.RecordBatch.from_arrays([pa.array([path] * len(some)), pa.array([data + x["offset"] for x in some], pa.int64()), pa.array([x["length"] for x in some], pa.int64())], names=["path", "at", "size"])

    return manifest.select("path").mapInArrow(run, "path string, at long, size long")


def parse_record(raw: bytes) -> dict:
    """The fields of a WARC record, and the payload of a response."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8").split("\r\n")
    if not version.startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2] if fields["WARC-Type"] == "response" else None
    return {"fields": fields, "payload": payload}


def read_records(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """One row for each record of the archives: page, url, payload_bytes, payload_digest, record_type, refers_to, and the payload if asked for.

    Size and digest of a response are those of the bytes read; a digest that differs from the record's own is an error.
    """
    places = written(record_places(manifest), "places")
    # as many tasks as the bytes to be read call for: the places themselves are few bytes, by which Spark would join all tasks
    pieces, total = places.groupBy("path", F.floor(F.col("at") / READ_BYTES).alias("k")).agg(F.sum("size").alias("n")).agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    tasks = max(1, min(pieces, max(places.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_BYTES))))
    near = places.repartition(tasks, "path", F.floor(F.col("at") / READ_BYTES)).sortWithinPartitions("path", "at")
    schema = "page long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()][: 6 + with_payload]
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, f = None, None
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = []
                for r in batch.slice(at, 512).to_pylist():
                    if r["path"] != path:
                        if f:
                            f.close()
                        path = r["path"]
                        system, name = file_system(path)
                        f = system.open_input_file(name)
                    found = parse_record(gzip.decompress(_read(f, r["at"], r["size"])))
                    fields, payload = found["fields"], found["payload"]
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                    size = int(fields["X-Payload-Length"])
                    if payload is not None and ((own := hashlib.sha256(payload).hexdigest()) != digest or len(payload) != size):
                        raise ValueError(f"{path}: a payload of digest {own} where {digest} was written")
                    page, to = fields.get("X-Page"), fields.get("X-Refers-To-Page")
                    rows.append((page and int(page), fields["WARC-Target-URI"], size, digest, fields["WARC-Type"], to and int(to), payload)[: len(names)])
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)
        if f:
            f.close()

    return near.mapInArrow(run, schema)
