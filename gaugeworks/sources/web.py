"""Files behind http and https. The driver fetches them, up to a size; larger data belongs in a store that Spark reads."""

from __future__ import annotations

import io
import urllib.error
import urllib.request
from urllib.parse import urlsplit

from gaugeworks.errors import ParquetError, SourceError
from gaugeworks.sources.files import SourceInfo, detect_format

MOST_BYTES, SECONDS = 1 << 30, 60


def kind_of(url: str) -> str:
    """The format that an address's path says."""
    parts = urlsplit(url)
    if parts.scheme not in ("http", "https"):
        raise SourceError(f"{parts.scheme or url[:20]}: http or https is meant")
    kind = detect_format(parts.path)
    return "csv" if kind == "unknown" else kind


def fetch(url: str, most: int = MOST_BYTES, seconds: float = SECONDS) -> tuple[bytes, str]:
    """The file's bytes and format."""
    kind = kind_of(url)
    with urllib.request.urlopen(url, timeout=seconds) as answer:  # noqa: S310
        raw = answer.read(most + 1)
    if len(raw) > most:
        raise SourceError(f"over {most} bytes")
    return raw, kind


def fetch_range(url: str, start: int, size: int, seconds: float = SECONDS) -> bytes:
    """Some of a file's bytes; a server without ranges gives them all, and the others are dropped."""
    ask = urllib.request.Request(url, headers={"Range": f"bytes={start}-{start + size - 1}"})
    with urllib.request.urlopen(ask, timeout=seconds) as answer:  # noqa: S310
        return answer.read(size) if answer.status == 206 else answer.read()[start : start + size]


def remote_size(url: str, seconds: float = SECONDS) -> int | None:
    """The file's size if the server gives parts of it, by its headers or by what it says of one byte; None if it doesn't."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, method="HEAD"), timeout=seconds) as answer:  # noqa: S310
            if answer.headers.get("Accept-Ranges", "").lower() == "bytes" and answer.headers.get("Content-Length"):
                return int(answer.headers["Content-Length"])
    except urllib.error.HTTPError:
        pass
    with urllib.request.urlopen(urllib.request.Request(url, headers={"Range": "bytes=0-0"}), timeout=seconds) as answer:  # noqa: S310
        whole = answer.headers.get("Content-Range", "").rpartition("/")[2]
        return int(whole) if answer.status == 206 and whole.isdigit() else None


class RangeFile(io.RawIOBase):
    """A remote file that is read by ranges; ``fetched`` counts the bytes."""

    def __init__(self, url: str, size: int):
        super().__init__()
        self.url, self.size, self.at, self.fetched = url, size, 0, 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = 0) -> int:
        self.at = (0, self.at, self.size)[whence] + offset
        return self.at

    def readinto(self, into) -> int:
        size = min(len(into), self.size - self.at)
        if size <= 0:
            return 0
        part = fetch_range(self.url, self.at, size)
        into[: len(part)] = part
        self.at += len(part)
        self.fetched += len(part)
        return len(part)


def parquet_columns(url: str, columns: list[str] | None = None):
    """A remote Parquet file's columns as an Arrow table, and where they come from: the footer and these columns are fetched, if the server gives parts."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    size = remote_size(url)
    if size is None:
        raw, _ = fetch(url)
        source: io.IOBase = io.BytesIO(raw)
        size = len(raw)
    else:
        source = RangeFile(url, size)
    try:
        file = pq.ParquetFile(source)
        table = file.read(columns=columns)
    except pa.ArrowInvalid as e:
        raise ParquetError(f"{url}: {e}") from None
    details = {"num_row_groups": file.metadata.num_row_groups, "num_rows": file.metadata.num_rows, "size": size, "bytes_fetched": getattr(source, "fetched", size)}
    return table, SourceInfo(url, "parquet", "url", table.column_names, details=details)
