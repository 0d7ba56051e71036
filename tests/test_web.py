"""Files behind http: a server of this machine, with and without ranges."""

from __future__ import annotations

import asyncio
import http.server
import re
import threading

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from gaugeworks import errors
from gaugeworks.plans import aio
from gaugeworks.sources import web


@pytest.fixture(scope="module")
def served(tmp_path_factory):
    folder = tmp_path_factory.mktemp("web")
    n = 20_000
    pq.write_table(pa.table({"key": range(n), "name": [f"name {k} {'x' * 50}" for k in range(n)]}), folder / "a.parquet", row_group_size=5000, compression="none")
    (folder / "a.csv").write_text("key,name\n1,x\n2,y,z\n")
    (folder / "broken.parquet").write_bytes(b"PAR1 no more")

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_HEAD(self):
            self.do_GET(body=False)

        def do_GET(self, body=True):
            ranges, name = not self.path.startswith("/whole/"), self.path.rpartition("/")[2]
            raw = (folder / name).read_bytes()
            asked = re.fullmatch(r"bytes=(\d+)-(\d+)", self.headers.get("Range", "")) if ranges else None
            part = raw[int(asked[1]) : int(asked[2]) + 1] if asked else raw
            self.send_response(206 if asked else 200)
            if ranges:
                self.send_header("Accept-Ranges", "bytes")
            if asked:
                self.send_header("Content-Range", f"bytes {asked[1]}-{asked[2]}/{len(raw)}")
            self.send_header("Content-Length", str(len(part)))
            self.end_headers()
            if body:
                self.wfile.write(part)

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_remote_parquet_by_range(spark, served):
    report = asyncio.run(aio.profile_url(spark, f"{served}/a.parquet", columns=["key"], packs=("schema", "statistics")))
    assert report.execution.rows_processed == 20_000 and [c.name for c in report.columns] == ["key"] and report["key"].stats["max"] == 19_999
    assert report.source["kind"] == "url" and report.source["bytes_fetched"] < report.source["size"] / 2 and report.source["num_row_groups"] == 4
    whole, info = web.parquet_columns(f"{served}/whole/a.parquet")
    assert whole.num_rows == 20_000 and info.details["bytes_fetched"] == info.details["size"]
    with pytest.raises(errors.ParquetError):
        web.parquet_columns(f"{served}/broken.parquet")


def test_remote_csv(spark, served):
    report = asyncio.run(aio.profile_url(spark, f"{served}/a.csv", packs=("schema",)))
    assert report.execution.rows_processed == 2 and report.execution.ragged_row_count == 1 and report.source["identifier"].endswith("/a.csv")
    with pytest.raises(errors.SourceError):
        web.kind_of("ftp://h/a.csv")
