"""Files that are written to be read again: in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession

from gaugeworks.errors import SourceError

_KEY = "spark.checkpoint.dir"
_made: list[tuple[SparkSession, str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the folder that ``spark.checkpoint.dir`` names, or of this machine for a session of one; removed when the driver ends."""
    sc = spark.sparkContext
    base = sc.getConf().get(_KEY) or spark.conf.get(_KEY, None)
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise SourceError(f"{_KEY} has to name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="gaugeworks-")
        spark.conf.set(_KEY, base)
    path = f"{base.rstrip('/')}/{uuid.uuid4().hex}-{name}"
    _made.append((spark, path))
    return path


def put(spark: SparkSession, name: str, raw: bytes) -> str:
    """A file of these bytes; its path."""
    path = scratch_path(spark, name)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(raw))
    finally:
        out.close()
    return path


def clear() -> None:
    while _made:
        spark, path = _made.pop()
        try:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the session may have ended before
            return


atexit.register(clear)
