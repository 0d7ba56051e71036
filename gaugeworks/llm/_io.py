"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from urllib.parse import urlsplit

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
#: Rows that a file should have, where a bound on a table's rows is known.
ROWS_A_FILE = 50_000
_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; on a one-machine session without it, a new one."""
    sc = spark.sparkContext
    there = sc.getConf().get(_KEY) or spark.conf.get(_KEY, None)
    if not there:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError(f"{_KEY} has to name a folder that driver and executors share")
        there = "file://" + tempfile.mkdtemp(prefix="gaugeworks-")
        spark.conf.set(_KEY, there)
    return there.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path for a new table or folder below :func:`shared_dir`; removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of an address; one without a scheme is local."""
    return fs.FileSystem.from_uri(uri) if urlsplit(uri).scheme else (fs.LocalFileSystem(), uri)


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again.

    Cuts the lineage, so that what is read several times is computed once and a lost executor costs no recomputation.
    ``rows``, a bound on the rows if one is known, keeps a small table that many partitions deal out in few files: without
    Hadoop's native library a local file system starts a process for each file, to set its mode.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // ROWS_A_FILE)))
    df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._written_to = path
    return made


def released(*tables: DataFrame) -> None:
    """Removes tables that :func:`written` made and that nothing reads any more."""
    for df in tables:
        _removed(df.sparkSession, df._written_to)
        _made[:] = [x for x in _made if x[1] != df._written_to]


def _removed(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def clear_written() -> None:
    """Removes the tables written so far."""
    while _made:
        spark, path = _made.pop()
        try:
            _removed(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended before
            return


atexit.register(clear_written)
