"""What this installation can do. Nothing is imported or run to find out."""

from __future__ import annotations

import importlib.util
from dataclasses import dataclass

from pyspark.sql import SparkSession

from gaugeworks.sources.database import DRIVERS
from gaugeworks.sources.files import FORMATS

VERSION = "0.2.0"
DATABASES = ("postgres", "mysql", "sqlite")


def _installed(module: str) -> bool:
    try:
        return importlib.util.find_spec(module) is not None
    except (ImportError, ValueError):
        return False


@dataclass(frozen=True)
class Capabilities:
    version: str
    formats: tuple[str, ...]
    pandas_installed: bool
    polars_installed: bool
    pyarrow_installed: bool
    #: Any object with ``__arrow_c_stream__`` is a source, of polars too.
    arrow_interop: bool
    streaming: bool
    url_profiling: bool
    remote_parquet: bool
    database: bool
    #: Those that answer without a further driver, or whose driver the session has.
    database_connectors: tuple[str, ...]


def capabilities(spark: SparkSession | None = None) -> Capabilities:
    """With a session, its JDBC drivers are looked for as well; SQLite needs none."""
    found = {"sqlite"}
    if spark is not None:
        for name in DATABASES:
            try:
                spark.sparkContext._jvm.java.lang.Class.forName(DRIVERS[name])
                found.add(name)
            except Exception:  # noqa: BLE001  the JVM says so by an exception of its own
                continue
    arrow = _installed("pyarrow")
    return Capabilities(
        version=VERSION, formats=tuple(sorted({*FORMATS.values()})), pandas_installed=_installed("pandas"), polars_installed=_installed("polars"), pyarrow_installed=arrow, arrow_interop=arrow,
        streaming=True, url_profiling=True, remote_parquet=arrow, database=True, database_connectors=tuple(n for n in DATABASES if n in found),
    )
