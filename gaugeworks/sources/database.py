"""Tables and queries of databases through JDBC, and what is let through to them."""

from __future__ import annotations

import os
import random
import re
import sqlite3
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from pathlib import Path
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession

from gaugeworks.errors import ConnectionFailed, DatabaseConfigError, DriverMissing, GaugeError, QueryFailed, RetriesExhausted, SslError, UnsafeQuery
from gaugeworks.operators.sampling import database_sampling
from gaugeworks.sources.files import SourceInfo

MOST_NAME, MOST_QUERY = 128, 10_000
# fixed values: words that no identifier and no query may hold
DENIED = ("DROP", "DELETE", "INSERT", "UPDATE", "ALTER", "CREATE", "TRUNCATE", "EXEC", "EXECUTE", "GRANT", "REVOKE", "MERGE", "CALL", "UNION", "INTO", "OUTFILE", "DUMPFILE", "LOAD_FILE", "XP_CMDSHELL", "SP_EXECUTESQL", "WAITFOR", "BENCHMARK", "SLEEP", "PG_SLEEP", "COPY", "ATTACH", "PRAGMA")
RETRYABLE = ("connection", "timeout", "timed out", "network", "refused", "reset", "broken pipe", "temporarily", "too many connections", "deadlock", "unavailable")
DRIVERS = {"postgresql": "org.postgresql.Driver", "postgres": "org.postgresql.Driver", "mysql": "com.mysql.cj.jdbc.Driver", "sqlite": "org.sqlite.JDBC"}


def _words(sql: str) -> set[str]:
    return set(re.findall(r"[A-Z_][A-Z0-9_]*", sql.upper()))


def check_identifier(name: str) -> str:
    if not name or len(name) > MOST_NAME or not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*){0,2}", name):
        raise UnsafeQuery(f"{name[:40]!r} isn't a table's name")
    if bad := {p.upper() for p in name.split(".")} & set(DENIED):
        raise UnsafeQuery(f"{', '.join(sorted(bad))} isn't let through")
    return name


def check_query(sql: str) -> str:
    """One SELECT without comments, further statements or denied words outside its texts."""
    text = sql.strip()
    if len(text) > MOST_QUERY:
        raise UnsafeQuery(f"a query of over {MOST_QUERY} signs")
    if not re.match(r"(?i)\s*(SELECT|WITH)\b", text):
        raise UnsafeQuery("a query that doesn't begin with SELECT")
    bare = re.sub(r"'(?:[^']|'')*'", "''", text)
    if ";" in bare or "--" in bare or "/*" in bare:
        raise UnsafeQuery("a query with a comment or a second statement")
    if bad := _words(bare) & set(DENIED):
        raise UnsafeQuery(f"{', '.join(sorted(bad))} isn't let through")
    return text


def is_query(text: str) -> bool:
    return bool(re.match(r"(?i)\s*(SELECT|WITH)\b", text))


def select_all(source: str) -> str:
    """The query for a table's name, or a checked query itself."""
    return check_query(source) if is_query(source) else f"SELECT * FROM {check_identifier(source)}"


def count_query(source: str) -> str:
    return f"SELECT COUNT(*) AS n FROM ({check_query(source)}) AS counted" if is_query(source) else f"SELECT COUNT(*) AS n FROM {check_identifier(source)}"


@dataclass(frozen=True)
class Ssl:
    mode: str = "require"
    root_certificate: str | None = None

    def options(self, kind: str) -> dict[str, str]:
        if kind.startswith("postgres"):
            return {"sslmode": self.mode, **({"sslrootcert": self.root_certificate} if self.root_certificate else {})}
        return {"sslMode": {"disable": "DISABLED", "require": "REQUIRED", "verify-ca": "VERIFY_CA", "verify-full": "VERIFY_IDENTITY"}.get(self.mode, "REQUIRED")} if kind == "mysql" else {}


@dataclass(frozen=True)
class Database:
    url: str
    user: str | None = None
    password: str | None = field(default=None, repr=False)
    ssl: Ssl | None = None
    fetch_size: int = 10_000

    @classmethod
    def from_environment(cls, prefix: str = "DB") -> Database:
        get = lambda k: os.environ.get(f"{prefix}_{k}")
        if not get("URL"):
            raise DatabaseConfigError(f"{prefix}_URL isn't set")
        return cls(get("URL"), get("USER"), get("PASSWORD"), Ssl(get("SSL_MODE") or "require", get("SSL_ROOT_CERT")))

    @property
    def kind(self) -> str:
        m = re.match(r"(?:jdbc:)?([a-z]+):", self.url)
        if not m or m[1] not in DRIVERS:
            raise DatabaseConfigError(f"{safe_message(self.url)}: no driver for this database")
        return m[1]

    @property
    def jdbc_url(self) -> str:
        url = self.url if self.url.startswith("jdbc:") else f"jdbc:{self.url}"
        return url.replace("jdbc:postgres:", "jdbc:postgresql:")

    def warnings(self) -> list[str]:
        """What is unsafe about the connection."""
        out = []
        if re.search(r"://[^/@]*:[^/@]*@", self.url):
            out.append("the address holds a password")
        if self.kind != "sqlite" and (self.ssl is None or self.ssl.mode == "disable"):
            out.append("the connection isn't encrypted")
        return out


def safe_message(text: str) -> str:
    """A message without passwords."""
    text = re.sub(r"(://[^:/@\s]*):[^@\s]*@", r"\1:***@", text)
    return re.sub(r"(?i)(password|pwd|secret|token)=[^\s;&]+", r"\1=***", text)


def with_retries(action: Callable, retries: int = 3, first: float = 0.1, most: float = 10.0, factor: float = 2.0, sleep: Callable = time.sleep):
    """The action's result; failures that may pass are tried again after growing pauses."""
    for attempt in range(retries + 1):
        try:
            return action()
        except Exception as e:
            if not any(x in str(e).lower() for x in RETRYABLE):
                raise
            if attempt == retries:
                raise RetriesExhausted(f"{retries + 1} attempts: {safe_message(str(e).splitlines()[0])}") from e
            sleep(min(most, first * factor**attempt) * (0.5 + random.random() / 2))
    raise AssertionError


def _options(database: Database) -> dict[str, str]:
    """The reader's settings for a connection: address, driver, who asks, and how it is encrypted."""
    options = {"url": database.jdbc_url, "driver": DRIVERS[database.kind], "fetchsize": str(database.fetch_size)}
    options |= {k: v for k, v in (("user", database.user), ("password", database.password)) if v}
    return options | (database.ssl.options(database.kind) if database.ssl else {})


def _failed(e: Exception) -> GaugeError:
    """What a database's failure is, without passwords."""
    if isinstance(e, GaugeError):
        return e
    text = safe_message(str(e).splitlines()[0]) if str(e) else type(e).__name__
    low = str(e).lower()
    if "classnotfound" in low or "no suitable driver" in low:
        return DriverMissing(text)
    if "ssl" in low or "certificate" in low:
        return SslError(text)
    return ConnectionFailed(text) if any(x in low for x in RETRYABLE) or "unable to open" in low else QueryFailed(text)


def read_query(spark: SparkSession, database: Database, source: str, partition: tuple[str, int, int, int] | None = None) -> tuple[DataFrame, SourceInfo]:
    """A table or query. ``partition`` names a number column, its bounds and how many tasks read it at once.

    A SQLite file is the driver's own: without its JDBC driver it is read there, ``fetch_size`` rows at a time.
    """
    query = select_all(source)
    info = SourceInfo(safe_message(database.url), database.kind, "query")
    if database.kind == "sqlite" and not _has_driver(spark, database):
        df = _read_sqlite(spark, database, query)
    else:
        options = _options(database)
        if partition:
            column, low, high, tasks = partition
            options |= {"dbtable": f"({query}) AS profiled", "partitionColumn": check_identifier(column), "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(tasks)}
        else:
            options["query"] = query
        try:
            df = with_retries(lambda: spark.read.format("jdbc").options(**options).load())
        except Exception as e:
            raise _failed(e) from None
    info.columns = df.columns
    return df, info


def _has_driver(spark: SparkSession, database: Database) -> bool:
    try:
        spark.sparkContext._jvm.java.lang.Class.forName(DRIVERS[database.kind])
    except Exception:  # noqa: BLE001  the JVM says so by an exception of its own
        return False
    return True


def sqlite_path(url: str) -> str:
    """The file of a SQLite address."""
    path = re.sub(r"^(?:jdbc:)?sqlite:(?://)?", "", url)
    if not path:
        raise DatabaseConfigError("a SQLite address names a file")
    return path


def _sqlite(database: Database, query: str) -> Iterator:
    path = sqlite_path(database.url)
    if not Path(path).is_file():
        raise ConnectionFailed(f"{path}: unable to open the database")
    connection = sqlite3.connect(f"file:{quote(path)}?mode=ro", uri=True)
    try:
        cursor = connection.execute(query)
        yield [c[0] for c in cursor.description]
        while rows := cursor.fetchmany(database.fetch_size):
            yield rows
    except sqlite3.Error as e:
        raise QueryFailed(safe_message(str(e))) from None
    finally:
        connection.close()


def _read_sqlite(spark: SparkSession, database: Database, query: str) -> DataFrame:
    """Values keep SQLite's kinds where a column has one kind only; mixed columns are text."""
    import pyarrow as pa

    parts = _sqlite(database, query)
    names = next(parts)
    rows = [r for part in parts for r in part]
    columns = []
    for k in range(len(names)):
        values = [r[k] for r in rows]
        kinds = {type(v) for v in values if v is not None}
        if kinds == {int, float}:
            values, kinds = [None if v is None else float(v) for v in values], {float}
        kind = {int: pa.int64(), float: pa.float64(), bytes: pa.binary()}.get(next(iter(kinds)), pa.string()) if len(kinds) == 1 else pa.string()
        columns.append(pa.array(values if len(kinds) < 2 else [None if v is None else str(v) for v in values], kind))
    return spark.createDataFrame(pa.Table.from_arrays(columns, names=names))


def _asked(spark: SparkSession, database: Database, query: str) -> DataFrame:
    """A query of this module's own, which needs no check."""
    if database.kind == "sqlite" and not _has_driver(spark, database):
        return _read_sqlite(spark, database, query)
    try:
        return with_retries(lambda: spark.read.format("jdbc").options(**_options(database), query=query).load())
    except Exception as e:
        raise _failed(e) from None


def count_rows(spark: SparkSession, database: Database, source: str) -> int:
    return int(_asked(spark, database, count_query(source)).first()[0])


def table_schema(spark: SparkSession, database: Database, source: str) -> list[tuple[str, str]]:
    """Names and Spark types of a table's or query's columns; at most one row is read."""
    return [(f.name, f.dataType.simpleString()) for f in _asked(spark, database, f"SELECT * FROM ({select_all(source)}) AS shaped LIMIT 1").schema.fields]


@dataclass
class Connector:
    """A database and what can be asked of it."""

    spark: SparkSession
    database: Database

    def test_connection(self) -> bool:
        """Whether the database answers; what is wrong with it is raised by :meth:`connect`."""
        try:
            self.connect()
        except GaugeError:
            return False
        return True

    def connect(self) -> Connector:
        _asked(self.spark, self.database, "SELECT 1 AS one").first()
        return self

    def count(self, source: str) -> int:
        return count_rows(self.spark, self.database, source)

    def schema(self, source: str) -> list[tuple[str, str]]:
        return table_schema(self.spark, self.database, source)

    def read(self, source: str, sample: str | None = None, size: int = 0, key: str | None = None) -> tuple[DataFrame, SourceInfo]:
        """The rows of a table or query, or a sample of them that the database draws."""
        if not sample:
            return read_query(self.spark, self.database, source)
        query = database_sampling(select_all(source), sample, size, self.count(source), key and check_identifier(key))
        df = _asked(self.spark, self.database, query)
        return df.drop("rn"), SourceInfo(safe_message(self.database.url), self.database.kind, "query", [c for c in df.columns if c != "rn"], details={"sample": sample, "size": size})


def connector(spark: SparkSession, url: str, **settings) -> Connector:
    """A connector for an address of PostgreSQL, MySQL or SQLite."""
    database = Database(url, **settings)
    database.kind  # an unknown one is refused here
    return Connector(spark, database)
