"""What can go wrong, by kind."""

from __future__ import annotations


class GaugeError(Exception):
    """Any error of this package."""


class SourceError(GaugeError):
    """A source that can't be found, read or understood."""


class FormatError(SourceError):
    """A source of another format than it is said to have."""


class MalformedRecords(SourceError):
    """Records that a strict reading refuses, or a source without any good one."""


class SchemaError(GaugeError):
    """Columns that are missing, doubled or of the wrong type."""


class OptionError(GaugeError, ValueError):
    """An option that doesn't exist, doesn't fit, or would have no effect."""


class HintError(OptionError):
    """A hint on an unknown column, or one that no value bears out."""


class UnsafeQuery(GaugeError, ValueError):
    """A query or identifier that isn't passed to a database."""


class Denied(GaugeError, PermissionError):
    """What a sandbox doesn't allow."""


class LimitReached(GaugeError):
    """A size, row or time limit of a sandbox."""


class ReportError(GaugeError, ValueError):
    """A saved report that can't be read."""


class StateError(GaugeError):
    """A stream's saved state that is missing, behind its checkpoint, or can't be written."""


# kinds within the classes above: what exactly went wrong


class MissingFile(SourceError):
    """A path that names nothing."""


class EncodingError(SourceError):
    """Bytes that aren't in the encoding they are read in."""


class CsvError(MalformedRecords):
    """CSV that can't be read, strictly or at all."""


class JsonError(MalformedRecords):
    """A document that isn't JSON, or is cut off."""


class ParquetError(FormatError):
    """A broken Parquet file or footer."""


class ArrowError(SourceError):
    """Columns that Arrow can't hold."""


class UnsupportedSource(SourceError):
    """An object or format that isn't a source of rows."""


class RecoveryFailed(MalformedRecords):
    """A source that no way of reading it could save; ``tried`` tells the ways."""

    def __init__(self, message: str, tried: list[str] | None = None):
        super().__init__(message)
        self.tried = tried or []


class DuplicateColumns(SchemaError):
    """Two columns of one name."""


class ColumnError(GaugeError):
    """A column that can't be judged."""


class MetricError(GaugeError):
    """A statistic that can't be made."""


class QualityIssue(GaugeError):
    """Data that a caller asked to refuse: a score below its limit."""


class SamplingError(OptionError):
    """A sample that can't be drawn as asked."""


class ConfigError(OptionError):
    """Settings that don't fit together or can't be read."""


class StreamError(GaugeError):
    """A stream that broke."""


class EngineError(GaugeError):
    """No way of running a profile worked."""


class DatabaseError(SourceError):
    """A database that can't be reached, asked or trusted."""


class ConnectionFailed(DatabaseError):
    """A database that doesn't answer."""


class QueryFailed(DatabaseError):
    """A query that the database refused."""


class DatabaseConfigError(DatabaseError):
    """An address or setting that no database understands."""


class DriverMissing(DatabaseError):
    """A database whose driver this session lacks."""


class SslError(DatabaseError):
    """A connection that can't be encrypted as asked."""


class RetriesExhausted(DatabaseError):
    """An action that failed each time."""


#: Exit codes of the kinds, for programs; the nearest class in the list counts.
EXIT_CODES: tuple[tuple[type, int], ...] = ((MissingFile, 3), (EncodingError, 5), (DatabaseError, 6), (SourceError, 4), (OptionError, 2), (SchemaError, 7), (Denied, 8), (LimitReached, 8), (QualityIssue, 9), (GaugeError, 1))


def exit_code(error: BaseException) -> int:
    """The exit code of an error's kind; 70 for errors that aren't this package's."""
    return next((code for kind, code in EXIT_CODES if isinstance(error, kind)), 70)
