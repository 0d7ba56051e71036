"""What callers give, judged before any job runs: each check raises an :class:`OptionError` or :class:`SourceError` that tells what would do."""

from __future__ import annotations

import difflib
import os
from pathlib import Path

from gaugeworks.errors import ConfigError, DatabaseConfigError, MissingFile, OptionError, SamplingError, SourceError, UnsupportedSource, exit_code
from gaugeworks.sources.database import Database
from gaugeworks.sources.files import FORMATS

#: Bytes of a chunk, rows of a sample, bytes of a file from which a warning is given.
LEAST_CHUNK, MOST_CHUNK, MOST_SAMPLE, LARGE_FILE = 1024, 1 << 30, 100_000_000, 10 << 30


def file_input(name: str) -> list[str]:
    """Warnings on a local file that can be read as a source; anything else is an error."""
    path = Path(name)
    if not path.exists():
        near = difflib.get_close_matches(path.name, [p.name for p in path.parent.iterdir()] if path.parent.is_dir() else [], 3)
        raise MissingFile(f"{name}: no such file" + (f"; perhaps {', '.join(near)}" if near else ""))
    if path.is_dir():
        raise SourceError(f"{name}: a folder; name a file, or a pattern of files")
    ending = path.suffix.lower().lstrip(".")
    if ending and ending not in FORMATS:
        raise UnsupportedSource(f"{name}: of .{', .'.join(FORMATS)} none")
    if not os.access(path, os.R_OK):
        raise SourceError(f"{name}: not readable")
    size = path.stat().st_size
    if not size:
        raise SourceError(f"{name}: empty")
    return [f"{name}: over {LARGE_FILE >> 30} GiB; a sample is faster"] if size > LARGE_FILE else []


def config_file(name: str) -> None:
    if not Path(name).exists():
        raise MissingFile(f"{name}: no such file")
    if Path(name).suffix != ".toml":
        raise ConfigError(f"{name}: settings are read from a .toml file")


def chunk_size(size: int) -> None:
    if not LEAST_CHUNK <= size <= MOST_CHUNK:
        raise OptionError(f"chunks of {size} bytes: {LEAST_CHUNK} to {MOST_CHUNK} are meant")


def sample_size(rows: int) -> None:
    if not 1 <= rows <= MOST_SAMPLE:
        raise SamplingError(f"a sample of {rows} rows: 1 to {MOST_SAMPLE} are meant")


def database_address(url: str) -> None:
    if "://" not in url and not url.startswith(("sqlite:", "jdbc:sqlite:")):
        raise DatabaseConfigError("an address begins with a database's name and ://")
    Database(url).kind


def glob_pattern(pattern: str) -> None:
    if not pattern.strip():
        raise OptionError("an empty pattern")
    if pattern.count("[") != pattern.count("]") or pattern.count("{") != pattern.count("}"):
        raise OptionError(f"{pattern}: brackets that don't close")


def checked(check, *given) -> tuple[int, str | None]:
    """The exit code of a check, 0 if it passes, and what it says."""
    try:
        check(*given)
    except Exception as e:
        return exit_code(e), str(e)
    return 0, None
