"""A sandbox for callers that aren't trusted: files below one folder, no links out of it, no addresses, limits on size, rows and time."""

from __future__ import annotations

import threading
import time
import uuid
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import SparkSession

from gaugeworks.errors import Denied, LimitReached
from gaugeworks.plans.profile import profile
from gaugeworks.plans.report import Report


@dataclass(frozen=True)
class Sandbox:
    root: Path
    max_bytes: int = 256 << 20
    max_rows: int = 1_000_000
    max_seconds: float = 30.0
    allow_links: bool = False

    def resolve(self, name: str) -> Path:
        """The file that a name means, if it may be read."""
        if "://" in name or "\x00" in name:
            raise Denied("addresses aren't let through")
        root = Path(self.root).resolve()
        path = Path(name) if Path(name).is_absolute() else root / name
        if not self.allow_links:
            step = path
            while step not in (root, step.parent):
                if step.is_symlink():
                    raise Denied(f"{name}: a link")
                step = step.parent
        real = path.resolve()
        if real != root and root not in real.parents:
            raise Denied(f"{name}: outside of the sandbox")
        if not real.is_file():
            raise Denied(f"{name}: no such file")
        if real.stat().st_size > self.max_bytes:
            raise LimitReached(f"{name}: over {self.max_bytes} bytes")
        return real


def guarded_profile(spark: SparkSession, sandbox: Sandbox, name: str, **settings) -> Report:
    """A profile within the sandbox's limits. When the time is up, Spark's jobs are cancelled."""
    path = sandbox.resolve(name)
    rows = min(settings.pop("max_rows", None) or sandbox.max_rows, sandbox.max_rows)
    group, over = f"guard-{uuid.uuid4().hex}", threading.Event()
    sc = spark.sparkContext
    sc.setJobGroup(group, f"profile of {path.name}", interruptOnCancel=True)
    deadline = time.monotonic() + sandbox.max_seconds

    def watch() -> None:
        while not over.wait(0.1):
            if time.monotonic() > deadline:
                sc.cancelJobGroup(group)
                over.wait(0.5)

    threading.Thread(target=watch, daemon=True).start()
    try:
        report = profile(spark, f"file://{path}", max_rows=rows, **settings)
    except Exception as e:
        if time.monotonic() > deadline:
            raise LimitReached(f"over {sandbox.max_seconds} seconds") from e
        raise
    finally:
        over.set()
        sc.setLocalProperty("spark.jobGroup.id", None)
    if time.monotonic() > deadline:
        raise LimitReached(f"over {sandbox.max_seconds} seconds")
    return report
