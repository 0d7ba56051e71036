"""How much a stream takes at once, and how much memory it may use."""

from __future__ import annotations

import os
import threading
from collections.abc import Callable
from dataclasses import dataclass

#: Bytes of a chunk at least, the share of free memory that one takes, and the size from which files get half of it.
LEAST_BYTES, FREE_SHARE, LARGE_SOURCE = 64 << 20, 0.1, 10_000 << 20


def free_memory() -> int:
    """Bytes that this machine can still give."""
    with open("/proc/meminfo", encoding="ascii") as f:
        found = dict(line.split(":", 1) for line in f)
    return int(found["MemAvailable"].split()[0]) << 10


def resident_memory(pid: int | str = "self") -> int:
    """Bytes of memory that a process holds."""
    with open(f"/proc/{pid}/statm", encoding="ascii") as f:
        return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE")


@dataclass(frozen=True)
class ChunkSize:
    """Bytes that are read at once: a fixed number, a function of the source's size, or by the free memory."""

    fixed: int | None = None
    custom: Callable[[int], int] | None = None

    def of(self, source_bytes: int, free: int | None = None) -> int:
        if self.fixed is not None:
            return self.fixed
        if self.custom is not None:
            return self.custom(source_bytes)
        size = max(LEAST_BYTES, int((free_memory() if free is None else free) * FREE_SHARE))
        return size // 2 if source_bytes > LARGE_SOURCE else size

    def options(self, source_bytes: int) -> dict[str, str]:
        """The options of a streaming file source for chunks of this size."""
        return {"maxBytesPerTrigger": str(self.of(source_bytes))}


class MemorySampler:
    """The most memory that this process held while the sampler ran: ``with MemorySampler() as m: ...; m.peak``."""

    def __init__(self, seconds: float = 0.05):
        self.seconds, self.first, self.peak = seconds, 0, 0
        self._over = threading.Event()

    def __enter__(self) -> MemorySampler:
        self.first = self.peak = resident_memory()
        self._thread = threading.Thread(target=self._run, daemon=True)
        self._thread.start()
        return self

    def _run(self) -> None:
        while not self._over.wait(self.seconds):
            self.peak = max(self.peak, resident_memory())

    def __exit__(self, *_) -> None:
        self._over.set()
        self._thread.join()
        self.last = resident_memory()
        self.peak = max(self.peak, self.last)

    @property
    def grown(self) -> int:
        """Bytes that are held now and weren't at the start: what leaked, if the work is done."""
        return max(0, self.last - self.first)
