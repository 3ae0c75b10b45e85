"""Byte-bounded caches of segments in memory and on executors' disks, least recently used first out.

What is kept is a persisted DataFrame: Spark holds its blocks on the executors, so nothing passes
through the driver and a lost block is read again from the segment.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame

MEMORY_BYTES = 256 << 20
DISK_BYTES = 1 << 30


class SegmentCache:
    def __init__(self, max_bytes: int = MEMORY_BYTES, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> None:
        self.max_bytes, self.level = max_bytes, level
        self._held: OrderedDict[str, tuple[DataFrame, int]] = OrderedDict()

    @staticmethod
    def on_disk(max_bytes: int = DISK_BYTES) -> SegmentCache:
        return SegmentCache(max_bytes, StorageLevel.DISK_ONLY)

    def get(self, path: str) -> DataFrame | None:
        if path not in self._held:
            return None
        self._held.move_to_end(path)
        return self._held[path][0]

    def put(self, path: str, df: DataFrame, size: int) -> DataFrame:
        """Persist ``df`` as the segment at ``path`` of ``size`` bytes; one larger than the cache isn't kept."""
        self.remove(path)
        if size > self.max_bytes:
            return df
        while self._held and self.size + size > self.max_bytes:
            self.remove(next(iter(self._held)))
        self._held[path] = (df.persist(self.level), size)
        return df

    def load(self, path: str, size: int, read: Callable[[], DataFrame]) -> DataFrame:
        found = self.get(path)
        return self.put(path, read(), size) if found is None else found

    def remove(self, path: str) -> None:
        if path in self._held:
            self._held.pop(path)[0].unpersist()

    def clear(self) -> None:
        for path in list(self._held):
            self.remove(path)

    def __contains__(self, path: str) -> bool:
        return path in self._held

    def __len__(self) -> int:
        return len(self._held)

    @property
    def size(self) -> int:
        return sum(n for _, n in self._held.values())
