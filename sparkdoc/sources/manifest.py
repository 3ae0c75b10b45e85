"""Versioned manifests: JSON snapshots that name the segments of a store, created one after another and never changed."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace

from sparkdoc.sources.objects import ObjectStore


@dataclass(frozen=True)
class Segment:
    id: str
    path: str
    min_key: str = ""
    max_key: str = ""
    min_seq: int = 0
    max_seq: int = 0
    size: int = 0
    rows: int = 0


@dataclass(frozen=True)
class SortedRun:
    level: int
    sstables: tuple[Segment, ...]


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    writer_epoch: int = 0
    compactor_epoch: int = 0
    wal_id_next: int = 1
    last_seq_num: int = 0
    l0: tuple[Segment, ...] = ()
    sorted_runs: tuple[SortedRun, ...] = ()
    last_batch: int = field(default=-1)

    def segments(self) -> list[Segment]:
        """Newest first: level 0, then the runs."""
        return [*self.l0, *(s for run in self.sorted_runs for s in run.sstables)]

    def next(self, **changes) -> Manifest:
        return replace(self, version=self.version + 1, **changes)

    def to_json(self) -> bytes:
        return json.dumps(asdict(self), sort_keys=True).encode()

    @staticmethod
    def from_json(data: bytes) -> Manifest:
        raw = json.loads(data)
        segment = lambda s: Segment(**s)
        raw["l0"] = tuple(map(segment, raw.get("l0") or ()))
        raw["sorted_runs"] = tuple(SortedRun(r["level"], tuple(map(segment, r["sstables"]))) for r in raw.get("sorted_runs") or ())
        known = {k: v for k, v in raw.items() if k in Manifest.__dataclass_fields__}
        m = Manifest(**known)
        if not m.last_seq_num:  # older manifests lack it
            m = replace(m, last_seq_num=max((s.max_seq for s in m.segments()), default=0))
        return m


class ManifestStore:
    def __init__(self, objects: ObjectStore, prefix: str = "manifest") -> None:
        self.objects, self.prefix = objects, prefix

    def _key(self, version: int) -> str:
        return f"{self.prefix}/{version:020d}.manifest"

    def save(self, manifest: Manifest) -> None:
        """Create this version, or raise ``PreconditionError`` if someone else did."""
        self.objects.put(self._key(manifest.version), manifest.to_json(), if_none_match=True)

    def load(self, version: int) -> Manifest:
        return Manifest.from_json(self.objects.get(self._key(version)))

    def versions(self) -> list[int]:
        names = (k.rpartition("/")[2] for k in self.objects.list(self.prefix + "/"))
        return sorted(int(n.removesuffix(".manifest")) for n in names if n.endswith(".manifest"))

    def latest(self) -> Manifest | None:
        found = self.versions()
        return self.load(found[-1]) if found else None
