"""A key/value store over Parquet segments and manifests: buffered puts, atomic flushes, fenced writers, compaction.

Writes go to a buffer on the driver and become one sorted segment at a flush; DataFrames become segments
at once. A manifest names the segments of a snapshot; committing means creating the next one, which only
one writer can. ``close`` doesn't flush: what isn't flushed is lost.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkdoc.operators import entries as E
from sparkdoc.sources.cache import SegmentCache
from sparkdoc.sources.manifest import Manifest, ManifestStore, Segment, SortedRun
from sparkdoc.sources.objects import HadoopStore, ObjectStore, PreconditionError

MAX_BUFFER_BYTES = 64 << 20
ENTRY_OVERHEAD = 128
COMPACTION_THRESHOLD = 4
COMPACTION_SECONDS = 30.0
COMMIT_ATTEMPTS = 5
#: Rows of a compacted segment's range partition.
PARTITION_ROWS = 4_000_000


class StaleWriterError(RuntimeError):
    """Another writer has opened the store since."""


class ClosedError(RuntimeError):
    """The store or table is closed."""


class ConflictError(RuntimeError):
    """Every attempt to commit met another's commit."""


@dataclass(frozen=True)
class Entry:
    key: str
    seq: int
    value: object

    @property
    def deleted(self) -> bool:
        return self.value is None


@dataclass(frozen=True)
class Page:
    entries: list[Entry]
    has_more: bool


class Store:
    def __init__(self, spark: SparkSession, path: str, value_type: T.DataType | str = "binary", max_buffer_bytes: int = MAX_BUFFER_BYTES, compaction_threshold: int = COMPACTION_THRESHOLD, objects: ObjectStore | None = None, read_only: bool = False, cache: SegmentCache | None = None) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        kind = T._parse_datatype_string(value_type) if isinstance(value_type, str) else value_type
        self.schema = T.StructType([T.StructField("key", T.StringType(), False), T.StructField("seq", T.LongType(), False), T.StructField("value", kind)])
        self._binary = isinstance(kind, T.BinaryType)
        self.max_buffer_bytes = max_buffer_bytes or MAX_BUFFER_BYTES
        self.compaction_threshold = compaction_threshold or COMPACTION_THRESHOLD
        self.files, self.cache = HadoopStore(spark, self.path), cache
        self._loop: threading.Event | None = None
        self.manifests = ManifestStore(objects or self.files)
        self._buffer: dict[str, Entry] = {}
        self._bytes, self._closed = 0, False
        if read_only:
            self.manifest = self.manifests.latest() or Manifest()
        else:
            self.manifest = self._commit(lambda m: m.next(writer_epoch=m.writer_epoch + 1))
        self.epoch, self._seq = self.manifest.writer_epoch, self.manifest.last_seq_num

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    # --- writing

    def _commit(self, change: Callable[[Manifest], Manifest]) -> Manifest:
        for _ in range(COMMIT_ATTEMPTS):
            made = change(self.manifests.latest() or Manifest())
            try:
                self.manifests.save(made)
                return made
            except PreconditionError:
                continue
        raise ConflictError(f"no commit after {COMMIT_ATTEMPTS} attempts")

    def _check(self) -> None:
        if self._closed:
            raise ClosedError(self.path)

    def _fence(self, manifest: Manifest | None) -> None:
        if manifest and manifest.writer_epoch != self.epoch:
            raise StaleWriterError(f"epoch {self.epoch} was followed by {manifest.writer_epoch}")

    def put(self, key: str, value: object) -> int:
        """Write one value; its sequence number. A full buffer is flushed."""
        self._check()
        seq = self._append(key, value)
        if self._bytes >= self.max_buffer_bytes:
            self.flush()
        return seq

    def delete(self, key: str) -> int:
        """Write a delete marker, for absent keys too."""
        self._check()
        return self._append(key, None)

    def _append(self, key: str, value: object) -> int:
        if self._binary and value is not None and not len(value):
            value = None  # an empty value is a delete marker once it is stored
        self._seq += 1
        old = self._buffer.get(key)
        size = lambda v: len(v) if isinstance(v, (bytes, bytearray, str)) else 64 * (v is not None)
        self._bytes += len(key) + size(value) + ENTRY_OVERHEAD - (len(key) + size(old.value) + ENTRY_OVERHEAD if old else 0)
        self._buffer[key] = Entry(key, self._seq, bytes(value) if isinstance(value, bytearray) else value)
        return self._seq

    def flush(self) -> None:
        """Make the buffer a segment. If that fails, the buffer stays as it was."""
        self._check()
        if not self._buffer:
            return
        self._fence(self.manifests.latest())
        self._add(self._buffer_frame().coalesce(1), self._seq)
        self._buffer, self._bytes = {}, 0

    def write(self, df: DataFrame, batch: int | None = None) -> int:
        """Append a DataFrame as one segment and give the last sequence number.

        It has key, value and, optionally, seq; without it, rows are numbered by their place (with gaps
        between partitions). Buffered rows are flushed first. A ``batch`` that was committed before is
        passed over.
        """
        self._check()
        self.flush()
        base = self.manifests.latest()
        self._fence(base)
        if batch is not None and base.last_batch >= batch:
            return self._seq
        if "seq" not in df.columns:
            df = df.withColumn("seq", F.monotonically_increasing_id() + self._seq + 1)
        rows = df.select(F.col("key").cast("string").alias("key"), F.col("seq").cast("long").alias("seq"), F.col("value").cast(self.schema["value"].dataType).alias("value"))
        self._add(E.normalise(rows) if self._binary else rows, self._seq, batch)
        return self._seq

    def _add(self, rows: DataFrame, seq: int, batch: int | None = None) -> None:
        name = f"{self.epoch:020d}-{self.manifest.wal_id_next:020d}-{uuid.uuid4().hex[:8]}"
        segment = self._segment(rows.sortWithinPartitions("key", F.desc("seq")), f"segments/{name}")

        def change(m: Manifest) -> Manifest:
            self._fence(m)
            added = (segment, *m.l0) if segment.rows else m.l0
            return m.next(l0=added, wal_id_next=m.wal_id_next + 1, last_seq_num=max(m.last_seq_num, seq, segment.max_seq), last_batch=m.last_batch if batch is None else batch)

        try:
            self.manifest = self._commit(change)
        except Exception:
            self.files.delete(segment.path)
            raise
        self._seq = max(self._seq, self.manifest.last_seq_num)

    def _segment(self, rows: DataFrame, path: str) -> Segment:
        uri = self.files.uri(path)
        rows.select(*self.schema.names).write.option("parquet.bloom.filter.enabled#key", "true").parquet(uri)  # for point reads
        stats = E.segment_stats(self.spark.read.schema(self.schema).parquet(uri).select("key", "seq")).first()
        fs = self.files._fs
        size = fs.getContentSummary(self.files._path(path)).getLength()
        return Segment(path.rpartition("/")[2], path, stats.min_key, stats.max_key, stats.min_seq, stats.max_seq, size, stats.n)

    # --- reading

    def _buffer_frame(self) -> DataFrame:
        return self.spark.createDataFrame([(e.key, e.seq, e.value) for e in self._buffer.values()], self.schema)

    def _frame(self, manifest: Manifest, keep: Callable[[Segment], bool] = lambda s: True) -> tuple[DataFrame, bool]:
        """Entries of the segments that ``keep`` doesn't rule out, and whether their keys are unique."""
        segments = [s for s in manifest.segments() if keep(s)]
        unique = len(segments) <= 1 and not any(s in manifest.l0 for s in segments)
        if not segments:
            return self.spark.createDataFrame([], self.schema), True
        if self.cache is None:
            return self._read(*segments), unique
        parts = [self.cache.load(s.path, s.size, lambda s=s: self._read(s)) for s in segments]
        return reduce(DataFrame.unionByName, parts), unique

    def _read(self, *segments: Segment) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*[self.files.uri(s.path) for s in segments])

    def entries(self, keep: Callable[[Segment], bool] = lambda s: True) -> tuple[DataFrame, bool]:
        """This writer's snapshot, its buffer included."""
        self._check()
        manifest = self.manifests.latest() or self.manifest
        df, unique = self._frame(manifest, keep)
        return (df.unionByName(self._buffer_frame()), False) if self._buffer else (df, unique)

    def get(self, key: str) -> Entry | None:
        """The newest entry of a key, perhaps a delete marker; None if it was never written."""
        self._check()
        if key in self._buffer:
            return self._buffer[key]
        df, _ = self.entries(lambda s: s.min_key <= key <= s.max_key)
        row = E.get(df, key).first()
        return Entry(row.key, row.seq, _plain(row.value)) if row else None

    def scan(self) -> DataFrame:
        df, unique = self.entries()
        return E.scan(df, unique)

    def scan_range(self, after: str = "", limit: int = 100) -> Page:
        if limit < 0:
            raise ValueError("limit must not be negative")
        df, unique = self.entries(lambda s: s.max_key > after)
        rows = E.live(df.where(F.col("key") > F.lit(after)), unique).orderBy("key").limit(limit + 1).collect()
        return Page([Entry(r.key, r.seq, _plain(r.value)) for r in rows[:limit]], len(rows) > limit)

    def scan_since(self, seq: int) -> DataFrame:
        df, _ = self.entries(lambda s: s.max_seq > seq)
        return E.scan_since(df, seq)

    def snapshot(self, version: int) -> DataFrame:
        """The live entries of an earlier manifest."""
        df, unique = self._frame(self.manifests.load(version))
        return E.scan(df, unique)

    @property
    def buffered_bytes(self) -> int:
        """Size of what isn't flushed, with a constant for each entry."""
        return self._bytes

    @property
    def last_seq(self) -> int:
        return self._seq

    # --- maintenance

    def maybe_compact(self) -> bool:
        base = self.manifests.latest() or Manifest()
        if len(base.l0) < self.compaction_threshold:
            return False
        self.compact()
        return True

    def compact(self) -> None:
        """Merge level 0 and the first run into one run; delete markers stay, and so do segments that arrive meanwhile."""
        self._check()
        base = self.manifests.latest() or Manifest()
        if not base.l0:
            return
        runs = base.sorted_runs[:1]
        sources = [*base.l0, *(s for r in runs for s in r.sstables)]
        df = self._read(*sources)
        parts = max(1, -(-sum(s.rows for s in sources) // PARTITION_ROWS))
        merged = E.latest(df).repartitionByRange(parts, "key").sortWithinPartitions("key")
        segment = self._segment(merged, f"sorted/L1-{base.version:020d}-{uuid.uuid4().hex[:8]}")
        done = {s.path for s in sources}

        def change(m: Manifest) -> Manifest:
            if not done <= {s.path for s in m.segments()}:
                raise ConflictError("another compaction took these segments")
            rest = tuple(r for r in m.sorted_runs if not {s.path for s in r.sstables} <= done)
            return m.next(l0=tuple(s for s in m.l0 if s.path not in done), sorted_runs=(SortedRun(1, (segment,)), *rest), compactor_epoch=m.compactor_epoch + 1, last_seq_num=max(m.last_seq_num, segment.max_seq))

        try:
            self.manifest = self._commit(change)
        except Exception:
            self.files.delete(segment.path)
            raise

    def compact_every(self, seconds: float = COMPACTION_SECONDS) -> None:
        """Compact in the background whenever level 0 is long enough, until the store is closed."""
        stop = self._loop = self._loop or threading.Event()

        def loop() -> None:
            while not stop.wait(seconds):
                try:
                    self.maybe_compact()
                except (ConflictError, ClosedError):
                    continue  # another compaction won, or the store is closing

        threading.Thread(target=loop, daemon=True).start()

    def vacuum(self, keep_versions: int = 1) -> list[str]:
        """Delete segments that none of the newest manifests names, and older manifests; on request only."""
        versions = self.manifests.versions()
        kept = {s.path for v in versions[-keep_versions:] for s in self.manifests.load(v).segments()}
        old = {s.path for v in versions[:-keep_versions] for s in self.manifests.load(v).segments()} - kept
        for path in sorted(old):
            self.files.delete(path)
        for v in versions[:-keep_versions]:
            self.manifests.objects.delete(self.manifests._key(v))
        return sorted(old)

    def close(self) -> None:
        self._closed, self._buffer = True, {}
        if self._loop:
            self._loop.set()
        if self.cache:
            self.cache.clear()


def _plain(value: object) -> object:
    return bytes(value) if isinstance(value, bytearray) else value


def scratch_store(spark: SparkSession, value_type: str) -> Store:
    """A store of its own in the folder that executors share, for queries over the driver's tables."""
    return Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}", value_type)


def shared_folder(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    import atexit
    import shutil
    import tempfile

    folder = tempfile.mkdtemp(prefix="sparkdoc-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return "file://" + folder
