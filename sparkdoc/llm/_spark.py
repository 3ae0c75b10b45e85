"""Helpers shared by the corpus operators: shared-folder tables, Arrow mapping, skew-safe joins, components."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LOCAL_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors see: ``spark.checkpoint.dir``; a temporary one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="sparkdoc-")
        atexit.register(shutil.rmtree, _LOCAL_DIRS[app], ignore_errors=True)
    return "file://" + _LOCAL_DIRS[app]


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def _hadoop(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove_path(spark: SparkSession, path: str) -> None:
    target, files = _hadoop(spark, path)
    files.delete(target, True)


_WATCHERS: list[list[Scratch]] = []


@contextlib.contextmanager
def freeing() -> Iterator[None]:
    """Free all that operators keep for their results inside the block, which must have written these elsewhere."""
    seen: list[Scratch] = []
    _WATCHERS.append(seen)
    try:
        yield
    finally:
        _WATCHERS.remove(seen)
        for scratch in seen:
            scratch.clear()


class Scratch:
    """Tables and folders in the shared folder; ``drop``, ``only`` and ``clear`` free those no longer read.

    As a context manager it frees everything if its block fails. What a lazy result still reads when its operator
    returns is freed at the end of a block of ``freeing``, or else when the application ends.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.tables: dict[int, tuple[DataFrame, str]] = {}  # holds the frames, so that no id is used again
        self.folders: list[str] = []
        for seen in _WATCHERS:
            seen.append(self)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, failed: type | None, *_: object) -> None:
        if failed:
            self.clear()

    def folder(self, tag: str) -> str:
        """A fresh folder for other files than tables."""
        path = fresh_path(self.spark, tag)
        target, files = _hadoop(self.spark, path)
        files.mkdirs(target)
        files.deleteOnExit(target)
        self.folders.append(path)
        return path

    def clear(self) -> None:
        self.only()
        while self.folders:
            remove_path(self.spark, self.folders.pop())

    def keep(self, df: DataFrame, tag: str) -> DataFrame:
        """Write ``df`` once and return the written table, so that its lineage ends there."""
        path = fresh_path(self.spark, tag)
        try:
            df.write.parquet(path)
        except Exception:
            remove_path(self.spark, path)  # a failed write leaves a part
            raise
        target, files = _hadoop(self.spark, path)
        files.deleteOnExit(target)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.tables[id(out)] = (out, path)
        return out

    def drop(self, df: DataFrame) -> None:
        found = self.tables.pop(id(df), None)
        if found:
            remove_path(self.spark, found[1])

    def only(self, *needed: DataFrame) -> None:
        """Drop all tables but those that the result still reads."""
        for df, _ in list(self.tables.values()):
            if not any(df is n for n in needed):
                self.drop(df)


def slices(offsets: np.ndarray, max_bytes: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``max_bytes`` of text each; a longer text is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + max_bytes, side="right")) - 1)
        yield i, min(j, n)
        i = j


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    if not wide and not pa.types.is_string(column.type):
        column, wide = column.cast(pa.large_string()), True
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def map_texts(
    df: DataFrame,
    text_col: str,
    keep: dict[str, str],
    fields: list[tuple[str, T.DataType]],
    kernel: Callable[[], Callable[[np.ndarray, np.ndarray], list]],
    chunk_bytes: int = 1 << 20,
) -> DataFrame:
    """Apply a vectorised kernel to a text column in Arrow batches.

    ``keep`` maps output names to input columns that pass through. ``kernel`` is called once a
    task; what it returns gets (bytes, offsets) of about ``chunk_bytes`` of whole texts and gives
    one array for each of ``fields``.
    """
    # a text that is kept goes to Python once
    kept_at = [i for i, c in enumerate(keep.values()) if c == text_col and isinstance(df.schema[c].dataType, T.StringType)]
    at = kept_at[0] if kept_at else len(keep)
    source = df.select(*[df[c].alias(name) for name, c in keep.items()], *([] if kept_at else [df[text_col].cast("string").alias("__text")]))
    schema = T.StructType([*source.schema.fields[: len(keep)], *[T.StructField(n, t) for n, t in fields]])
    n_keep, arrow = len(keep), [_arrow_type(t) for _, t in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = kernel()
        for batch in batches:
            data, off = text_buffer(batch.column(at))
            for i, j in slices(off, chunk_bytes):
                out = apply(data[off[i] : off[j]], off[i : j + 1] - off[i])
                kept = [batch.column(k).slice(i, j - i) for k in range(n_keep)]
                made = [x if isinstance(x, pa.Array) else pa.array(x, type=t) for x, t in zip(out, arrow, strict=True)]
                yield pa.RecordBatch.from_arrays([*kept, *made], names=schema.names)

    return source.mapInArrow(run, schema)


def carry(df: DataFrame) -> dict[str, str]:
    """All columns, as ``keep`` of ``map_texts``, under names that clash with none."""
    return {f"__c{i}": c for i, c in enumerate(df.columns)}


def restore(mapped: DataFrame, df: DataFrame) -> DataFrame:
    """The carried columns under their own names."""
    return mapped.select(*[F.col(k).alias(c) for k, c in carry(df).items()])


def _arrow_type(t: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(t)


#: Keys that hold more than this share of all rows are hot; there can be at most 1 / HOT_SHARE of them.
HOT_SHARE = 1 / 1000


def join_counted(left: DataFrame, right: DataFrame, keys: list[str], n_col: str, total: int) -> DataFrame:
    """Inner join of rows with one row a key, where ``n_col`` of ``right`` is the key's number of rows.

    Keys above ``HOT_SHARE`` of ``total`` rows are broadcast (at most 1 / HOT_SHARE rows, whatever
    the input); all others meet in a shuffle in which no key is hot.
    """
    limit = max(1.0, total * HOT_SHARE)
    hot = right.where(F.col(n_col) > limit)
    cold = right.where(F.col(n_col) <= limit)
    rare = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return left.join(F.broadcast(hot), keys).unionByName(rare.join(cold, keys))


#: Bytes of equal rows above which they are kept apart, and bytes of such rows that go to one partition.
BULK, PART = 8 << 20, 32 << 20


def apart(bulky: DataFrame, size: int) -> DataFrame:
    """``bulky`` rows of ``size`` bytes in all, dealt in turn to partitions of about ``PART`` bytes.

    Copies of a long text that lie in a row compress to little, so that a reader takes as many at once as its batch has rows.
    """
    return bulky.repartition(max(1, -(-size // PART)))


#: Edges that one task may hold for a union-find (16 bytes each); more are joined in rounds.
LOCAL_EDGES = 1_000_000


def components(edges: DataFrame, scratch: Scratch, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """Connected components of edges (a, b): one row (node, root) for every node of an edge.

    The root is the smallest node. Up to ``local_edges`` edges are joined by one union-find; more
    by alternating large-star and small-star rounds over shuffles, until no edge moves. Both give
    the same roots. Loops and repeated edges do no harm; nodes must not be null.
    """
    edges = scratch.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    if edges.count() <= local_edges:
        return edges.coalesce(1).mapInArrow(_union_find, "node long, root long")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = scratch.keep(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e"))
        after = scratch.keep(small.select("e.a", "e.b").where("a <> b").distinct(), "small")
        scratch.drop(edges)
        scratch.drop(large)
        edges = after
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
        before = now


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    a, b = (np.concatenate([x.column(k).to_numpy(zero_copy_only=False) for x in got]) for k in (0, 1))
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    roots = nodes[min_labels(len(nodes), flat[: len(a)], flat[len(a) :])]
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(roots, pa.int64())], names=["node", "root"])


def min_labels(n: int, i: np.ndarray, j: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
    """Smallest index of each component of n nodes and edges (i, j); ``labels`` holds what earlier edges joined."""
    labels = np.arange(n) if labels is None else labels
    while len(i):
        a, b = labels[i], labels[j]
        apart = a != b
        if not apart.any():
            break
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:  # pointer jumping
            up = labels[labels]
            if np.array_equal(up, labels):
                break
            labels = up
    return labels
