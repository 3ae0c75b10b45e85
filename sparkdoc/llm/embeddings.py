"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors at a cosine of ``threshold`` or more are at most epsilon = sqrt(2 - 2 * threshold) apart,
and no further apart on any projection. Vectors are cut into grid cells of side epsilon on their
leading principal dimensions (a rotation, fitted on a bounded sample: it decides speed, never
results), sorted by label, length and cells, and range-partitioned into sequence intervals, which are
written. An interval is joined with itself where it lies. To each other interval whose box is within epsilon of
its own box it sends those of its rows that are within epsilon of that box, so a vector is copied once for
each other interval near it, and never to one beyond; the pairs of intervals are found by the executors from
the list of boxes. Joins go by recursion: two stretches whose boxes are more than epsilon apart are skipped,
larger ones are halved, small ones are compared by a product of matrices in double precision. Products
within 1e-12 of the threshold are computed again with exact sums, so that no link depends on the blocks.

Vectors are compared only when labels are equal and not null (and lengths equal); vectors that are
null, empty, zero, or hold null or non-finite components link with nothing. Equal vectors of one label
are a class that is compared once. Links leave a task as counts and a spanning forest, linear in its
rows. Null ids count as rows and keep a null id; repeated rows count as often as they occur.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkdoc.llm._spark import Scratch, components, join_counted, min_labels

THRESHOLD = 0.93
#: Vectors that the rotation is fitted on.
SAMPLE = 20_000
#: Leading principal dimensions that make the grid.
DIMS = 6
#: Vectors of an interval: a table makes ``FEW`` of them until they hold ``INTERVAL_MOST`` vectors or ``INTERVAL_BYTES``; then they become more.
#: A copied vector is compared with a whole interval, so that copies cost little beside the comparisons they are made for.
INTERVAL, INTERVAL_MOST, INTERVAL_BYTES, FEW = 4096, 32_768, 64 << 20, 32
#: The most intervals there may be (beyond it they grow): bounds the list of boxes that executors get.
INTERVALS = 20_000
LEAF = 512
#: Bytes of the sample of vectors that the rotation is fitted on.
SAMPLE_BYTES = 64 << 20
#: Distance from the threshold within which a cosine is computed by exact sums.
TIE = 1e-12


def rotation(sample: np.ndarray, dims: int) -> np.ndarray:
    """Leading principal directions, with signs fixed so that runs agree."""
    if not len(sample):
        return np.zeros((sample.shape[1], 0))
    values, vectors = np.linalg.eigh(np.cov(sample, rowvar=False, bias=True).reshape(sample.shape[1], -1))
    lead = vectors[:, np.argsort(-values, kind="stable")[:dims]]
    return lead * np.where(lead[np.abs(lead).argmax(axis=0), np.arange(lead.shape[1])] < 0, -1, 1)


def unit(flat: np.ndarray, width: int) -> np.ndarray:
    m = flat.astype(np.float64).reshape(-1, width)
    scaled = m / np.abs(m).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def boxes_apart(lo_a: np.ndarray, hi_a: np.ndarray, lo_b: np.ndarray, hi_b: np.ndarray, eps: float) -> np.ndarray | bool:
    """Whether boxes (last axis: dimensions) are further apart than eps."""
    gap = np.maximum(np.maximum(lo_b - hi_a, lo_a - hi_b), 0)
    return (gap * gap).sum(axis=-1) > eps * eps * (1 + 1e-9)


def exact_cosine(a: np.ndarray, b: np.ndarray) -> float:
    """Cosine by sums that are rounded once; products of single-precision components are exact."""
    a, b = (v.astype(np.float64) / (1.0 if v.dtype == np.float32 else np.abs(v).max()) for v in (a, b))
    dot, aa, bb = (math.fsum((u * v).tolist()) for u, v in ((a, b), (a, a), (b, b)))
    return dot / math.sqrt(aa * bb) if 0 < aa * bb < math.inf else dot / math.sqrt(aa) / math.sqrt(bb)


def join_intervals(x: np.ndarray, p: np.ndarray, y: np.ndarray, q: np.ndarray, same: bool, threshold: float, leaf: int = LEAF, exact: Callable[[int, int], float] | None = None):
    """Pairs (i, j) of rows of x and y with a cosine of at least ``threshold``, part by part; p and q are the grid projections.

    With ``same``, x is y and each pair comes once, i < j. ``exact`` gives the cosine of rows i and j where their product is near the threshold.
    """
    eps = math.sqrt(2 - 2 * threshold) if threshold > -1 else math.inf
    todo = [(0, len(x), 0, len(y))]
    while todo:
        a, b, c, d = todo.pop()
        if a >= b or c >= d or (same and c < a):
            continue
        if p.shape[1] and boxes_apart(p[a:b].min(0), p[a:b].max(0), q[c:d].min(0), q[c:d].max(0), eps):
            continue
        if b - a <= leaf and d - c <= leaf:
            cosine = x[a:b] @ y[c:d].T
            i, j = np.nonzero(cosine >= threshold - TIE)
            near = cosine[i, j] < threshold + TIE
            i, j = i + a, j + c
            if same:
                i, j, near = i[i < j], j[i < j], near[i < j]
            if exact and near.any():
                good = np.array([not n or exact(u, v) >= threshold for n, u, v in zip(near.tolist(), i.tolist(), j.tolist(), strict=True)])
                i, j = i[good], j[good]
            if len(i):
                yield i, j
            continue
        m, n = (a + b + 1) // 2, (c + d + 1) // 2
        if same and a == c and b == d:
            todo += [(a, m, a, m), (a, m, m, b), (m, b, m, b)]
        elif b - a >= d - c:
            todo += [(a, m, c, d), (m, b, c, d)]
        else:
            todo += [(a, b, c, n), (a, b, n, d)]


def interval_rows(total: int, width: int) -> int:
    """Vectors of an interval in a table of ``total``."""
    return max(1, min(max(INTERVAL, -(-total // FEW)), INTERVAL_MOST, INTERVAL_BYTES // (8 * width)))


def near_intervals(meta: list, k: int, eps: float) -> list[int]:
    """Intervals other than ``k`` that may hold links with it; ``meta`` is in the order of the intervals, (label, width) first."""
    mine = meta[k]
    lo = bisect.bisect_left(meta, mine["first"], key=lambda m: m["last"])
    hi = bisect.bisect_right(meta, mine["last"], key=lambda m: m["first"])
    apart = boxes_apart(mine["lo"], mine["hi"], np.array([m["lo"] for m in meta[lo:hi]]), np.array([m["hi"] for m in meta[lo:hi]]), eps)
    return [lo + i for i in np.flatnonzero(~apart).tolist() if lo + i != k]


def _block_schema(least: T.DataType) -> T.StructType:
    kind = "struct<label:string,width:bigint>"
    return T.StructType([*T._parse_datatype_string(f"pid int, first {kind}, last {kind}, lo array<double>, hi array<double>, keys array<binary>, counts array<bigint>").fields, T.StructField("leasts", T.ArrayType(least)), T.StructField("rows", T.BinaryType())])


def _components(vectors: DataFrame, column: str):
    """The vectors as they are if they are floats, half of what doubles take; sums are in double precision anyway."""
    kind = vectors.schema[column].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    return vectors[column] if single else vectors[column].cast("array<double>")


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add a digest of label and components, null where a vector links with nothing."""
    for b in batches:
        label, v = b.column(1).to_pylist(), b.column(2)
        width = np.where(v.is_null().to_numpy(zero_copy_only=False), 0, np.nan_to_num(v.value_lengths().to_numpy(zero_copy_only=False))).astype(np.int64)
        keys: list[bytes | None] = [None] * b.num_rows
        for w in np.unique(width[width > 0]).tolist():
            m = np.flatnonzero(width == w)
            # null components are NaN here; adding 0.0 makes -0.0 equal to 0.0
            x = v.take(pa.array(m)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, w) + 0.0
            sound = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
            for i in np.flatnonzero(sound).tolist():
                name = label[m[i]]
                if name is not None:
                    keys[m[i]] = hashlib.blake2b(x[i].tobytes() + name.encode(), digest_size=20).digest()
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys, pa.binary())], names=[*b.schema.names, "key"])


def near_duplicates(
    vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", dims: int = DIMS, sample: int = SAMPLE, interval: int | None = None, intervals: int = INTERVALS
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    with Scratch(vectors.sparkSession) as scratch:
        return _near_duplicates(vectors, threshold, id_col, vector_col, label_col, dims, sample, interval, intervals, scratch)


def _rotations(classes: DataFrame, dims: int, sample: int) -> dict[int, np.ndarray]:
    """A rotation for each width, fitted on the vectors of the smallest hashes."""
    turn = {}
    for (w,) in classes.select("width").distinct().orderBy("width").limit(1000).collect():  # wider kinds than these have no grid: slower, not other
        part = classes.where(F.col("width") == w).orderBy(F.xxhash64("key"), "key").limit(max(1, min(sample, SAMPLE_BYTES // (8 * w)))).select("v").toArrow()
        flat = part.column(0).combine_chunks().flatten().to_numpy(zero_copy_only=False)
        turn[w] = rotation(unit(flat, w), min(dims, w))
    return turn


def _match(a: dict, c: dict, same: bool, threshold: float) -> Iterator[pa.RecordBatch]:
    """Links between two parts, by kind (label, width): nodes, counts, components, projections; as sums and a spanning forest."""
    for kind in a.keys() & c.keys():
        (ida, na, raw_a, p), (idb, nb, raw_b, q) = a[kind], c[kind]
        w = kind[1]
        x = unit(raw_a, w)
        y = x if same else unit(raw_b, w)
        offset = 0 if same else len(ida)
        exact = lambda i, j, u=raw_a, v=raw_b, w=w: exact_cosine(u[i * w : i * w + w], v[j * w : j * w + w])
        links, labels = np.zeros(offset + len(idb), np.int64), np.arange(offset + len(idb))
        for i, j in join_intervals(x, p, y, q, same, threshold, exact=exact):
            np.add.at(links, i, nb[j])
            np.add.at(links, j + offset, na[i])
            labels = min_labels(len(links), i, j + offset, labels)
        ids = idb if same else np.concatenate([ida, idb])
        hit = np.flatnonzero(links)
        if len(hit):
            yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(links[hit]), pa.array(ids[labels[hit]])], names=["node", "links", "root"])


_LINKS = "node long, links long, root long"


def _near_duplicates(vectors: DataFrame, threshold: float, id_col: str, vector_col: str, label_col: str, dims: int, sample: int, interval: int | None, intervals: int, scratch: Scratch) -> DataFrame:
    spark = vectors.sparkSession
    rows = vectors.select(vectors[id_col].alias("vec_id"), vectors[label_col].cast("string").alias("label"), _components(vectors, vector_col).alias("v"))
    keyed = scratch.keep(rows.mapInArrow(_keys, T.StructType([*rows.schema.fields, T.StructField("key", T.BinaryType())])), "vectors")
    alone = keyed.where("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    classes = keyed.where("key is not null").groupBy("key").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"), F.any_value("label").alias("label"), F.any_value("v").alias("v"))
    classes = scratch.keep(classes.withColumn("width", F.size("v").cast("long")), "classes")
    total = classes.count()
    turn = _rotations(classes, dims, sample)
    eps = math.sqrt(max(2 - 2 * threshold, 1e-12))

    def grid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            width = b.column(5).to_numpy(zero_copy_only=False)
            out = np.zeros((b.num_rows, dims))
            for w in np.unique(width):
                m = np.flatnonzero(width == w)
                if w in turn:
                    p = unit(b.column(4).take(pa.array(m)).flatten().to_numpy(zero_copy_only=False), int(w)) @ turn[w]
                    out[m, : p.shape[1]] = p
            cells = pa.array(np.floor(out / eps).astype(np.int32).tolist(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns, cells, pa.array(out.tolist(), pa.list_(pa.float64()))], names=[*b.schema.names, "cells", "p"])

    gridded = classes.mapInArrow(grid, T.StructType([*classes.schema.fields, *T._parse_datatype_string("cells array<int>, p array<double>").fields]))
    order = ["label", "width", "cells", "p", "key"]
    size = max(interval or interval_rows(total, max(turn, default=1)), -(-total // intervals))
    ordered = gridded.repartitionByRange(max(1, -(-total // size)), *order).sortWithinPartitions(*order)
    schema = _block_schema(classes.schema["least"].dataType)

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        got = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if got is None or not got.num_rows:
            return
        pid = TaskContext.get().partitionId()
        label, width = got.column("label").to_pylist(), got.column("width").to_numpy()
        p = got.column("p").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
        parts = {}
        kinds = [(a, int(b)) for a, b in zip(label, width, strict=True)]
        cut = [0, *[i for i in range(1, len(kinds)) if kinds[i] != kinds[i - 1]], len(kinds)]
        node, n, v = (pid << 32) + np.arange(len(kinds)), got.column("n").to_numpy(), got.column("v").combine_chunks()
        for i, j in zip(cut, cut[1:]):
            parts[kinds[i]] = (node[i:j], n[i:j], v.slice(i, j - i).flatten().to_numpy(zero_copy_only=False), p[i:j])
        named = [{"label": k[0], "width": k[1]} for k in (kinds[0], kinds[-1])]
        row = {"pid": pid, "first": named[0], "last": named[1], "lo": p.min(0).tolist(), "hi": p.max(0).tolist(), "keys": got.column("key").to_pylist(), "counts": n, "leasts": got.column("least").to_pylist(), "rows": pickle.dumps(parts, protocol=5)}
        yield pa.RecordBatch.from_pylist([row], schema=_arrow_schema(schema))

    blocks = scratch.keep(ordered.mapInArrow(block, schema), "blocks")
    kind = lambda r: (r.label, r.width)
    meta = [{"pid": r.pid, "first": kind(r.first), "last": kind(r.last), "lo": np.array(r.lo), "hi": np.array(r.hi)} for r in blocks.select("pid", "first", "last", "lo", "hi").orderBy("pid").collect()]  # at most ``intervals`` rows
    shared = spark.sparkContext.broadcast(meta)

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for packed in b.column(0):
                parts = pickle.loads(packed.as_py())
                yield from _match(parts, parts, True, threshold)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        boxes = shared.value
        place = {m["pid"]: k for k, m in enumerate(boxes)}
        for b in batches:
            for pid, packed in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                parts, k = pickle.loads(packed.as_py()), place[pid]
                for j in near_intervals(boxes, k, eps):
                    other = boxes[j]
                    sent = {}
                    for key, (node, n, v, p) in parts.items():
                        if other["first"] <= key <= other["last"]:
                            m = np.flatnonzero(~boxes_apart(p, p, other["lo"], other["hi"], eps))
                            if len(m):
                                sent[key] = (node[m], n[m], v.reshape(len(node), -1)[m].ravel(), p[m])
                    if sent:
                        yield pa.RecordBatch.from_arrays([pa.array([min(k, j)]), pa.array([max(k, j)]), pa.array([k > j]), pa.array([sum(len(x[0]) for x in sent.values())]), pa.array([pickle.dumps(sent, protocol=5)])], names=["a", "b", "second", "n", "rows"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, left = None, b""
        for b in batches:
            for k in range(b.num_rows):
                here, rows = (b.column(0)[k].as_py(), b.column(1)[k].as_py()), b.column(2)[k].as_py()
                if here == pair:  # an interval with no row near the other sends none
                    yield from _match(pickle.loads(left), pickle.loads(rows), False, threshold)
                    pair = None
                else:
                    pair, left = here, rows

    tasks = max(1, min(2 * len(meta), 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    sent = blocks.select("pid", "rows").mapInArrow(send, "a long, b long, second boolean, n long, rows binary")
    apart = sent.repartition(tasks, "a", "b").sortWithinPartitions("a", "b", "second").select("a", "b", "rows").mapInArrow(compare, _LINKS)
    links = scratch.keep(blocks.select("rows").mapInArrow(within, _LINKS).unionByName(apart), "links")
    roots = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")), scratch)
    sums = links.groupBy("node").agg(F.sum("links").alias("links"))
    listed = blocks.select("pid", F.posexplode(F.arrays_zip("keys", "counts", "leasts"))).select((F.col("pid").cast("long") * F.lit(1 << 32) + F.col("pos")).alias("node"), F.col("col.keys").alias("key"), F.col("col.counts").alias("n"), F.col("col.leasts").alias("least"))
    linked = scratch.keep(listed.join(sums, "node", "left").join(roots, "node", "left").select("key", "n", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root")), "linked")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    placed = scratch.keep(join_counted(linked, least, ["root"], "members", total).select("key", "n", "links", "component_id"), "placed")
    scratch.only(keyed, placed)
    found = join_counted(keyed.where("key is not null").select("vec_id", "key"), placed, ["key"], "n", keyed.count())
    both = found.select("vec_id", (F.col("n") - 1 + F.col("links")).alias("n_links"), "component_id").unionByName(alone)
    return both.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)
