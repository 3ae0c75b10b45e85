"""SimHash near-duplicates: 64-bit fingerprints of word pairs, compared exactly in tiles.

A fingerprint is taken from the whole text. Distinct fingerprints, not rows, are compared: copies
meet once. The 64 bits are split into 6 + c blocks; two fingerprints at 6 or fewer differing bits agree
on c blocks at least, so each pair meets in a bucket of equal bits of some c blocks. More fingerprints
take more blocks, so that buckets stay small: one of 7 (7 copies of a fingerprint) up to 8 million, two of 8
(28 copies) up to a billion, three of 9 (84) up to 34 billion. A bucket is compared in tiles, sorted by population count, by
exclusive-or and bit count; tile pairs whose population counts differ beyond the radius are skipped. A
bucket above ``max_bucket`` is split again by seven blocks of its remaining bits, as often as it takes:
fingerprints are distinct, so this ends, and no pair is lost. What leaves a bucket is linear in it: link counts
and a spanning forest.

Nulls and blanks: a null or blank text has no words and fingerprint zero, linked like any other.
Rows with a null id count as rows and keep null ids; repeated rows count as often as they occur.
An empty table gives no rows. Other columns of the input don't matter.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkdoc.llm._spark import Scratch, carry, components, join_counted, map_texts, min_labels, restore
from sparkdoc.llm._text import SPACE, words, xxh64

RADIUS = 6
#: Fingerprints that one task compares with each other at once (8 bytes each).
MAX_BUCKET = 16_384
TILE = 1024
_NOT_SPACE = ~SPACE
_LANES = np.uint64(0x0101010101010101)


def fingerprints(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """SimHash of each text as uint64."""
    out = np.zeros(len(off) - 1, np.uint64)
    low, start, end, first = words(data, off, _NOT_SPACE)
    count = np.diff(first)
    if not len(start):
        return out
    # words with one space before each, so that a pair of neighbours is one slice
    length = end - start
    at = np.cumsum(length + 1) - length
    packed = np.full(int(at[-1] + length[-1]), 32, np.uint8)
    mask = np.ones(len(packed), bool)
    mask[at - 1] = False
    inside = np.zeros(len(low) + 1, np.int8)
    inside[start] += 1
    inside[end] -= 1
    packed[mask] = low[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]
    last = np.zeros(len(start), bool)
    last[first[1:][count > 0] - 1] = True
    single = np.repeat(count, count) == 1
    use = np.flatnonzero(~last | single)
    stop = np.where(single[use], use, np.minimum(use + 1, len(start) - 1))
    h = xxh64(packed, at[use], at[stop] + length[stop] - at[use])
    # bit counts: eight bits at a time in eight byte lanes, in blocks of at most 255 hashes
    shingles = np.where(count > 1, count - 1, count)
    have = np.flatnonzero(shingles)
    shingles = shingles[have]
    begin = np.cumsum(shingles) - shingles
    inner = np.arange(len(h)) - np.repeat(begin, shingles)
    blocks = np.flatnonzero(inner % 255 == 0)
    ones = np.empty((len(blocks), 8, 8), np.int64)  # block, byte, bit
    for b in range(8):
        lanes = np.add.reduceat((h >> np.uint64(b)) & _LANES, blocks)
        ones[:, :, b] = lanes.astype("<u8").view(np.uint8).reshape(-1, 8)
    per_text = np.add.reduceat(ones.reshape(-1, 64), np.searchsorted(blocks, begin), axis=0)
    out[have] = np.packbits(2 * per_text > shingles[:, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def _text_hash(docs: DataFrame, text_col: str) -> tuple[Column, Column]:
    """What tells the texts of one id apart: a hash, computed by the JVM, and the length."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    return F.xxhash64(text).alias("h"), F.octet_length(text).alias("size")


def fingerprint_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, size, fp): one row for every row of the input, with hash and length of the text."""
    kernel = lambda: lambda data, off: [fingerprints(data, off).view(np.int64)]
    source = docs.select(docs[id_col].alias("doc_id"), *_text_hash(docs, text_col), docs[text_col].alias("text"))
    return map_texts(source, "text", {c: c for c in ("doc_id", "h", "size")}, [("fp", T.LongType())], kernel)


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def split_mask(mask: int, radius: int = RADIUS) -> list[int]:
    """``radius`` + 1 masks that part the bits not in ``mask``, as evenly as they go."""
    free = [b for b in range(64) if not mask >> b & 1]
    return [sum(1 << b for b in part) for part in (free[k * len(free) // (radius + 1) : (k + 1) * len(free) // (radius + 1)] for k in range(radius + 1))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shared_blocks(fingerprints: int, radius: int, max_bucket: int) -> int:
    """Blocks that the buckets of so many fingerprints share: the fewest that leave a bucket half of ``max_bucket`` or less, if they were spread evenly."""
    c = 1
    while c < 4 and fingerprints > max_bucket / 2 * 2 ** (64 * c // (radius + c)):
        c += 1
    return c


class _Paths:
    """Bucket kinds: the bits that members share, and the earlier kinds of the same parent whose bits a pair must not all share to count here."""

    def __init__(self, radius: int, blocks: int = 1) -> None:
        self.radius, self.blocks = radius, blocks
        self.mask = [0]
        self.earlier: list[list[int]] = [[]]

    def splits(self, path: int) -> bool:
        """Whether enough bits are left; a bucket where they aren't holds at most 2 ** radius fingerprints."""
        return 64 - self.mask[path].bit_count() > self.radius

    def children(self, path: int) -> list[int]:
        made = []
        blocks = self.blocks if path == 0 else 1
        parts = [sum(c) for c in itertools.combinations(split_mask(self.mask[path], self.radius + blocks - 1), blocks)]
        for k, part in enumerate(parts):
            made.append(len(self.mask))
            self.mask.append(self.mask[path] | part)
            self.earlier.append(self.earlier[path] + parts[:k])
        return made


def _spread(rows: DataFrame, paths: _Paths, parents: list[int]) -> DataFrame:
    """Rows (path, fp, n) of the parents' buckets, once for each block that splits them."""
    choice = F.lit(None)
    for p in parents:
        kinds = F.array(*[F.struct(F.lit(c).alias("path"), F.col("fp").bitwiseAND(F.lit(_signed(paths.mask[c]))).alias("bits")) for c in paths.children(p)])
        choice = F.when(F.col("path") == p, kinds).otherwise(choice)
    return rows.select("fp", "n", F.explode(choice).alias("k")).select("k.path", "k.bits", "fp", "n")


def compare(fp: np.ndarray, n: np.ndarray, earlier: list[int], radius: int = RADIUS, tile: int = TILE) -> tuple[np.ndarray, np.ndarray]:
    """Links of a bucket: rows linked to each fingerprint that no earlier bucket counts, and each one's component (an index)."""
    order = np.argsort(np.bitwise_count(fp), kind="stable")
    fp, n = fp[order], n[order]
    ones = np.bitwise_count(fp).astype(np.int16)
    links, labels = np.zeros(len(fp), np.int64), np.arange(len(fp))
    seen = [np.uint64(m) for m in earlier]
    for i in range(0, len(fp), tile):
        a, top = fp[i : i + tile], ones[min(i + tile, len(fp)) - 1]
        for j in range(i, len(fp), tile):
            if ones[j] - top > radius:
                break  # sorted: all later tiles are further off
            x = a[:, None] ^ fp[None, j : j + tile]
            r, c = np.nonzero(np.bitwise_count(x) <= radius)
            if i == j:
                r, c = r[r < c], c[r < c]
            if not len(r):
                continue
            bits = x[r, c]
            r, c = r + i, c + j
            labels = min_labels(len(fp), r, c, labels)
            first = np.ones(len(bits), bool)
            for m in seen:
                first &= (bits & m) != 0
            r, c = r[first], c[first]
            np.add.at(links, r, n[c])
            np.add.at(links, c, n[r])
    back = np.empty(len(fp), np.int64)
    back[order] = np.arange(len(fp))
    return links[back], order[labels][back]


def _compare_buckets(earlier: list[list[int]], radius: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def flush(parts: list[np.ndarray]) -> pa.RecordBatch | None:
        path, fp, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        if len(fp) < 2:
            return None
        links, root = compare(fp.view(np.uint64), n, earlier[path[0]], radius)
        keep = np.flatnonzero((links > 0) | (root != np.arange(len(fp))))
        if not len(keep):
            return None
        return pa.RecordBatch.from_arrays([pa.array(fp[keep]), pa.array(links[keep]), pa.array(fp[root[keep]])], names=["fp", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list = []
        key = None
        for batch in batches:
            path, bits, fp, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            cuts = np.flatnonzero((path[1:] != path[:-1]) | (bits[1:] != bits[:-1])) + 1
            for i, j in zip([0, *cuts], [*cuts, len(path)], strict=True):
                if i == j:
                    continue
                if key is not None and key != (path[i], bits[i]):
                    if out := flush(parts):
                        yield out
                    parts = []
                key = (path[i], bits[i])
                parts.append((path[i:j], fp[i:j], n[i:j]))
        if parts and (out := flush(parts)):
            yield out

    return run


def link(fps: DataFrame, scratch: Scratch, radius: int = RADIUS, max_bucket: int = MAX_BUCKET, blocks: int | None = None) -> DataFrame:
    """Classes of equal fingerprints: (fp, n, n_near, component_id, keeper) from written rows (doc_id, fp).

    ``n`` is the class's number of rows, ``n_near`` the rows linked directly to one of its rows,
    ``component_id`` the smallest doc_id that links reach, ``keeper`` the smallest fingerprint that it has there.
    """
    classes = scratch.keep(fps.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")), "classes")
    paths = _Paths(radius, blocks or shared_blocks(classes.count(), radius, max_bucket))
    level, parents, found = classes.select(F.lit(0).alias("path"), "fp", "n"), [0], []
    while True:
        level = _spread(level, paths, parents)
        sizes = level.groupBy("path", "bits").count().where(F.col("count") > max_bucket).select("path", "bits")
        hot = scratch.keep(sizes, "hot")
        kinds = [k for k in sorted(r[0] for r in hot.select("path").distinct().collect()) if paths.splits(k)]  # a few, times 7 ** depth
        hot = hot.where(F.col("path").isin(kinds)) if kinds else hot
        cold = level.join(hot, ["path", "bits"], "left_anti") if kinds else level
        grouped = cold.select("path", "bits", "fp", "n").repartition("path", "bits").sortWithinPartitions("path", "bits")
        found.append(scratch.keep(grouped.mapInArrow(_compare_buckets(paths.earlier, radius), "fp long, links long, root long"), "links"))
        if not kinds:
            break
        again = scratch.keep(level.join(hot, ["path", "bits"], "left_semi").select("path", "fp", "n"), "level")
        level, parents = again, kinds
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    roots = components(links.select(F.col("fp").alias("a"), F.col("root").alias("b")), scratch)
    sums = links.groupBy("fp").agg(F.sum("links").alias("links"))
    joined = scratch.keep(
        classes.join(sums, "fp", "left").join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "n", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "fp").alias("root")), "linked"
    )
    first = F.min(F.when(F.col("least").isNotNull(), F.struct("least", "fp")))
    least = joined.groupBy("root").agg(first.alias("first"), F.count("*").alias("members")).select("root", F.col("first.least").alias("component_id"), F.col("first.fp").alias("keeper"), "members")
    placed = join_counted(joined, least, ["root"], "members", joined.count())
    return placed.select("fp", "n", (F.col("n") - 1 + F.col("links")).alias("n_near"), "component_id", "keeper")


def _linked(docs: DataFrame, id_col: str, text_col: str, radius: int, max_bucket: int) -> DataFrame:
    """One row per row of ``docs``: doc_id and the columns of ``link``."""
    with Scratch(docs.sparkSession) as scratch:
        fps = scratch.keep(fingerprint_table(docs, id_col, text_col), "fps")
        classes = scratch.keep(link(fps, scratch, radius, max_bucket), "near")
        scratch.only(fps, classes)
    return join_counted(fps, classes, ["fp"], "n", fps.count())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint, n_near, component_id, kept (the component's smallest id)."""
    rows = _linked(docs, id_col, text_col, radius, max_bucket)
    return rows.select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "n_near", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


#: Ids with a text's hash and length that are broadcast to drop their rows (20 bytes each); more are dropped by a shuffle.
BROADCAST_IDS = 1_000_000


def keep_one(docs: DataFrame, radius: int = RADIUS, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """``docs`` with one document of each component: that of the smallest doc_id.

    Rows are told apart by id, hash and length of the text, so an id that occurs with different texts loses only the copies among
    them; where several texts of the kept id lie in one component, that of the smallest fingerprint stays. Rows with
    a null id can't be told apart and stay; of repeated rows of the kept id and fingerprint all stay.
    """
    with Scratch(docs.sparkSession) as scratch:
        kept = (F.col("doc_id") == F.col("component_id")) & (F.col("fp") == F.col("keeper"))
        gone = _linked(docs, "doc_id", "text", radius, MAX_BUCKET).where(~kept & F.col("doc_id").isNotNull())
        drop = scratch.keep(gone.select(F.col("doc_id").alias("__id"), F.col("h").alias("__h"), F.col("size").alias("__size")).distinct(), "drop")
        small = drop.count() <= broadcast_ids
        # the fingerprint follows from the text, so a text that goes is known by its hash: it isn't taken again
        h, size = _text_hash(docs, "text")
        named = docs.select(*[docs[c].alias(k) for k, c in carry(docs).items()], docs["doc_id"].alias("__id"), h.alias("__h"), size.alias("__size"))
        left = named.join(F.broadcast(drop) if small else drop, ["__id", "__h", "__size"], "left_anti")
    return restore(left, docs)
