"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Rows of equal text form a group that never parts. Groups enter the bins from the largest to the
smallest, each the bin of the tightest remaining capacity that still holds it, found in a balanced
tree of remaining capacities. With a capacity, as few bins as best fit needs are opened. With a
number of shards, the capacity is the smallest (by bisection) at which best fit needs no more; a
group beyond an even share gets a shard of its own and the rest is packed over the others.

Only sizes decide, so the driver packs runs of equal sizes: it holds one number for each distinct
size, at most the square root of twice the total bytes, whatever the number of rows. Groups of one
size are told apart by their place in the order of (size, digest), which range-sorted partitions
count for themselves; a bin takes a range of places. Hot groups are aggregated before they are
shuffled, and rows meet their group's bin in a join that broadcasts the few hot ones.

Sizes are UTF-8 bytes plus 1. A null text is as an empty one: size 1, CRC 0, one group with empty
texts. Null and repeated ids each keep a row and a slot of their own. An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkdoc.llm._spark import BULK, Scratch, apart, carry, join_counted


class CapacityTree:
    """Balanced (AVL) tree of (remaining, bin), for the tightest bin that holds a size."""

    __slots__ = ("root",)

    def __init__(self) -> None:
        self.root: list | None = None  # [key, left, right, height]

    def add(self, key: tuple[int, int]) -> None:
        self.root = self._add(self.root, key)

    def remove(self, key: tuple[int, int]) -> None:
        self.root = self._remove(self.root, key)

    def tightest(self, size: int) -> tuple[int, int] | None:
        """The least (remaining, bin) with remaining >= size."""
        node, best, want = self.root, None, (size, -1)
        while node:
            if node[0] >= want:
                best, node = node[0], node[1]
            else:
                node = node[2]
        return best

    @staticmethod
    def _height(node: list | None) -> int:
        return node[3] if node else 0

    def _balance(self, node: list) -> list:
        lean = self._height(node[1]) - self._height(node[2])
        if lean > 1:
            if self._height(node[1][1]) < self._height(node[1][2]):
                node[1] = self._turn(node[1], 1)
            return self._turn(node, 2)
        if lean < -1:
            if self._height(node[2][2]) < self._height(node[2][1]):
                node[2] = self._turn(node[2], 2)
            return self._turn(node, 1)
        node[3] = 1 + max(self._height(node[1]), self._height(node[2]))
        return node

    def _turn(self, node: list, way: int) -> list:
        """Rotate left (way 1) or right (way 2)."""
        up = node[3 - way]
        node[3 - way], up[way] = up[way], node
        node[3] = 1 + max(self._height(node[1]), self._height(node[2]))
        up[3] = 1 + max(self._height(up[1]), self._height(up[2]))
        return up

    def _add(self, node: list | None, key: tuple[int, int]) -> list:
        if node is None:
            return [key, None, None, 1]
        side = 1 if key < node[0] else 2
        node[side] = self._add(node[side], key)
        return self._balance(node)

    def _remove(self, node: list | None, key: tuple[int, int]) -> list | None:
        if node is None:
            return None
        if key != node[0]:
            side = 1 if key < node[0] else 2
            node[side] = self._remove(node[side], key)
        elif node[1] is None or node[2] is None:
            return node[1] or node[2]
        else:
            heir = node[2]
            while heir[1]:
                heir = heir[1]
            node[0] = heir[0]
            node[2] = self._remove(node[2], heir[0])
        return self._balance(node)


@dataclass
class Packing:
    """Runs of equal groups: from place ``start`` (groups in falling size) to the next run's, into ``bin``."""

    start: list[int]
    bin: list[int]
    bins: int


def best_fit(sizes: list[int], counts: list[int], capacity: int, most: int | None = None) -> Packing | None:
    """Best-fit decreasing of ``counts[i]`` groups of ``sizes[i]`` (falling); None if more than ``most`` bins are needed.

    The bin that takes a group stays the tightest for the next of that size, so a run enters at once.
    """
    tree, used, place, start, into = CapacityTree(), 0, 0, [], []
    for size, count in zip(sizes, counts, strict=True):
        if size > capacity:
            return None
        while count:
            found = tree.tightest(size)
            if found is None:
                if used == most:
                    return None
                found = (capacity, used)
                used += 1
            else:
                tree.remove(found)
            room, b = found
            n = min(count, room // size)
            start.append(place)
            into.append(b)
            place, count = place + n, count - n
            tree.add((room - n * size, b))
    return Packing(start, into, used)


def pack(sizes: list[int], counts: list[int], shards: int) -> Packing:
    """Pack falling sizes into ``shards`` bins of the least capacity that best fit manages."""
    total, own, sizes, counts = sum(s * c for s, c in zip(sizes, counts, strict=True)), 0, list(sizes), list(counts)
    while sizes and own < shards - 1 and sizes[0] * (shards - own) > total:  # beyond an even share of what is left
        total, own, counts[0] = total - sizes[0], own + 1, counts[0] - 1
        if not counts[0]:
            sizes, counts = sizes[1:], counts[1:]
    left = shards - own
    packing = Packing([], [], 0)
    if sizes:
        low = max(sizes[0], -(-total // left))
        high = total // left + sizes[0]  # best fit can't fail here: a bin that refuses is fuller than the mean
        packing = best_fit(sizes, counts, high, left)
        while low < high:
            middle = (low + high) // 2
            if tried := best_fit(sizes, counts, middle, left):
                packing, high = tried, middle
            else:
                low = middle + 1
    return Packing([*range(own), *(p + own for p in packing.start)], [*range(own), *(b + own for b in packing.bin)], shards)


def _number(rows: DataFrame, scratch: Scratch, by: list[str], tag: str) -> tuple[DataFrame, dict[int, int]]:
    """Range-sort by ``by`` and write with the partition (pid) and the place in it (idx); and the rows before each partition."""
    ordered = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    written = scratch.keep(ordered.mapInArrow(_places, _place_schema(rows)), tag)
    sizes = dict(written.groupBy("pid").count().collect())  # one row a partition
    before, done = {}, 0
    for pid in sorted(sizes):
        before[pid] = done
        done += sizes[pid]
    return written, before


def _place_schema(rows: DataFrame):
    from pyspark.sql import types as T

    return T.StructType([*rows.schema.fields, T.StructField("pid", T.IntegerType()), T.StructField("idx", T.LongType())])


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    pid, done = TaskContext.get().partitionId(), 0
    for b in batches:
        n = b.num_rows
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(n, pid, np.int32)), pa.array(np.arange(done, done + n))], names=[*b.schema.names, "pid", "idx"])
        done += n


def shard(docs: DataFrame, shards: int = 8, capacity: int | None = None, id_col: str = "doc_id", text_col: str = "text", carried: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard, group_rows; all columns of ``docs`` too if ``carried`` (under the names of ``carry``)."""
    with Scratch(docs.sparkSession) as scratch:
        text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
        keep = [docs[c].alias(k) for k, c in carry(docs).items()] if carried else []
        rows = docs.select(docs[id_col].alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.md5(text)).alias("digest"), *keep)
        narrow = rows if carried else scratch.keep(rows, "rows")
        groups, before = _number(narrow.groupBy("size", "digest").agg(F.count("*").alias("n")).withColumn("weight", F.col("size") * F.col("n")).select("weight", "digest", "size", "n"), scratch, ["weight", "digest"], "groups")
        histogram = groups.groupBy("weight").count().orderBy(F.desc("weight")).collect()  # one row for each distinct weight
        sizes, counts = [r[0] for r in histogram], [r[1] for r in histogram]
        total_groups = sum(counts)
        if capacity is None:
            packing = pack(sizes, counts, shards)
        else:
            packing = best_fit(sizes, counts, max([capacity, *sizes[:1]]))
        start, into = np.array(packing.start, np.int64), np.array(packing.bin, np.int32)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                pid, idx = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
                falling = total_groups - 1 - (np.array([before[p] for p in pid.tolist()], np.int64) + idx)
                chosen = into[np.searchsorted(start, falling, side="right") - 1]
                yield pa.RecordBatch.from_arrays([b.column(2), b.column(3), pa.array(chosen)], names=["digest", "n", "shard"])

        placed = scratch.keep(groups.select("pid", "idx", "digest", "n").mapInArrow(place, "digest binary, n long, shard int"), "placed")
        total = placed.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        if not carried:
            return _slots(join_counted(narrow, placed, ["digest"], "n", total).drop("digest").withColumnRenamed("n", "group_rows"), scratch)
        bulky = groups.where((F.col("n") > 1) & (F.col("weight") > BULK))
        far = bulky.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
        if far:  # equal long texts; at most one group for each BULK bytes of the input
            apart_from = F.broadcast(bulky.select("digest"))
            rest = join_counted(narrow.join(apart_from, "digest", "left_anti"), placed.join(apart_from, "digest", "left_anti"), ["digest"], "n", total)
            joined = rest.unionByName(apart(narrow.join(F.broadcast(placed.join(apart_from, "digest")), "digest"), far))
        else:
            joined = join_counted(narrow, placed, ["digest"], "n", total)
        return _slots(joined.drop("digest").withColumnRenamed("n", "group_rows"), scratch, far)


def _slots(rows: DataFrame, scratch: Scratch, far: int = 0) -> DataFrame:
    """Number the rows of each shard from 0: each task counts its own, then offsets by (task, shard) are added. ``far``: bytes of rows that are kept apart."""
    from pyspark.sql import types as T

    at = rows.columns.index("shard")
    schema = T.StructType([*rows.schema.fields, T.StructField("pid", T.IntegerType()), T.StructField("idx", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid, seen = TaskContext.get().partitionId(), {}
        for b in batches:
            shard = b.column(at).to_numpy(zero_copy_only=False)
            idx = np.empty(len(shard), np.int64)
            for s in np.unique(shard).tolist():
                m = np.flatnonzero(shard == s)
                idx[m] = seen.get(s, 0) + np.arange(len(m))
                seen[s] = seen.get(s, 0) + len(m)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(shard), pid, np.int32)), pa.array(idx)], names=schema.names)

    written = scratch.keep(rows.mapInArrow(count, schema), "sharded")
    scratch.only(written)
    sizes = written.groupBy("shard", "pid").count().withColumnRenamed("count", "rows_here")
    from pyspark.sql import Window

    before = F.sum("rows_here").over(Window.partitionBy("shard").orderBy("pid")) - F.col("rows_here")
    offsets = sizes.select("shard", "pid", before.alias("before"))  # shards times tasks: no more than that
    bulky = (F.col("group_rows") > 1) & (F.col("size") * F.col("group_rows") > BULK)
    spread = written.where(~bulky).unionByName(apart(written.where(bulky), far)) if far else written
    joined = spread.join(F.broadcast(offsets), ["shard", "pid"])
    kept = [c for c in rows.columns if c.startswith("__c")]
    return joined.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("idx")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "group_rows", *kept)


def assign(docs: DataFrame, shards: int = 8) -> DataFrame:
    """``docs`` with columns shard and slot after its own (which they replace if ``docs`` has such columns)."""
    sharded = shard(docs, shards, carried=True)
    own = [F.col(k).alias(c) for k, c in carry(docs).items() if c not in ("shard", "slot")]
    return sharded.select(*own, "shard", "slot")


def naive(sizes: list[int], capacity: int) -> list[int]:
    """Best-fit decreasing one group at a time over a sorted list: what tests compare with."""
    rooms: list[tuple[int, int]] = []
    into, used = [], 0
    for size in sorted(sizes, reverse=True):
        at = bisect_left(rooms, (size, -1))
        room, b = rooms.pop(at) if at < len(rooms) else (capacity, used)
        used += b == used
        into.append(b)
        rooms.insert(bisect_left(rooms, (room - size, b)), (room - size, b))
    return into
