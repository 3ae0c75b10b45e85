"""Best-fit decreasing against one group at a time, and the laws of the shards."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import pytest

from sparkdoc.llm import sharding as s
from sparkdoc.llm._spark import carry


def test_tree_is_a_balanced_search_tree():
    rng, tree, keys = random.Random(1), s.CapacityTree(), set()
    depth = lambda n: 1 + max(depth(n[1]), depth(n[2])) if n else 0
    for step in range(4000):
        if keys and rng.random() < 0.45:
            k = rng.choice(sorted(keys))
            keys.discard(k)
            tree.remove(k)
        else:
            k = (rng.randrange(50), step)
            keys.add(k)
            tree.add(k)
        if step % 50 == 0:
            size = rng.randrange(60)
            assert tree.tightest(size) == min((k for k in keys if k[0] >= size), default=None)
            assert depth(tree.root) <= 1.45 * max(1, len(keys)).bit_length() + 1


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_one_by_one(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([1, 2, 3, 7, 7, 20, 33, rng.randrange(1, 60)]) for _ in range(500)]
    count = Counter(sizes)
    falling = sorted(count, reverse=True)
    packing = s.best_fit(falling, [count[x] for x in falling], 100)
    want = s.naive(sizes, 100)
    got = [packing.bin[i] for i, a in enumerate(packing.start) for _ in range((packing.start[i + 1] if i + 1 < len(packing.start) else len(sizes)) - a)]
    assert got == want and packing.bins == max(want) + 1


def rows() -> list[tuple]:
    rng = random.Random(4)
    out = [(i, "é" * rng.randrange(0, 40) + "x" * rng.randrange(0, 200), "s") for i in range(600)]
    out += [(1000 + i, "copy", "t") for i in range(150)] + [(2000, None, "n"), (2001, "", None), (None, "nobody", "z"), (3000, "repeated", "q"), (3000, "repeated", "q")]
    return out


def test_shards(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, shard string")
    got = s.shard(docs).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows())
    text = {r[0]: r[1] or "" for r in rows()}
    groups, load, slots = defaultdict(set), Counter(), defaultdict(list)
    for r in got:
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(text[r.doc_id].encode()) + 1, zlib.crc32(text[r.doc_id].encode()), "bytes", None)
        groups[text[r.doc_id]].add(r.shard)
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(len(g) == 1 for g in groups.values())
    assert set(load) == set(range(8)) and max(load.values()) - min(load.values()) <= 0.01 * sum(load.values())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_hot_group_has_a_shard_of_its_own(spark):
    docs = spark.createDataFrame([(i, "h" * 50 if i % 3 == 0 else f"{i:050d}") for i in range(900)], "doc_id long, text string")
    got = s.shard(docs).collect()
    load = Counter()
    for r in got:
        load[r.shard] += r.size
    hot = {r.shard for r in got if r.doc_id % 3 == 0}
    assert len(hot) == 1 and all(r.doc_id % 3 == 0 for r in got if r.shard in hot)
    rest = [load[x] for x in range(8) if x not in hot]
    assert max(rest) - min(rest) <= 2 * 51


def test_capacity_and_edges(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, shard string")
    got = s.shard(docs, capacity=1000).collect()
    load, groups = Counter(), defaultdict(int)
    for r in got:
        load[r.shard] += r.size
    for r in rows():
        groups[r[1] or ""] += len((r[1] or "").encode()) + 1
    limit = max(1000, *groups.values())
    assert max(load.values()) <= limit and len(load) == max(s.naive(list(groups.values()), limit)) + 1
    assert s.shard(docs.limit(0)).count() == 0
    out = s.assign(docs)
    assert out.columns == ["doc_id", "text", "shard", "slot"] and out.count() == len(rows())
    assert set(carry(docs)) == {"__c0", "__c1", "__c2"}
    few = s.shard(docs.limit(3))
    assert few.count() == 3
