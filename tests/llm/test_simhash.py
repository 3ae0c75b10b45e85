"""SimHash against fingerprints and links made one by one."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from sparkdoc.llm import simhash
from sparkdoc.llm._spark import Scratch, components
from sparkdoc.llm._text import as_bytes


def fingerprint(text: str | None) -> int:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    shingles = [" ".join(words[i : i + 2]) for i in range(len(words) - 1)] or ([words[0]] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(fps: list[int]) -> tuple[list[int], list[int]]:
    near = [[j for j in range(len(fps)) if j != i and (fps[i] ^ fps[j]).bit_count() <= 6] for i in range(len(fps))]
    root = list(range(len(fps)))
    for i in range(len(fps)):
        todo, seen = [i], {i}
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        root[i] = min(seen)
    return [len(x) for x in near], root


def test_fingerprints():
    texts = [None, "", " \n", "One", "A b", "a a a", "é\x85x \xa0y", "x" * 100 + " " + "y" * 40, "z", "w " * 5000, *(" ".join(random.Random(i).choices("ab cd ef É gh".split(), k=i)) for i in range(300))]
    assert [int(x) for x in simhash.fingerprints(*as_bytes(texts))] == [fingerprint(t) for t in texts]


def test_bucket_kinds():
    """Every pair within the radius shares the bits of some kind; few kinds do while fingerprints are few."""
    assert [simhash.shared_blocks(n, 6, simhash.MAX_BUCKET) for n in (0, 4_000_000, 5_000_000, 5 * 10**8, 10**10)] == [1, 1, 2, 2, 3]
    rng = random.Random(1)
    for blocks, kinds in ((1, 7), (2, 28), (3, 84)):
        paths = simhash._Paths(6, blocks)
        made = paths.children(0)
        assert len(made) == kinds and min(paths.mask[k].bit_count() for k in made) >= {1: 9, 2: 16, 3: 21}[blocks]
        for _ in range(200):
            x = sum(1 << b for b in rng.sample(range(64), 6))
            shared = [k for k in made if not x & paths.mask[k]]
            assert shared and [k for k in shared if all(x & m for m in paths.earlier[k])] == shared[:1]


@pytest.mark.parametrize(("max_bucket", "blocks"), [(simhash.MAX_BUCKET, None), (20, None), (simhash.MAX_BUCKET, 2), (simhash.MAX_BUCKET, 3)])
def test_links_match_brute_force(spark, max_bucket, blocks):
    rng = random.Random(3)
    fps = [rng.getrandbits(64) for _ in range(40)]
    for _ in range(300):
        x = rng.choice(fps)
        for b in rng.sample(range(64), rng.choice([0, 1, 4, 6, 7])):
            x ^= 1 << b
        fps.append(x)
    fps += [0] * 5 + [63] * 3
    rows = [(i, int(np.uint64(x).view(np.int64))) for i, x in enumerate(fps)]
    scratch = Scratch(spark)
    table = scratch.keep(spark.createDataFrame(rows, "doc_id long, fp long"), "fps")
    classes = simhash.link(table, scratch, max_bucket=max_bucket, blocks=blocks)
    got = {r.doc_id: (r.n_near, r.component_id) for r in table.join(classes, "fp").collect()}
    near, root = brute(fps)
    assert got == {i: (near[i], root[i]) for i in range(len(fps))}


def test_whole_operator(spark):
    base = " ".join(f"w{i}" for i in range(200))
    rows = [(5, base, "a"), (3, base.upper(), "b"), (9, base + " end", "c"), (1, None, None), (2, "", "x"), (7, "other words here", "y"), (None, "nobody's text at all", "z"), (7, "other words here", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted(((r.doc_id, r.fingerprint, r.n_near, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    near, _ = brute([fingerprint(r[1]) for r in rows])
    want = sorted(((r[0], f"{fingerprint(r[1]):016x}", near[i], {5: 3, 3: 3, 9: 3, 1: 1, 2: 1, 7: 7, None: None}[r[0]]) for i, r in enumerate(rows)), key=str)
    assert got == want
    kept = sorted(str(r.doc_id) for r in simhash.keep_one(docs).collect())
    assert kept == ["1", "3", "7", "7", "None"]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("broadcast_ids", [simhash.BROADCAST_IDS, 0])
def test_an_id_with_different_texts_loses_only_the_copies(spark, broadcast_ids):
    base = " ".join(f"w{i}" for i in range(200))
    alone, again = " ".join(f"x{i}" for i in range(90)), " ".join(f"y{i}" for i in range(200))
    rows = [(1, base), (2, base), (2, alone), (3, again), (3, again + " end"), (4, again), (None, base), (None, again)]
    assert 0 < (fingerprint(rows[3][1]) ^ fingerprint(rows[4][1])).bit_count() <= 6
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one = min((again, again + " end"), key=lambda t: int(np.uint64(fingerprint(t)).view(np.int64)))
    got = simhash.keep_one(docs, broadcast_ids=broadcast_ids)
    assert got.columns == docs.columns
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [(1, base), (2, alone), (3, one), (None, base), (None, again)]))


@pytest.mark.parametrize("local_edges", [10**6, 0])
def test_components(spark, local_edges):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(120)] + [(400, 400 + i) for i in range(50)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark), local_edges).collect()}
    root = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in range(400):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == root
