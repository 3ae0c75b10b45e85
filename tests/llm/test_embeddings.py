"""Embedding links against all cosines."""

from __future__ import annotations

import numpy as np
import pytest

from sparkdoc.llm import embeddings as e


def rows(seed: int = 1) -> list[tuple]:
    rng = np.random.default_rng(seed)
    out, i = [], 0
    for label in (1, 2):
        for _ in range(25):
            base = rng.normal(size=8)
            for _ in range(rng.integers(1, 6)):
                noise = rng.normal(size=8) * rng.choice([0.0, 0.1, 0.25])
                out.append((i, (base + noise).tolist(), label, 0))
                i += 1
    out += [(1000 + k, out[0][1], 1, 0) for k in range(40)]
    out += [(2000, None, 1, 0), (2001, [0.0] * 8, 1, 0), (2002, [1.0, None] * 4, 1, 0), (2003, [float("nan")] * 8, 1, 0), (2004, [float("inf")] * 8, 1, 0), (2005, [], 1, 0)]
    out += [(2006, out[0][1], None, 0), (2007, out[0][1], None, 0), (2008, [1.0, 0.0], 1, 0), (2009, [2.0, -0.0], 1, 0), (2010, [1e200] * 8, 2, 0), (2011, [1e-200] * 8, 2, 0), (None, out[3][1], out[3][2], 0), (5, out[5][1], out[5][2], 0)]
    return out


def brute(data: list[tuple], threshold: float = 0.93) -> list[tuple]:
    def sound(r):
        return r[1] and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])

    def unit(x):
        x = np.array(x) / np.abs(x).max()
        return x / np.linalg.norm(x)

    n = len(data)
    near = [[] for _ in data]
    for i in range(n):
        for j in range(i):
            a, b = data[i], data[j]
            if sound(a) and sound(b) and a[2] == b[2] and len(a[1]) == len(b[1]) and unit(a[1]) @ unit(b[1]) >= threshold:
                near[i].append(j)
                near[j].append(i)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least = min((data[j][0] for j in seen if data[j][0] is not None), default=None)
        out.append((data[i][0], len(near[i]), least))
    return out


@pytest.mark.parametrize("interval", [4096, 16])
def test_matches_all_cosines(spark, interval):
    data = rows()
    table = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int, v int").repartition(3)
    got = e.near_duplicates(table, interval=interval).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == sorted(brute(data), key=str)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)


def test_recursion_skips_only_what_is_far():
    rng = np.random.default_rng(2)
    x = e.unit(np.concatenate([rng.normal(size=(300, 3)), rng.normal(size=(300, 3)) * 0.05 + 1]).ravel(), 3)
    p = x @ e.rotation(x, 2)
    order = np.lexsort((p[:, 1], p[:, 0]))
    x, p = x[order], p[order]
    for threshold in (0.93, 0.999, 0.2):
        got = {(i, j) for a, b in e.join_intervals(x, p, x, p, True, threshold, leaf=16) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
        want = {(i, j) for i, j in zip(*np.nonzero(np.triu(x @ x.T >= threshold, 1)), strict=True)}
        assert got == want
        y, q = x[:250], p[:250]
        got = {(i, j) for a, b in e.join_intervals(x, p, y, q, False, threshold, leaf=16) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
        assert got == set(zip(*np.nonzero(x @ y.T >= threshold), strict=True))


def test_ties_are_decided_by_exact_sums():
    """Parallel vectors have a cosine of 1, whatever the product of their rounded units is."""
    a = np.array([[0.1, 0.2, 0.3], [1 / 3, 1 / 7, 0.9], [0.7, 0.1, 0.9]])
    x, y, none = e.unit(a.ravel(), 3), e.unit((a * 3).ravel(), 3), np.zeros((3, 0))
    exact = lambda i, j: e.exact_cosine(a[i], 3 * a[j])
    assert {(int(i), int(j)) for u, v in e.join_intervals(x, none, y, none, False, 1.0, exact=lambda i, j: float(i == j)) for i, j in zip(u, v, strict=True)} == {(0, 0), (1, 1), (2, 2)}
    assert all(abs(exact(k, k) - 1) <= 2.3e-16 for k in range(3))
    assert not list(e.join_intervals(x, none, y, none, False, 1.0, exact=lambda i, j: 0.0))
    f = np.array([3.0, 4.0], np.float32)
    assert e.exact_cosine(f, np.array([1.0, 0.0], np.float32)) == 0.6 and e.exact_cosine(np.array([1e200, 0.0]), np.array([1e200, 1e-200])) == 1


def test_rows_go_only_to_near_intervals():
    """Copies of a vector: none in a table of far clusters, and no more as it grows, while intervals are few."""
    assert e.interval_rows(1000, 64) == e.interval_rows(100_000, 64) == 4096 and e.interval_rows(500_000, 64) == 15_625 and e.interval_rows(10**8, 64) == 32_768 and e.interval_rows(10**8, 4096) == 2048
    box = lambda k, first, lo, hi: {"pid": k, "first": first, "last": first, "lo": np.array(lo), "hi": np.array(hi)}
    meta = [box(0, ("a", 3), [0.0, 0.0], [1.0, 1.0]), box(1, ("a", 3), [1.2, 0.0], [2.0, 1.0]), box(2, ("a", 3), [1.5, 0.0], [2.0, 1.0]), box(3, ("b", 3), [0.0, 0.0], [1.0, 1.0])]
    assert [e.near_intervals(meta, k, 0.4) for k in range(4)] == [[1], [0, 2], [1], []]
    meta.append(meta.pop() | {"last": ("c", 9)})
    assert e.near_intervals(meta, 3, 0.4) == []


def test_empty(spark):
    table = spark.createDataFrame(rows(), "vec_id long, embedding array<double>, label int, v int")
    assert e.near_duplicates(table.limit(0)).count() == 0
    assert e.near_duplicates(table.where("embedding is null")).count() == 1
