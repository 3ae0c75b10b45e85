"""Quality: measures one text at a time, posteriors in plain Python, held-out accuracy."""

from __future__ import annotations

import math
import random
from collections import defaultdict

import numpy as np
import pytest

from sparkdoc.llm import quality as q
from sparkdoc.llm._text import as_bytes


def prose(rng: random.Random, bad: bool) -> str:
    words = ["".join(rng.choices("aeioulnrst", k=rng.randrange(2, 9))) for _ in range(rng.randrange(10, 120))]
    if bad:
        kind = rng.randrange(3)
        words = [w + "***" for w in words] if kind == 0 else [w.upper() + "!!" for w in words] if kind == 1 else [w for w in words[:9] for _ in range(9)]
    return " ".join(words)


def rows(n: int, seed: int) -> list[tuple]:
    rng, out = random.Random(seed), []
    for i in range(n):
        host = "hot" if rng.random() < 0.4 else f"h{rng.randrange(15)}"
        bad = rng.random() < (0.7 if host in ("h1", "h2") else 0.15)
        out.append((i, prose(rng, bad), host, rng.choice(["a", "b", None]), int(not bad)))
    return out


SCHEMA = "doc_id long, text string, source string, lang string, quality long"


def test_measures():
    text = "Ab ab AB! x1 x1 %%%\n" + "y" * 30 + " | end."
    m = dict(zip(q.MEASURES, q.measures(*as_bytes([None, text, ""]))[1], strict=True))
    n, size = 9, len(text)
    assert m["log words"] == pytest.approx(math.log2(10)) and m["upper"] == pytest.approx(3 / size) and m["digits"] == pytest.approx(2 / size)
    assert m["repeated neighbours"] == pytest.approx(2 / n) and m["distinct words"] == pytest.approx(7 / n**0.9) and m["commonest word"] == pytest.approx(2 / n)
    assert m["bars"] == pytest.approx(1 / size) and m["long words"] == pytest.approx(1 / n) and m["word with symbols"] == pytest.approx(1 / n) and m["stops"] == pytest.approx(1 / n)
    assert not q.measures(*as_bytes([None, ""])).any()


def test_held_out_accuracy():
    data = rows(600, 1)
    model = q.fit([r[1] for r in data], np.array([r[4] for r in data]))
    test = rows(300, 2)
    p = model.evidence(*as_bytes([r[1] for r in test]))
    assert np.mean((p >= 0.5) == np.array([r[4] for r in test], bool)) > 0.98


def test_posteriors_match_plain_python(spark):
    data = [*rows(400, 3), (900, None, None, None, 1), (901, "", None, "a", 1), (None, "some words of nobody", "h3", "b", 1), (902, "w " * 20000, "hot", "a", 1)]
    docs = spark.createDataFrame(data, SCHEMA)
    model = q.fit([r[1] for r in data[:200]], np.array([r[4] for r in data[:200]]))
    got = sorted(q.score(docs, model).collect(), key=lambda r: (str(r.doc_id), r.evidence))
    assert len(got) == len(data)
    e = {r[0]: float(x) for r, x in zip(data, model.evidence(*as_bytes([r[1] for r in data])), strict=True)}
    by_path, by_host = defaultdict(list), defaultdict(list)
    for r in data:
        by_path[r[2], r[3]].append(e[r[0]])
        by_host[r[2]].append(e[r[0]])
    mean = sum(e.values()) / len(e)

    def strength(groups: list[tuple[list[float], float]]) -> float:
        n, g = sum(len(x) for x, _ in groups), len(groups)
        spread = sum(max(0.0, sum(v * v for v in x) - sum(x) ** 2 / len(x)) for x, _ in groups) / n
        between = max(sum(len(x) * (sum(x) / len(x) - m) ** 2 for x, m in groups) - g * spread, 0) / n
        return min(max(spread / between if between > 0 else 1e4, 1.0), 1e4)

    k_host = strength([(x, mean) for x in by_host.values()])
    k_path = strength([(x, (sum(by_host[h]) + k_host * mean) / (len(by_host[h]) + k_host)) for (h, _), x in by_path.items()])
    logit = lambda p: math.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
    for r in got:
        x, host, path = e[r.doc_id], by_host[r.host], by_path[r.host, r.path]
        h = (sum(host) - x + k_host * mean) / (len(host) - 1 + k_host)
        p = (sum(path) - x + k_path * h) / (len(path) - 1 + k_path)
        want = 1 / (1 + math.exp(-(logit(x) + q.SITE * (logit(p) - logit(mean)))))
        assert (r.evidence, r.host_posterior, r.path_posterior, r.quality) == pytest.approx((x, h, p, want), abs=1e-6)


def test_edges(spark):
    docs = spark.createDataFrame(rows(30, 5), SCHEMA)
    labels = spark.createDataFrame([(1, 1), (None, 1), (2, None)], "doc_id long, quality long")
    assert q.classify(docs, labels).count() == 30
    assert q.classify(docs, labels.limit(0)).count() == 30
    assert q.classify(docs.limit(0), labels).count() == 0
