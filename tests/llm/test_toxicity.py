"""Ordinal regression: gradient against differences, held-out severity, and odd inputs."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import xxhash

from sparkdoc.llm import toxicity as t
from sparkdoc.llm._text import as_bytes
from sparkdoc.llm.classify import Sparse, screen

CLEAN = [f"plain{i}" for i in range(80)]
MILD = ["drat", "bother", "twit"]
HARSH = ["vilest", "foulness", "filthiest"]


def sample(n: int, seed: int) -> tuple[list[str], np.ndarray]:
    rng, texts, grades = random.Random(seed), [], []
    for _ in range(n):
        g = rng.choice([0, 0, 0, 1, 2])
        words = rng.choices(CLEAN, k=rng.randrange(5, 120))
        words += rng.choices(MILD, k=2) if g == 1 else rng.choices(HARSH, k=3) if g == 2 else []
        rng.shuffle(words)
        texts.append(" ".join(words))
        grades.append(g)
    return texts, np.array(grades)


def plain_loss(rows: list[dict[int, float]], grades: list[int], p: list[float], columns: int, ridge: float) -> float:
    """Mean negative log likelihood, one text at a time."""
    cuts = [p[columns]]
    for gap in p[columns + 1 :]:
        cuts.append(cuts[-1] + math.exp(gap))
    above = lambda score, k: 1.0 if k < 0 else 0.0 if k == len(cuts) else 1 / (1 + math.exp(cuts[k] - score))
    total = 0.0
    for row, g in zip(rows, grades, strict=True):
        score = sum(v * p[c] for c, v in row.items())
        total -= math.log(above(score, g - 1) - above(score, g))
    return total / len(rows) + ridge / 2 * sum(x * x for x in p[:columns])


def small(seed: int) -> tuple[list[dict[int, float]], list[int], Sparse]:
    rng = random.Random(seed)
    grades = [rng.choice([0, 0, 1, 2, 3]) for _ in range(60)]
    rows = [{c: rng.random() + (c == 0) * g for c in rng.sample(range(5), 3)} for g in grades]
    cells = [(i, c, v) for i, r in enumerate(rows) for c, v in r.items()]
    return rows, grades, Sparse(*(np.array(x) for x in zip(*cells, strict=True)), len(rows))


def test_gradient_against_differences():
    rows, grades, x = small(6)
    rng = random.Random(7)
    for _ in range(5):
        p = [rng.gauss(0, 0.5) for _ in range(8)]
        got = t.gradient_of(x, np.array(grades), 5, 0.01)(np.array(p))
        for k in range(8):
            up, down = ([v + (i == k) * d for i, v in enumerate(p)] for d in (1e-6, -1e-6))
            assert abs(got[k] - (plain_loss(rows, grades, up, 5, 0.01) - plain_loss(rows, grades, down, 5, 0.01)) / 2e-6) < 1e-6


def test_fit_against_a_plain_descent():
    """Coordinate search from the other end finds nothing better than the fit."""
    rows, grades, x = small(8)
    w, cuts = t._fit(x, np.array(grades), 5, 0.01)
    fitted = [*w, cuts[0], *np.log(np.diff(cuts))]
    p, step = [0.0] * 8, 0.5
    best = plain_loss(rows, grades, p, 5, 0.01)
    while step > 1e-4:
        moved = False
        for k in range(8):
            for d in (step, -step):
                tried = [v + (i == k) * d for i, v in enumerate(p)]
                if (loss := plain_loss(rows, grades, tried, 5, 0.01)) < best:
                    p, best, moved = tried, loss, True
        step = step if moved else step / 2
    assert plain_loss(rows, grades, fitted, 5, 0.01) < best + 1e-4 and np.allclose(fitted[:5], p[:5], atol=0.1)


def test_query_against_plain_scores(spark):
    """The scores of the query, word by word in Python; and the executors' vocabulary beside the one of a list."""
    texts, grades = sample(300, 9)
    texts += ["Vilest VILEST foulness, filthiest-twit bother", "", "plain1"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(g > 0)) for i, g in enumerate(grades)], "doc_id long, toxic int")
    model = t.train(docs, labels)
    assert np.array_equal(model.vocabulary, screen(texts[:300], grades > 0, t.WORDS, prefixes=t.PREFIXES))
    local = t.fit(texts[:300], (grades > 0).astype(int), split=True)
    assert np.allclose(np.sort(local.weights), np.sort(model.weights), atol=1e-3) and np.allclose(local.thresholds, model.thresholds, atol=1e-3)
    weight = dict(zip(model.vocabulary.tolist(), model.weights.tolist(), strict=True))
    for r in t.toxicity(docs, labels).collect():
        seen = Counter()
        for word in re.findall(rb"[0-9a-z\x80-\xff]+", texts[r.doc_id].lower().encode()):
            seen[xxhash.xxh64_intdigest(word, seed=42)] += 1
            seen.update(xxhash.xxh64_intdigest(word[:k], seed=1000 + k) for k in t.PREFIXES if len(word) > k)
        score = sum(math.log2(1 + n) * weight.get(h, 0.0) for h, n in seen.items())
        above = [1 / (1 + math.exp(c - score)) for c in model.thresholds]
        assert abs(r.p_toxic - above[0]) < 1e-9 and abs(r.expected_severity - sum(above)) < 1e-9 and r.toxic == (above[0] >= t.REJECT)
        likely = [a - b for a, b in zip([1, *above], [*above, 0], strict=True)]
        assert likely[r.grade] == max(likely)


def test_held_out_grades():
    model = t.fit(*sample(800, 1))
    texts, grades = sample(400, 2)
    above = model.above(model.scores(*as_bytes(texts)))
    assert ((above[:, 0] >= 0.5) == (grades > 0)).mean() > 0.98
    assert np.corrcoef(above.sum(axis=1), grades)[0, 1] > 0.9
    assert np.all(np.diff(model.thresholds) > 0)


def test_flag_is_split_into_grades():
    texts, grades = sample(800, 3)
    model = t.fit(texts, (grades > 0).astype(int), split=True)
    assert len(model.thresholds) == 2
    texts, grades = sample(300, 4)
    above = model.above(model.scores(*as_bytes(texts)))
    assert ((above[:, 0] >= t.REJECT) == (grades > 0)).mean() > 0.98


def test_query_on_odd_rows(spark):
    texts, grades = sample(300, 5)
    docs = spark.createDataFrame([(i, x, "c") for i, x in enumerate(texts)] + [(900, None, "c"), (901, "", None), (None, "vilest foulness vilest", "c"), (0, texts[0], "c"), (902, "plain1 " * 20000, "c")], "doc_id long, text string, grade string")
    labels = spark.createDataFrame([(i, int(g > 0), "x") for i, g in enumerate(grades)] + [(None, 1, "x"), (5, None, "x"), (901, 0, "x"), (3, int(grades[3] > 0), "x")], "doc_id long, toxic int, text string")
    got = t.toxicity(docs, labels).collect()
    assert len(got) == 305
    flags = {r.doc_id: r.toxic for r in got}
    assert flags[None] and not flags[900] and not flags[901] and not flags[902]
    assert np.mean([flags[i] == (g > 0) for i, g in enumerate(grades)]) > 0.98
    assert not any(r.toxic for r in t.toxicity(docs, labels.where("toxic = 0")).collect())
    assert t.toxicity(docs.limit(0), labels).count() == 0
