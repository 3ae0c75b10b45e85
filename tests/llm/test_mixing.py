"""Mixing against the same least squares over all rows at once, and its targets on held-out text."""

from __future__ import annotations

import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkdoc.llm import mixing as m
from sparkdoc.llm import sharding
from sparkdoc.llm._spark import PART
from sparkdoc.llm._text import as_bytes

STEMS = {"en": "the of and to".split(), "de": "der und ein zu".split(), "fr": "le et un que".split()}


def rows(n: int, seed: int) -> list[tuple]:
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choices(list(STEMS), [6, 2, 1])[0]
        out.append((i, " ".join(rng.choices(STEMS[lang] + [f"w{k}" for k in range(30)], k=rng.randrange(20, 200))), lang, 0.5))
    return out


SCHEMA = "doc_id long, text string, lang string, rate double"


def test_classifier_on_held_out_text():
    data = rows(400, 1)
    model = m.train([r[1] for r in data], [r[2] for r in data])
    test = rows(300, 2)
    q, _ = model.posteriors(*as_bytes([r[1] for r in test]))
    assert np.allclose(q.sum(axis=1), 1)
    assert np.mean([model.domains[k] == r[2] for k, r in zip(q.argmax(axis=1), test, strict=True)]) > 0.98


def test_rates_reach_targets(spark):
    data = rows(500, 3)
    docs = spark.createDataFrame(data, SCHEMA)
    labels = spark.createDataFrame([(r[0],) for r in data[:200]], "doc_id long")
    targets = {"en": 0.4, "de": 0.4, "fr": 0.2}
    model, steps, scale = m.plan(docs, docs, labels, targets=targets)
    got = m.rate(docs, model, steps, scale).collect()
    q, n = model.posteriors(*as_bytes([r[1] for r in data]))
    rate = {r.doc_id: r.rate for r in got}
    r = np.array([rate[i] for i in range(len(data))])
    reached = (r * n) @ q
    want = np.array([targets[d] for d in model.domains])
    assert np.allclose(reached / reached.sum(), want, atol=1e-4)
    assert r.min() > 1 - 1e-9 and min(g.copies for g in got) == 1  # nothing has to shrink
    # brute force: the same projected steps on dense arrays
    share = n @ q
    goal, x, v = want * (share / want).max(), np.ones(len(n)), np.zeros(len(want))
    for _ in range(len(steps)):
        v = 0.3 * v + ((x * n) @ q - goal) / share
        x = np.maximum(x - q @ v, 0)
    assert np.allclose(x * scale, r, atol=1e-9)
    assert all(int(np.floor(g.rate)) <= g.copies <= int(np.ceil(g.rate)) for g in got)
    assert abs(sum(g.copies * g.n_tokens for g in got) - reached.sum()) < 0.1 * reached.sum()


def test_shrinking_projects_at_zero(spark):
    data = rows(300, 4)
    docs = spark.createDataFrame(data, SCHEMA)
    labels = spark.createDataFrame([(r[0],) for r in data], "doc_id long")
    model, steps, scale = m.plan(docs, docs, labels, targets={"en": 0.0, "de": 0.5, "fr": 0.5}, total=2000.0)
    got = m.rate(docs, model, steps, scale).collect()
    assert scale == 1 and min(g.rate for g in got) == 0
    tokens = Counter()
    for g in got:
        tokens[g.domain] += g.rate * g.n_tokens
    assert tokens["de"] == pytest.approx(1000, rel=0.1) and tokens["fr"] == pytest.approx(1000, rel=0.1)


@pytest.mark.parametrize("odd", ["it", "EN", ""])
def test_a_label_without_a_target_loses_nothing(spark, odd):
    data = rows(500, 6)
    rng = random.Random(7)
    if odd == "it":
        data += [(1000 + i, " ".join(rng.choices("il e di che".split() + [f"w{k}" for k in range(30)], k=60)), odd, 0.5) for i in range(12)]
    else:  # one stray label
        data[0] = (0, "the of and to " * 20, odd, 0.5)
    docs = spark.createDataFrame(data, SCHEMA)
    labels = spark.createDataFrame([(r[0],) for r in data], "doc_id long")
    targets = {"en": 0.4, "de": 0.4, "fr": 0.2}
    model, steps, scale = m.plan(docs, docs, labels, targets=targets)
    assert odd in model.domains
    got = m.rate(docs, model, steps, scale).collect()
    assert len(got) == len(data) and min(g.copies for g in got) >= 1 and min(g.rate for g in got) > 1 - 1e-9
    q, n = model.posteriors(*as_bytes([r[1] for r in data]))
    r = np.array([{g.doc_id: g.rate for g in got}[d[0]] for d in data])
    before, reached = n @ q, (r * n) @ q
    at = [model.domains.index(d) for d in targets]
    assert np.allclose(reached[at] / reached[at].sum(), list(targets.values()), atol=2e-3)
    if odd == "it":
        k = model.domains.index(odd)
        assert reached[k] / reached.sum() == pytest.approx(before[k] / before.sum(), rel=0.05)
    assert (r * n).sum() < 1.2 * (before[at] / list(targets.values())).max()  # nor does the odd label make the rows many more
    assert all(g.copies >= 1 for g in m.mix(docs, docs, labels).collect())
    assert {g.copies for g in m.mix(docs, docs, labels, targets={}).collect()} == {1}


def test_fifth_language_keeps_targets(spark):
    data = rows(500, 8)
    rng = random.Random(9)
    data += [(1000 + i, " ".join(rng.choices("il e di che".split() + [f"w{k}" for k in range(30)], k=90)), "it", 0.5) for i in range(60)]
    docs = spark.createDataFrame(data, SCHEMA)
    labels = spark.createDataFrame([(r[0],) for r in data], "doc_id long")
    targets = {"en": 0.4, "de": 0.4, "fr": 0.2}
    model, steps, scale = m.plan(docs, docs, labels, targets=targets)
    got = {g.doc_id: g for g in m.mix(docs, docs, labels, targets=targets).collect()}
    assert len(got) == len(data) and min(g.copies for g in got.values()) >= 1 and min(g.rate for g in got.values()) > 1 - 1e-9
    assert {g.doc_id: pytest.approx(g.rate) for g in m.rate(docs, model, steps, scale).collect()} == {i: g.rate for i, g in got.items()}
    q, n = model.posteriors(*as_bytes([r[1] for r in data]))
    reached = (np.array([got[r[0]].rate for r in data]) * n) @ q
    at = [model.domains.index(d) for d in targets]
    assert np.allclose(reached[at] / reached[at].sum(), list(targets.values()), atol=1e-4)
    assert all(g.copies >= 1 for g in m.mix(docs, docs, labels).collect())  # the default targets, of which this table has three


def test_a_fit_that_ends_short_says_so(spark):
    data = rows(200, 10)
    docs = spark.createDataFrame(data, SCHEMA)
    model = m.train([r[1] for r in data], [r[2] for r in data])
    members = m.membership(docs, model).cache()
    with pytest.warns(UserWarning, match="short of its targets"):
        m.fit(members, model.domains, {"en": 0.2, "de": 0.6, "fr": 0.2}, steps=2)
    with pytest.warns(UserWarning, match="short of its targets"):
        m.fit(members, model.domains, {"en": 0.0, "de": 0.5, "fr": 0.5}, total=200.0, passes=1)


def test_columns_of_clashing_names(spark):
    data = [(*r, "a", "b", "c") for r in rows(60, 11)]
    docs = spark.createDataFrame(data, SCHEMA + ", __draw string, __copy string, __c0 string")
    labels = spark.createDataFrame([(r[0], "x", "y") for r in data], "doc_id long, lang string, text string")
    out = m.remix(docs, docs, labels)
    assert out.columns == docs.columns and {tuple(r)[4:] for r in out.collect()} == {("a", "b", "c")}


def test_null_ids_draw_by_their_text(spark):
    data = [(None, f"w{i} of them", "en", 0.5) for i in range(400)] + [(None, "w7 of them", "en", 0.5)]
    docs = spark.createDataFrame(data, SCHEMA)
    model = m.DomainModel(["en"], np.zeros(0, np.uint64), np.zeros((0, 1)), np.zeros(1))
    got = m.rate(docs, model, np.array([[-0.5]]), keep={"text": "text"}).collect()
    assert {g.rate for g in got} == {1.5} and {g.copies for g in got} == {1, 2}
    assert abs(sum(g.copies for g in got) - 1.5 * len(data)) < 50
    assert len({g.copies for g in got if g.text == "w7 of them"}) == 1  # equal texts draw alike


def test_sums_over_many_domains(spark):
    """The sums of 60 domains are 3,600 numbers; as an aggregate each, planning them took minutes."""
    k = 60
    q = np.random.default_rng(4).dirichlet(np.ones(k), 50)
    members = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "n_tokens long, posterior array<double>")
    begun = time.time()
    gram = m._gram(members, k)
    assert time.time() - begun < 30
    assert np.allclose(gram, (q * np.arange(50)[:, None]).T @ q)
    assert np.allclose(m._gram(members.limit(0), k), 0)


def test_odd_rows(spark):
    data = rows(100, 5)
    odd = [*data, (200, None, "en", None), (201, "", None, 1.0), (None, "der und", "de", 1.0), data[0], (202, "le " * 30000, "fr", 1.0)]
    docs = spark.createDataFrame(odd, SCHEMA)
    labels = spark.createDataFrame([(r[0],) for r in data] + [(None,), (201,)], "doc_id long")
    got = m.mix(docs, docs, labels).collect()
    assert len(got) == len(odd) and all(g.copies >= 1 for g in got)
    out = m.remix(docs, docs, labels)
    assert out.columns == docs.columns and out.count() == sum(g.copies for g in got)
    assert {r.copies for r in m.mix(docs, docs, labels.limit(0)).collect()} == {1}
    assert m.mix(docs.limit(0), docs, labels).count() == 0


def test_copies_of_a_long_text_lie_apart(spark):
    """Twenty copies of 2 MB in one partition compress to little, and a reader takes them all at once."""
    docs = spark.createDataFrame([(1, "wort " * 400_000, "de"), (2, "kurz", "de")], "doc_id long, text string, lang string").coalesce(1)
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    mixed = m.remix(docs, docs, labels, targets={"de": 1.0}, total=20 * 400_001)
    for made in (mixed, sharding.assign(mixed, 2)):
        parts = [r["count"] for r in made.where("doc_id = 1").groupBy(F.spark_partition_id()).count().collect()]
        assert sum(parts) == 20 and max(parts) * 2_000_000 <= PART
        assert made.where("doc_id = 2 and text = 'kurz'").count() == 20
