"""Mixing sources to target weights by soft membership and projected-gradient least squares.

A softmax classifier trained on labelled rows gives each document a posterior over domains. The rates
r >= 0 minimise the weighted squares of (expected tokens of domain k) - (target of k), where document d
brings r_d * tokens_d * posterior_dk. The gradient of r_d is tokens_d times posterior_d . v, with v of as
many numbers as there are domains; steps are scaled by 1 / tokens_d, so that the rate depends on what a
document is and not on how long it is. Rates start at 1 and are projected on r >= 0 after each step. A
rate is a function of the posterior and of all steps so far, so the driver holds a few numbers a step
and each pass over the narrow table (tokens, posterior) is one sum per domain; nothing is shuffled
but partial sums.

Targets are weights, scaled to the smallest total at which no domain must shrink, so that no document is
dropped; a ``total`` of tokens can be given instead. A domain without a stated weight keeps its present share
of the tokens: its rate is set to the growth of the whole, and the stated weights divide the rest. Only a
domain whose stated weight is 0 is dropped.

A rate becomes copies: its whole part, and one more with the chance of its fraction, drawn by a hash of
the id. Null and empty texts have no tokens and get the rate of their posterior (the classifier's prior).
Null ids draw by their text; repeated rows draw alike. Domains without expected tokens are left out.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkdoc.llm._spark import BULK, Scratch, apart, carry, map_texts, restore
from sparkdoc.llm._text import word_counts
from sparkdoc.llm.classify import Sparse, adam, features_of, labelled, presence, screen, softmax, vocabulary_of

#: Labelled rows that the domain classifier is trained on.
SAMPLE = 2000
WORDS = 512
RIDGE = 1e-3
#: Token weights of the domains of ``documents`` (its labelled rows tell the language).
TARGETS = {"en": 0.5, "de": 0.18, "fr": 0.18, "es": 0.14}
#: Steps of the fit; they are free as long as no rate is projected. Those after that take a pass over the rows each.
STEPS, PASSES = 500, 60
#: Relative distance from every target at which the steps end.
CLOSE = 1e-6
#: Without a total, no step takes the rate of a pure wanted domain below this; bringing it to 1 again can grow the rows by its inverse.
LEAST = 0.1


@dataclass
class DomainModel:
    domains: list[str]
    vocabulary: np.ndarray
    weights: np.ndarray  # words by domains
    bias: np.ndarray

    def posteriors(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row, col, n, total = word_counts(data, off, self.vocabulary)
        z = np.tile(self.bias, (len(off) - 1, 1))
        scaled = np.log2(1.0 + n)
        for k in range(len(self.domains)):
            z[:, k] += np.bincount(row, scaled * self.weights[col, k], len(z))
        return softmax(z), total


def train(texts: list[str | None], domains: list[str], words: int = WORDS, ridge: float = RIDGE) -> DomainModel:
    several = len(set(domains)) > 1
    vocabulary = screen(texts, np.array(domains, dtype=object).astype(str), words) if several else np.zeros(0, np.uint64)
    return _train(presence(texts, vocabulary), vocabulary, domains, ridge)


def _train(x: Sparse, vocabulary: np.ndarray, domains: list[str], ridge: float = RIDGE) -> DomainModel:
    """Softmax regression of the domains on the counts of the vocabulary's words."""
    names, y = np.unique(np.array(domains, dtype=object).astype(str), return_inverse=True)
    onehot, m = np.eye(len(names))[y], len(vocabulary)

    def gradient(p: np.ndarray) -> np.ndarray:
        g = (softmax(x.dot(p[:m]) + p[m]) - onehot) / len(y)
        return np.concatenate([x.transposed(g, m).reshape(m, len(names)) + ridge * p[:m], g.sum(axis=0, keepdims=True)])

    p = adam(np.zeros((m + 1, len(names))), gradient, steps=200)
    return DomainModel(names.tolist(), vocabulary, p[:m], p[m])


def _draw(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """Uniform in [0, 1) by a hash of the id, or of the text where it is null."""
    own = F.when(docs[id_col].isNotNull(), F.xxhash64(docs[id_col].cast("string"))).otherwise(F.xxhash64(docs[text_col]))  # xxhash64 of null isn't null
    h = F.xxhash64(own, F.lit("rate"))
    return F.shiftrightunsigned(h, 11) / F.lit(float(1 << 53))


def membership(docs: DataFrame, model: DomainModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, draw, n_tokens, posterior): one row per document."""

    def kernel():
        def apply(data: np.ndarray, off: np.ndarray) -> list:
            q, total = model.posteriors(data, off)
            return [total, pa.array(list(q), pa.list_(pa.float64()))]

        return apply

    source = docs.select(docs[id_col].alias("doc_id"), _draw(docs, id_col, text_col).alias("draw"), docs[text_col].alias("text"))
    return map_texts(source, "text", {"doc_id": "doc_id", "draw": "draw"}, [("n_tokens", T.LongType()), ("posterior", T.ArrayType(T.DoubleType()))], kernel)


def _rates(q: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Rates after all steps: each moves a rate by its posterior's share of the step and projects it."""
    r = np.ones(len(q))
    for v in steps:
        np.maximum(r - q @ v, 0, out=r)
    return r


def _matrix(column: pa.Array, k: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, k)


def _sum(members: DataFrame, k: int, size: int, part) -> np.ndarray:
    """Sum of ``part(posteriors, tokens)``, ``size`` numbers, over all rows: one pass, one row a task is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            total += part(_matrix(b.column(1), k), b.column(0).to_numpy(zero_copy_only=False).astype(np.float64))
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["s"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            total += _matrix(b.column(0), size).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["s"])

    # an aggregate a number would be a plan of as many expressions as domains squared
    sums = members.select("n_tokens", "posterior").mapInArrow(run, "s array<double>")
    return np.array(sums.repartition(1).mapInArrow(add, "s array<double>").first()[0])


def _expected(members: DataFrame, steps: np.ndarray, k: int) -> np.ndarray:
    """Expected tokens of each domain at the rates after ``steps``."""
    return _sum(members, k, k, lambda q, n: (n * _rates(q, steps)) @ q)


def _gram(members: DataFrame, k: int) -> np.ndarray:
    """Sums of tokens times posterior times posterior: all that the gradient needs while no rate is projected."""
    return _sum(members, k, k * k, lambda q, n: ((q * n[:, None]).T @ q).ravel()).reshape(k, k)


def fit(members: DataFrame, domains: list[str], targets: dict[str, float], total: float | None = None, steps: int = STEPS, passes: int = PASSES, close: float = CLOSE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Steps that lead to the rates; the token targets; the expected tokens reached.

    The first step sets the rates of domains that ``targets`` doesn't name. They take no part in the others: a
    stray label, of which the classifier sees a little in every document of its language, must not move that language.

    A rate is a mean of the rates that pure documents have. While those are 0 or more after every step, no rate
    was projected, the expected tokens are linear in the steps, and one pass over the rows serves them all; once
    one falls below 0, each step takes a pass. Ending short of the targets is reported as a warning.
    """
    k = len(domains)
    made = np.zeros((0, k))
    gram = _gram(members, k)
    have = gram.sum(axis=1)  # posteriors sum to 1
    weight = np.array([float(targets.get(d, 0.0)) for d in domains])
    weight[have <= 0] = 0
    unstated = np.array([d not in targets for d in domains]) & (have > 0)
    if weight.sum() <= 0 and not unstated.any():
        return made, have, have
    share = np.where(unstated, have, 0) / have.sum()
    weight = weight * ((1 - share.sum()) / (weight.sum() or 1)) + share
    whole = np.max((have / np.where(weight > 0, weight, np.inf))) if total is None else total
    want = weight * whole
    scale = np.where(have > 0, have, 1.0)
    best, velocity, now = made, np.zeros(k), have
    if unstated.any():
        best = np.where(unstated, 1 - whole / have.sum(), 0)[None, :]
    stated = (have > 0) & ~unstated
    pure, linear = np.ones(k), True
    floor = np.where(weight > 0, LEAST, -np.inf) if total is None else np.full(k, -np.inf)
    left = steps
    while True:
        if len(best):
            pure = 1 - best.sum(axis=0) if linear else pure
            linear = linear and bool((pure >= 0).all())
            now = have - gram @ best.sum(axis=0) if linear else _expected(members, best, k)
            left = left if linear else min(left, passes)
        off = np.where(stated, (now - want) / scale, 0)
        if np.abs(off).max() <= close:
            break
        if left <= 0:
            warnings.warn(f"the fit ended {np.abs(off).max():.2g} of a domain's tokens short of its targets: {dict(zip(domains, now.tolist(), strict=True))} for {dict(zip(domains, want.tolist(), strict=True))}", stacklevel=2)
            break
        left, passes = left - 1, passes - (not linear)
        bound = 1 - best.sum(axis=0)
        velocity = np.minimum(0.3 * velocity + off, bound - floor)  # gradient with momentum; curvature is at most 1 after scaling
        best = np.concatenate([best, velocity[None, :]])
    return best, want, now


def plan(docs: DataFrame, labelled_docs: DataFrame, labels: DataFrame, domain_col: str = "lang", targets: dict[str, float] | None = None, total: float | None = None, limit: int = SAMPLE) -> tuple[DomainModel, np.ndarray, float]:
    """Domain classifier, trained on at most ``limit`` rows of ``labelled_docs`` that ``labels`` covers; the steps to the rates of ``docs``; their scale.

    ``domain_col`` of ``labelled_docs`` is the label. Without labelled rows every rate is 1. Where no rate is
    projected, a rate is linear in the posterior and least at a pure domain; without a ``total`` the scale
    brings the least rate of a wanted domain to 1, so that no document is lost unless a stated weight is 0.
    """
    with Scratch(docs.sparkSession) as scratch:
        found = _plan(docs, labelled_docs, labels, domain_col, targets, total, limit, scratch)[:3]
        scratch.clear()
    return found


def _plan(docs: DataFrame, labelled_docs: DataFrame, labels: DataFrame, domain_col: str, targets: dict[str, float] | None, total: float | None, limit: int, scratch: Scratch) -> tuple[DomainModel, np.ndarray, float, DataFrame]:
    """As ``plan``, and the written members."""
    sample = labelled(labelled_docs, labels, F.lit(0), scratch, limit, kind_col=domain_col)
    vocabulary = vocabulary_of(sample, F.col("kind"), WORDS)
    x, rows = features_of(sample, vocabulary)
    if not rows:
        none = DomainModel([""], np.zeros(0, np.uint64), np.zeros((0, 1)), np.zeros(1))
        return none, np.zeros((0, 1)), 1.0, scratch.keep(membership(docs, none), "members")
    model = _train(x, vocabulary, [r.kind for r in rows])
    members = scratch.keep(membership(docs, model), "members")
    steps, want, _ = fit(members, model.domains, TARGETS if targets is None else targets, total)
    least = _rates(np.eye(len(model.domains)), steps)[want > 0].min(initial=1.0)
    return model, steps, 1 / least if total is None else 1.0, members


def _counted(rated: DataFrame, draw: str) -> DataFrame:
    whole = F.floor(F.col("rate") + 1e-9)
    copies = whole + (F.col(draw) < F.col("rate") - whole).cast("long")
    return rated.withColumn("copies", copies.cast("long")).drop(draw)


_RATED = [("domain", T.StringType()), ("p_domain", T.DoubleType()), ("n_tokens", T.LongType()), ("rate", T.DoubleType())]


def rate(docs: DataFrame, model: DomainModel, steps: np.ndarray, scale: float = 1.0, id_col: str = "doc_id", text_col: str = "text", keep: dict[str, str] | None = None) -> DataFrame:
    """One row per document: doc_id, kept columns, domain (the likeliest), p_domain, n_tokens, rate, copies."""

    def kernel():
        def apply(data: np.ndarray, off: np.ndarray) -> list:
            q, total = model.posteriors(data, off)
            return [[model.domains[i] for i in q.argmax(axis=1)], q.max(axis=1), total, _rates(q, steps) * scale]

        return apply

    keep = keep or {}
    source = docs.select(docs[id_col].alias("__id"), _draw(docs, id_col, text_col).alias("__draw"), *[docs[c].alias(k) for k, c in keep.items()], docs[text_col].alias("__text_"))
    text = next((k for k, c in keep.items() if c == text_col), "__text_")
    return _counted(map_texts(source, text, {"doc_id": "__id", "__draw": "__draw", **{k: k for k in keep}}, _RATED, kernel), "__draw")


def mix(docs: DataFrame, labelled_docs: DataFrame, labels: DataFrame, domain_col: str = "lang", targets: dict[str, float] | None = None, total: float | None = None, limit: int = SAMPLE) -> DataFrame:
    """Rates and copies of all documents: the text is read once, into its posterior, and never shuffled."""
    with Scratch(docs.sparkSession) as scratch:
        model, steps, scale, members = _plan(docs, labelled_docs, labels, domain_col, targets, total, limit, scratch)
    k = len(model.domains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = _matrix(b.column(3), k)
            likeliest = [model.domains[i] for i in q.argmax(axis=1)] if len(q) else []
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(likeliest, pa.string()), pa.array(q.max(axis=1, initial=0.0)), b.column(2), pa.array(_rates(q, steps) * scale)], names=["doc_id", "draw", *[n for n, _ in _RATED]])

    schema = T.StructType([*members.schema.fields[:2], *[T.StructField(n, t) for n, t in _RATED]])
    return _counted(members.mapInArrow(run, schema), "draw")


def remix(docs: DataFrame, labelled_docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs`` with each row as often as its copies say; the copies of a long text go to several partitions."""
    model, steps, scale = plan(docs, labelled_docs, labels, **options)
    most = float(np.floor(_rates(np.eye(len(model.domains)), steps).max() * scale) + 1)  # a rate is convex in the posterior: no document's is above the purest ones'
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    bulky = size * F.lit(most) > BULK
    rated = lambda rows: rate(rows, model, steps, scale, keep=carry(docs))
    copied = lambda rows: restore(rated(rows).withColumn("__copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))), docs)
    if docs.where(bulky).select(F.lit(1)).isEmpty():
        return copied(docs)
    text = next(k for k, c in carry(docs).items() if c == "text")
    far = rated(docs.where(bulky)).agg(F.sum(F.col("copies") * F.octet_length(text))).first()[0]
    return copied(docs.where(~bulky)).unionByName(apart(copied(docs.where(bulky)), far))
