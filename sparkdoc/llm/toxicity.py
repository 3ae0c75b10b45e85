"""Toxicity by cumulative-link ordinal regression over sparse words.

Severity grades 0, 1, ..., K are ordered; one weight vector is shared by all thresholds:
P(grade > k) = sigmoid(x.w - t_k) with t_0 < t_1 < ... The output is the expected severity and the
probability of any toxicity; a document at ``reject`` or above is toxic.

The labelled table only says toxic or not, so its toxic rows are graded by how much they hold of the
words that a first two-grade fit finds toxic: grade 1 up to the median of those rows, grade 2 beyond it.
A label table with an ordered grade column can be given as it is.

Words and their beginnings are features. Each counts by the logarithm of its occurrences in the whole text. Null or empty texts have no words
and get what the thresholds alone say; with labels of one grade only, nothing is toxic. Null labels and
null ids in the labels are left out; every input row gives one output row, null or repeated ids included.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkdoc.llm._spark import Scratch, carry, map_texts, restore
from sparkdoc.llm._text import word_counts
from sparkdoc.llm.classify import SAMPLE, Sparse, adam, features_of, labelled, presence, screen, sigmoid, vocabulary_of

#: Words kept by the screen.
WORDS = 1024
#: Lengths of the word beginnings, in bytes, that count as words of their own: one stem takes many endings.
PREFIXES = (4, 5, 6)
#: Probability of grade 1 or more from which a document is toxic.
REJECT = 0.3
#: Weight of the squared weights in the loss, an example.
RIDGE = 1e-6


@dataclass
class OrdinalModel:
    vocabulary: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each text and threshold."""
        return sigmoid(score[:, None] - self.thresholds)

    def scores(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        row, col, n, _ = word_counts(data, off, self.vocabulary, PREFIXES)
        return np.bincount(row, np.log2(1.0 + n) * self.weights[col], len(off) - 1) if len(row) else np.zeros(len(off) - 1)


_HARMLESS = OrdinalModel(np.zeros(0, np.uint64), np.zeros(0), np.array([30.0]))


def _one_sided(grade: np.ndarray) -> bool:
    return not len(grade) or grade.max() < 1 or grade.min() > 0


def thresholds_of(gaps: np.ndarray) -> np.ndarray:
    """Rising thresholds: the first, and the logarithms of the gaps between them."""
    return np.cumsum(np.concatenate([gaps[:1], np.exp(gaps[1:])]))


def gradient_of(x: Sparse, grade: np.ndarray, columns: int, ridge: float) -> Callable[[np.ndarray], np.ndarray]:
    """Gradient of the mean negative log likelihood and the ridge, by weights and gaps in one vector."""
    top, n = int(grade.max()), len(grade)

    def gradient(p: np.ndarray) -> np.ndarray:
        w, t = p[:columns], thresholds_of(p[columns:])
        s = sigmoid(x.dot(w)[:, None] - t)  # P(grade > k)
        edge = np.concatenate([np.ones((n, 1)), s, np.zeros((n, 1))], axis=1)
        k = np.arange(n)
        upper, lower = edge[k, grade], edge[k, grade + 1]
        likely = np.maximum(upper - lower, 1e-12)
        d_upper, d_lower = upper * (1 - upper), lower * (1 - lower)
        g_score = -(d_upper - d_lower) / likely / n
        g_t = np.zeros(top)
        np.add.at(g_t, (grade - 1)[grade > 0], (d_upper / likely)[grade > 0] / n)
        np.add.at(g_t, grade[grade < top], -(d_lower / likely)[grade < top] / n)
        back = np.cumsum(g_t[::-1])[::-1]  # a gap moves all thresholds after it
        g_gap = np.concatenate([back[:1], back[1:] * np.exp(p[columns + 1 :])])
        return np.concatenate([x.transposed(g_score, columns) + ridge * w, g_gap])

    return gradient


def _fit(x: Sparse, grade: np.ndarray, columns: int, ridge: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of greatest likelihood; the gaps between thresholds are kept positive as exponentials."""
    top = int(grade.max())
    base = np.array([np.log((grade <= k).mean() / max((grade > k).mean(), 1e-6) + 1e-6) for k in range(top)])
    start = np.concatenate([np.zeros(columns), base[:1], np.log(np.maximum(np.diff(base), 0.1))])
    p = adam(start, gradient_of(x, grade, columns, ridge))
    return p[:columns], thresholds_of(p[columns:])


def fit(texts: list[str | None], grade: np.ndarray, words: int = WORDS, ridge: float = RIDGE, split: bool = False) -> OrdinalModel:
    """Fit on graded texts; with ``split``, grades are 0 and 1 and grade 1 is parted at its median toxic evidence."""
    grade = np.asarray(grade, np.int64)
    if _one_sided(grade):
        return _HARMLESS
    vocabulary = screen(texts, grade > 0, words, prefixes=PREFIXES)
    return fit_features(presence(texts, vocabulary, PREFIXES), vocabulary, grade, ridge, split)


def fit_features(x: Sparse, vocabulary: np.ndarray, grade: np.ndarray, ridge: float = RIDGE, split: bool = False) -> OrdinalModel:
    """As ``fit``, of features that were counted before."""
    w, t = _fit(x, np.minimum(grade, 1) if split else grade, len(vocabulary), ridge)
    if split:
        toxic = grade > 0
        evidence = x.dot(np.maximum(w, 0))
        graded = np.where(toxic, 1 + (evidence > np.median(evidence[toxic])), 0)
        if graded.max() == 2:
            w, t = _fit(x, graded, len(vocabulary), ridge)
    return OrdinalModel(vocabulary, w, t)


def score(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text", reject: float = REJECT, keep: dict[str, str] | None = None) -> DataFrame:
    """One row per document: doc_id, kept columns, p_toxic, expected_severity, grade (the likeliest), toxic."""

    def kernel():
        def apply(data: np.ndarray, off: np.ndarray) -> list:
            above = model.above(model.scores(data, off))
            edge = np.concatenate([np.ones((len(above), 1)), above, np.zeros((len(above), 1))], axis=1)
            return [above[:, 0], above.sum(axis=1), np.argmax(edge[:, :-1] - edge[:, 1:], axis=1), above[:, 0] >= reject]

        return apply

    fields = [("p_toxic", T.DoubleType()), ("expected_severity", T.DoubleType()), ("grade", T.LongType()), ("toxic", T.BooleanType())]
    return map_texts(docs, text_col, {"doc_id": id_col, **(keep or {})}, fields, kernel)


def train(docs: DataFrame, labels: DataFrame, grade: Column | None = None, limit: int = SAMPLE) -> OrdinalModel:
    """Fit on at most ``limit`` labelled documents; ``grade`` is an ordered integer column of ``labels``, else its toxic flag is split."""
    with Scratch(docs.sparkSession) as scratch:
        sample = labelled(docs, labels, labels["toxic"] if grade is None else grade, scratch, limit)
        vocabulary = vocabulary_of(sample, F.col("y") > 0, WORDS, prefixes=PREFIXES)
        x, rows = features_of(sample, vocabulary, PREFIXES)
        scratch.clear()
    grades = np.array([r.y for r in rows], np.int64)
    return _HARMLESS if _one_sided(grades) else fit_features(x, vocabulary, grades, split=grade is None)


def toxicity(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE, reject: float = REJECT) -> DataFrame:
    return score(docs, train(docs, labels, limit=limit), reject=reject)


def drop_toxic(docs: DataFrame, model: OrdinalModel, reject: float = REJECT) -> DataFrame:
    """``docs`` without the toxic ones."""
    return restore(score(docs, model, reject=reject, keep=carry(docs)).where(~F.col("toxic")), docs)
