"""Quality by hierarchical empirical Bayes: document evidence, shrunk site and path posteriors, global prior.

A logistic classifier on measures of the whole text gives each document its own evidence. Grouped sums of
that evidence over all documents give each host, and each path of a host, a beta posterior: a host is shrunk
towards the global mean by a prior whose strength is fitted to the spread between hosts (moments, from
grouped sums), a path towards its host by one fitted to the spread between paths. A document's quality is
its evidence, with the mean of its path's posterior, itself left out, in place of the global prior:

    logit(quality) = logit(evidence) + SITE * (logit(path posterior) - logit(global mean))

Documents have no address; their host is ``source`` and their path ``lang``, and other tables may name other
columns. Hosts and paths that are null are groups of their own. Sums are partial before they are shuffled,
and hot groups meet their documents by broadcast (at most 1000 can hold a thousandth of all rows).

Null and empty texts have the measures of nothing; null labels and ids train nothing; without labels of both
kinds the evidence is the share of good ones (a half without any). Every input row gives one output row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkdoc.llm._spark import Scratch, join_counted, map_texts, slices
from sparkdoc.llm._text import SPACE, as_bytes, words, xxh64
from sparkdoc.llm.classify import SAMPLE, adam, labelled, sigmoid

#: How much a site's record weighs against the document's own evidence.
SITE = 0.5
#: Quality from which a document is kept.
KEEP = 0.5
MEASURES = ["log words", "word length", "distinct words", "repeated neighbours", "upper", "digits", "letters", "punctuation", "symbols", "word with symbols", "bars", "line ends", "long words", "stops", "log bytes", "commonest word"]

_UPPER, _DIGIT, _LETTER, _PUNCTUATION, _SYMBOL = (np.zeros(256, bool) for _ in range(5))
_UPPER[65:91] = True
_DIGIT[48:58] = True
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_PUNCTUATION[[ord(c) for c in ".,;:!?'\"()-"]] = True
_SYMBOL[33:127] = True
_SYMBOL &= ~(_LETTER | _DIGIT | _PUNCTUATION)
_NOT_SPACE = ~SPACE


def _sums(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(mask)])[off]).astype(float)


def measures(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of ``MEASURES`` for each text; shares of nothing are 0."""
    size = np.maximum(np.diff(off), 1).astype(float)
    low, s, e, first = words(data, off, _NOT_SPACE)
    n = np.diff(first)
    some = np.maximum(n, 1).astype(float)
    h, length = xxh64(low, s, e - s), e - s
    doc = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((h, doc))
    hs, ds = h[order], doc[order]
    new = np.ones(len(hs), bool)
    new[1:] = (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])
    begin = np.flatnonzero(new)
    most = np.zeros(len(n))
    np.maximum.at(most, ds[begin], np.diff(np.append(begin, len(hs))))
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    symbol = np.concatenate([[0], np.cumsum(_SYMBOL[data] | (data == 33))])
    marked = (symbol[e] - symbol[s] >= 2) if len(s) else np.zeros(0, bool)
    ends = (data[e - 1] == 46) if len(s) else np.zeros(0, bool)
    per = lambda x: np.bincount(doc, x, len(n)) / some
    return np.stack(
        [
            np.log2(1.0 + n), per(length), np.bincount(ds[begin], minlength=len(n)) / some**0.9, per(again), _sums(_UPPER[data], off) / size, _sums(_DIGIT[data], off) / size, _sums(_LETTER[data], off) / size,
            _sums(_PUNCTUATION[data], off) / size, _sums(_SYMBOL[data], off) / size, per(marked), _sums(data == 124, off) / size, _sums(data == 10, off) / size, per(length > 25), per(ends), np.log2(size), most / some,
        ],
        axis=1,
    )


@dataclass
class Classifier:
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def evidence(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        return sigmoid(self._spread(measures(data, off)) @ self.weights + self.bias)

    def _spread(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -6, 6)
        return np.concatenate([z, z * z / 6, np.abs(z)], axis=1)


def _share(good: np.ndarray) -> Classifier:
    """Without labels of both kinds: the share of good ones."""
    k, share = len(MEASURES), (good.sum() + 0.5) / (len(good) + 1)
    return Classifier(np.zeros(k), np.ones(k), np.zeros(3 * k), float(np.log(share / (1 - share))))


def fit(texts: list[str | None], good: np.ndarray, ridge: float = 1e-4) -> Classifier:
    """Logistic regression on the measures, their squares and sizes."""
    if not len(texts):
        return _share(np.zeros(0))
    data, off = as_bytes(texts)
    return fit_measures(np.concatenate([measures(data[off[i] : off[j]], off[i : j + 1] - off[i]) for i, j in slices(off, 1 << 20)]), good, ridge)


def fit_measures(x: np.ndarray, good: np.ndarray, ridge: float = 1e-4) -> Classifier:
    """As ``fit``, of rows of ``MEASURES``."""
    good, k = np.asarray(good, float), len(MEASURES)
    if not len(good) or good.min() == good.max():
        return _share(good)
    c = Classifier(x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9), np.zeros(3 * k), 0.0)
    z = c._spread(x)

    def gradient(p: np.ndarray) -> np.ndarray:
        g = (sigmoid(z @ p[:-1] + p[-1]) - good) / len(good)
        return np.append(z.T @ g + ridge * p[:-1], g.sum())

    p = adam(np.zeros(3 * k + 1), gradient)
    return Classifier(c.centre, c.scale, p[:-1], float(p[-1]))


def _logit(p: Column) -> Column:
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(q / (1 - q))


def _strength(groups: DataFrame, inner: str, mean: Column) -> float:
    """Pseudo-count of the prior, by moments: groups of n documents vary about ``mean`` by m(1-m)/(k+1) times what n leaves."""
    row = groups.agg(
        F.sum("n").alias("n"), F.count("*").alias("g"), F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - mean, 2)).alias("between"), F.sum(F.col(inner)).alias("within")
    ).first()
    if not row.n or row.g < 2:
        return 10.0
    spread = (row.within or 0.0) / row.n  # variance of a document's evidence inside its group
    between = max((row.between or 0.0) - row.g * spread, 0.0) / row.n
    return float(min(max(spread / between if between > 0 else 1e4, 1.0), 1e4))


def score(docs: DataFrame, model: Classifier, host_col: str = "source", path_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", site: float = SITE, keep: float = KEEP) -> DataFrame:
    """One row per document: doc_id, host, path, evidence, host_posterior, path_posterior, quality, kept."""
    with Scratch(docs.sparkSession) as scratch:
        kernel = lambda: lambda data, off: [model.evidence(data, off)]
        named = docs.select(docs[id_col].alias("__id"), docs[host_col].cast("string").alias("__host"), docs[path_col].cast("string").alias("__path"), docs[text_col].alias("__text_"))
        rows = map_texts(named, "__text_", {"doc_id": "__id", "host": "__host", "path": "__path"}, [("evidence", T.DoubleType())], kernel)
        rows = scratch.keep(rows.withColumn("key", F.struct("host", "path").cast("struct<host:string,path:string>")).withColumn("key", F.to_json("key")), "evidence")
        e = F.col("evidence")
        paths = scratch.keep(rows.groupBy("key", "host").agg(F.count("*").alias("n"), F.sum(e).alias("s"), F.sum(e * e).alias("q")), "paths")
        hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.count("*").alias("paths"))
        hosts = scratch.keep(hosts, "hosts")
        total, mean, n_paths = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.sum("s") / F.sum("n"), F.coalesce(F.sum("paths"), F.lit(0))).first()
        mean = 0.5 if mean is None else mean
        inside = F.greatest(F.lit(0.0), F.col("q") - F.col("s") * F.col("s") / F.col("n"))
        host_prior = _strength(hosts.withColumn("within", inside), "within", F.lit(mean))
        named_hosts = hosts.select(F.to_json(F.struct("host")).alias("h"), F.col("n").alias("host_n"), F.col("s").alias("host_s"), "paths")
        with_host = scratch.keep(join_counted(paths.withColumn("h", F.to_json(F.struct("host"))), named_hosts, ["h"], "paths", n_paths).select("key", "n", "s", "q", "host_n", "host_s"), "with_host")
        host_mean = (F.col("host_s") + host_prior * mean) / (F.col("host_n") + host_prior)
        path_prior = _strength(with_host.withColumn("within", inside), "within", host_mean)
        scratch.only(rows, with_host)
        found = join_counted(rows, with_host.select("key", "n", "s", "host_n", "host_s"), ["key"], "n", total)
        # the document's own evidence is left out of its site's record
        host = (F.col("host_s") - e + host_prior * mean) / (F.col("host_n") - 1 + host_prior)
        path = (F.col("s") - e + path_prior * F.col("host_posterior")) / (F.col("n") - 1 + path_prior)
        combined = _logit(e) + site * (_logit(F.col("path_posterior")) - _logit(F.lit(mean)))
        out = found.withColumn("host_posterior", host).withColumn("path_posterior", path).withColumn("quality", 1 / (1 + F.exp(-combined)))
        return out.select("doc_id", "host", "path", "evidence", "host_posterior", "path_posterior", "quality", (F.col("quality") >= keep).alias("kept"))


def train(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> Classifier:
    """Fit on at most ``limit`` labelled documents."""
    with Scratch(docs.sparkSession) as scratch:
        sample = labelled(docs, labels, labels["quality"], scratch, limit)
        kernel = lambda: lambda data, off: [pa.array(list(measures(data, off)), pa.list_(pa.float64()))]
        rows = map_texts(sample, "text", {"id": "id", "y": "y"}, [("m", T.ArrayType(T.DoubleType()))], kernel).orderBy(F.xxhash64("id"), "id").collect()  # 16 numbers a row
        scratch.clear()
    return fit_measures(np.array([r.m for r in rows]).reshape(-1, len(MEASURES)), np.array([r.y for r in rows], float))


def classify(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE, **options) -> DataFrame:
    return score(docs, train(docs, labels, limit), **options)
