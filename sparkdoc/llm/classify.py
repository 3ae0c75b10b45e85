"""Text classifiers trained on a bounded sample of labelled rows: hashed words, screened, and linear models.

The sample is the documented ``limit`` of labelled rows, taken by the smallest hash of their id: the
same rows at every run, spread over all sources. Its texts are counted where they lie; the driver gets the chosen
words and, of each row, the counts of those. Everything else (scores, sums, rates) covers all rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkdoc.llm._spark import Scratch, map_texts, slices, text_buffer
from sparkdoc.llm._text import as_bytes, distinct_words, word_counts

#: Labelled rows that a classifier is trained on.
SAMPLE = 8000


#: Bytes of sample text that are hashed at a time.
CHUNK = 1 << 20
#: G statistic below which a word tells nothing: about 1 in 2000 by chance.
TELLING = 12.0


def labelled(docs: DataFrame, labels: DataFrame, grade: Column, scratch: Scratch, limit: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", kind_col: str | None = None) -> DataFrame:
    """At most ``limit`` labelled rows, written: id, y, kind (of ``kind_col``), text. Texts stay with the executors.

    Rows without an id, a grade or, if asked for, a kind are no labels; of several labels of one id the largest counts,
    of several documents of one id that of the smallest text.
    """
    wanted = labels.select(labels[id_col].alias("__id"), grade.alias("y")).where("__id is not null and y is not null").groupBy("__id").agg(F.max("y").alias("y"))
    wanted = wanted.orderBy(F.xxhash64("__id"), "__id").limit(2 * limit)  # twice as many: some may have no document
    kind = docs[kind_col].cast("string") if kind_col else F.lit("")
    found = docs.where(kind.isNotNull()).select(docs[id_col].alias("__id")).join(F.broadcast(wanted), "__id").distinct()  # reads no text
    chosen = scratch.keep(found.orderBy(F.xxhash64("__id"), "__id").limit(limit), "chosen")
    texts = docs.where(kind.isNotNull()).select(docs[id_col].alias("__id"), docs[text_col].cast("string").alias("text"), kind.alias("kind"))
    rows = texts.join(F.broadcast(chosen), "__id").groupBy("__id", "y").agg(F.min(F.struct("text", "kind")).alias("d"))
    return scratch.keep(rows.select(F.col("__id").alias("id"), "y", "d.kind", "d.text"), "sample")


def vocabulary_of(sample: DataFrame, group: Column, size: int, least: int = 5, prefixes: tuple[int, ...] = ()) -> np.ndarray:
    """As ``screen``, of a table with the column text, by the classes ``group``; only the chosen words come to the driver."""
    rows = sample.select(group.cast("string").alias("k"), "text")
    classes = {r[0]: r[1] for r in rows.groupBy("k").count().collect()}  # at most the rows of a sample
    total = sum(classes.values())
    if len(classes) < 2:
        return np.zeros(0, np.uint64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, names = np.unique(np.array(batch.column(0).to_pylist(), dtype=object).astype(str), return_inverse=True)
            data, off = text_buffer(batch.column(1))
            for i, j in slices(off, CHUNK):
                docs, hashes = distinct_words(data[off[i] : off[j]], off[i : j + 1] - off[i], prefixes)
                for g in range(len(k)):
                    h, n = np.unique(hashes[names[i + docs] == g], return_counts=True)
                    if len(h):
                        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array([k[g]] * len(h), pa.string()), pa.array(n)], names=["h", "k", "n"])

    seen = rows.mapInArrow(count, "h long, k string, n long").groupBy("h", "k").agg(F.sum("n").alias("n"))
    df = F.sum("n").over(Window.partitionBy("h"))
    of = F.element_at(F.create_map(*[F.lit(x) for pair in classes.items() for x in (pair[0], float(pair[1]))]), F.col("k"))
    term = lambda x, y: F.when(x > 0, x * F.log(x / y)).otherwise(0.0)
    n, whole, rest = F.col("n").cast("double"), F.lit(float(total)), F.lit(float(total)) - F.col("df")
    # classes that never hold the word bring n_k log(N / (N - df)) each
    g = term(n, F.col("df") * of / whole) + term(of - n, rest * of / whole) - F.when(rest > 0, of * F.log(whole / rest)).otherwise(0.0)
    scored = seen.withColumn("df", df.cast("double")).where(F.col("df") >= least).select("h", "df", g.alias("g"))
    scored = scored.groupBy("h", "df").agg(F.sum("g").alias("g")).select("h", (F.col("g") + F.when(rest > 0, whole * F.log(whole / rest)).otherwise(0.0)).alias("g"))
    best = scored.where(F.col("g") > TELLING).orderBy(F.desc("g"), "h").limit(size).select("h").collect()
    return np.sort(np.array([r[0] for r in best], np.int64).view(np.uint64))


def features_of(sample: DataFrame, vocabulary: np.ndarray, prefixes: tuple[int, ...] = ()) -> tuple[Sparse, list]:
    """Features of a sample's texts as of ``presence``, at most as many a row as there are words; and the rows (id, y, kind), in one order at every run."""

    def kernel():
        def apply(data: np.ndarray, off: np.ndarray) -> list:
            row, col, n, _ = word_counts(data, off, vocabulary, prefixes)
            cut = np.searchsorted(row, np.arange(len(off)))
            part = lambda x: pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(x, pa.int64()))
            return [part(col), part(n)]

        return apply

    lists = T.ArrayType(T.LongType())
    found = map_texts(sample, "text", {c: c for c in ("id", "y", "kind")}, [("col", lists), ("n", lists)], kernel)
    rows = found.orderBy(F.xxhash64("id"), "id").collect()
    size = [len(r.col) for r in rows]
    flat = lambda c: np.array([x for r in rows for x in r[c]], np.int64)
    return Sparse(np.repeat(np.arange(len(rows)), size), flat("col"), np.log2(1.0 + flat("n")), len(rows)), rows


@dataclass
class Sparse:
    """Rows of (column, value) pairs."""

    row: np.ndarray
    col: np.ndarray
    val: np.ndarray
    n: int

    def dot(self, w: np.ndarray) -> np.ndarray:
        if w.ndim == 1:
            return np.bincount(self.row, self.val * w[self.col], self.n)
        return np.stack([np.bincount(self.row, self.val * w[self.col, k], self.n) for k in range(w.shape[1])], axis=1)

    def transposed(self, g: np.ndarray, columns: int) -> np.ndarray:
        if g.ndim == 1:
            return np.bincount(self.col, self.val * g[self.row], columns)
        return np.stack([np.bincount(self.col, self.val * g[self.row, k], columns) for k in range(g.shape[1])], axis=1)


def screen(texts: list[str | None], y: np.ndarray, size: int, least: int = 5, prefixes: tuple[int, ...] = ()) -> np.ndarray:
    """Hashes of the ``size`` words that tell most about y by the G-test of presence, among those in at least ``least`` texts."""
    data, off = as_bytes(texts)
    classes, y = np.unique(y, return_inverse=True)
    k = len(classes)
    vocabulary, seen = np.zeros(0, np.uint64), np.zeros((0, k), np.int64)
    for i, j in slices(off, CHUNK):
        docs, hashes = distinct_words(data[off[i] : off[j]], off[i : j + 1] - off[i], prefixes)
        here, col = np.unique(hashes, return_inverse=True)
        counts = np.bincount(col * k + y[i + docs], minlength=len(here) * k).reshape(-1, k)
        merged, at = np.unique(np.concatenate([vocabulary, here]), return_inverse=True)
        total = np.zeros((len(merged), k), np.int64)
        total[at[: len(vocabulary)]] = seen
        total[at[len(vocabulary) :]] += counts
        vocabulary, seen = merged, total
    if not len(vocabulary):
        return vocabulary
    df = seen.sum(axis=1)
    often = df >= least
    vocabulary, seen, df = vocabulary[often], seen[often].astype(float), df[often]
    share = np.bincount(y, minlength=len(classes)) / len(y)
    n = np.bincount(y, minlength=len(classes)).astype(float)
    absent = n - seen
    with np.errstate(divide="ignore", invalid="ignore"):
        g = np.where(seen > 0, seen * np.log(seen / (df[:, None] * share)), 0).sum(1)
        g += np.where(absent > 0, absent * np.log(absent / ((len(y) - df)[:, None] * share)), 0).sum(1)
    best = np.lexsort((vocabulary, -g))[:size]
    return np.sort(vocabulary[best[g[best] > TELLING]])


def presence(texts: list[str | None], vocabulary: np.ndarray, prefixes: tuple[int, ...] = ()) -> Sparse:
    data, off = as_bytes(texts)
    parts = [(i, word_counts(data[off[i] : off[j]], off[i : j + 1] - off[i], vocabulary, prefixes)) for i, j in slices(off, CHUNK)]
    row, col, n = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*[(i + p[0], p[1], p[2]) for i, p in parts], strict=True)) if parts else (np.zeros(0, np.int64),) * 3
    return Sparse(row, col, np.log2(1.0 + n), len(texts))


def adam(parameters: np.ndarray, gradient: Callable[[np.ndarray], np.ndarray], steps: int = 500, rate: float = 0.05) -> np.ndarray:
    """Minimise by full-batch Adam with a falling rate: deterministic."""
    x, m, v = parameters.copy(), np.zeros_like(parameters), np.zeros_like(parameters)
    for t in range(1, steps + 1):
        g = gradient(x)
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        x -= rate * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return x


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)
