"""Benchmark decontamination by winnowing: shared fingerprints are found, then extended to whole windows.

Of every 4 neighbouring 5-word grams the one with the smallest hash is a fingerprint, on both
sides. A shared span of 8 words holds 4 such grams, so it shares a fingerprint at the same place:
every occurrence of an 8-word window of a benchmark item in a document is found, whatever else the
document holds. Around each shared fingerprint the windows that hold it are looked up among the
benchmark's distinct windows, each of which knows the set of its items: a place of a document is looked up
once, however often the benchmark repeats itself. Items of fewer than 8 words are windows of their own
length and are looked up by the hash of all their words.

A benchmark of at most ``block_bytes`` of text goes to all executors; the lookup runs beside the text, nothing
is shuffled, and windows are confirmed by their bytes. A larger one is joined: a bitmap of fixed size of
its fingerprints goes to the executors, the windows that it lets pass in one scan of the documents are shuffled
by their 128-bit hash to the benchmark's windows (the few hot ones are broadcast instead), and what they
hit comes back to the documents by the digest of their text, on which alone it depends.

Nulls and blanks: a null or empty text has no words and no hits; benchmark rows with a null item_id
or without words are ignored; several rows of one item_id count as one item. Documents with a null
or repeated doc_id keep one output row per input row. Empty tables on either side are fine.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkdoc.llm._spark import Scratch, carry, join_counted, map_texts, restore, slices, text_buffer
from sparkdoc.llm._text import as_bytes, words, xxh64

WINDOW, GRAM = 8, 5
GUARD = WINDOW - GRAM + 1
#: Benchmark text that each Python worker holds (about 15 times as much with its arrays); more is joined.
BLOCK_BYTES = 8 << 20
#: The bitmap of a larger benchmark has 2 ** BITS bits.
BITS = 27
#: Rows of texts with hits that are broadcast to their documents; more are shuffled.
BROADCAST_TEXTS = 250_000
#: Bytes of words that are compared at a time.
COMPARED = 4 << 20
_MAX = np.uint64(2**64 - 1)


@dataclass
class Words:
    """Words of a batch of texts: hashes, bounds of each text in words, and the bytes behind them."""

    low: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    @staticmethod
    def of(data: np.ndarray, off: np.ndarray) -> Words:
        low, s, e, first = words(data, off)
        return Words(low, s, e, first, xxh64(low, s, e - s))

    def stop(self) -> np.ndarray:
        """For each word, where its text ends."""
        return np.repeat(self.first[1:], np.diff(self.first))


_MIX = (np.uint64(0x9E3779B185EBCA87), np.uint64(0xC2B2AE3D27D4EB4F))


def _mixed(parts: Iterator[np.ndarray], size: int, which: int) -> np.ndarray:
    g = np.zeros(size, np.uint64)
    for part in parts:
        g = (g ^ part) * _MIX[which]
        g ^= g >> np.uint64(29)
    return np.minimum(g, _MAX - np.uint64(1))


def gram_hashes(w: Words, n: int) -> np.ndarray:
    """Hash of the n words from each word on; the largest value where a text ends before."""
    out = np.full(len(w.hash), _MAX, np.uint64)
    if len(w.hash) < n:
        return out
    m = len(w.hash) - n + 1
    g = _mixed((w.hash[k : k + m] for k in range(n)), m, 0)
    out[:m] = np.where(np.arange(m) + n <= w.stop()[:m], g, _MAX)
    return out


def window_hashes(w: Words, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the n words from each of the given places, which must lie in one text."""
    a, b = (_mixed((w.hash[at + k] for k in range(n)), len(at), which) for which in (0, 1))
    return a, b


def winnow(g: np.ndarray, guard: int = GUARD) -> np.ndarray:
    """Places whose gram is the least of some ``guard`` neighbours."""
    if not len(g):
        return np.zeros(0, np.int64)
    padded = np.concatenate([np.full(guard - 1, _MAX), g, np.full(guard - 1, _MAX)])
    least = padded[: len(padded) - guard + 1].copy()
    for k in range(1, guard):
        np.minimum(least, padded[k : len(padded) - guard + 1 + k], out=least)
    chosen = np.zeros(len(g), bool)
    for k in range(guard):
        chosen |= g == least[k : k + len(g)]
    return np.flatnonzero(chosen & (g != _MAX))


def item_windows(w: Words) -> Iterator[tuple[int, np.ndarray]]:
    """Length and first words of the windows of items: every 8 words, or all of a shorter item."""
    count = np.diff(w.first)
    at = np.arange(len(w.hash))
    yield WINDOW, at[at + WINDOW <= w.stop()]
    for n in sorted(set(count[(count > 0) & (count < WINDOW)].tolist())):
        yield n, w.first[:-1][count == n]


def candidates(d: Words, seen: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """First words of the 8-word windows around the document's fingerprints that ``seen`` takes for the benchmark's."""
    g = gram_hashes(d, GRAM)
    at = winnow(g)
    at = at[seen(g[at])]
    starts = np.unique(np.concatenate([at - (WINDOW - GRAM) + c for c in range(GUARD)])) if len(at) else at
    return starts[(starts >= 0) & (starts + WINDOW <= d.stop()[np.maximum(starts, 0)])] if len(starts) else starts


def equal_bytes(a: np.ndarray, at_a: np.ndarray, b: np.ndarray, at_b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether slices of equal lengths hold the same bytes."""
    out = np.ones(len(length), bool)
    total = np.concatenate([[0], np.cumsum(length)])
    i = 0
    while i < len(length):
        j = max(i + 1, int(np.searchsorted(total, total[i] + COMPARED, side="right")) - 1)
        n = length[i:j]
        inner = np.arange(total[j] - total[i]) - np.repeat(total[i:j] - total[i], n)
        wrong = a[np.repeat(at_a[i:j], n) + inner] != b[np.repeat(at_b[i:j], n) + inner]
        out[i:j] = np.bincount(np.repeat(np.arange(j - i), n)[wrong], minlength=j - i) == 0
        i = j
    return out


@dataclass
class _Windows:
    """Distinct windows of one length, sorted by their hashes: a place of each, and the number of its set of items."""

    a: np.ndarray
    b: np.ndarray
    at: np.ndarray
    items: np.ndarray
    most: int  # windows that share the first hash

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Index of each window, or -1."""
        lo, found = np.searchsorted(self.a, a), np.full(len(a), -1)
        for k in range(self.most):
            i = np.minimum(lo + k, len(self.a) - 1)
            hit = (self.a[i] == a) & (self.b[i] == b)
            found[hit] = i[hit]
        return found


class Benchmark:
    """A benchmark that fits in memory, ready for lookups."""

    def __init__(self, items: list[tuple[str, str]]) -> None:
        self.ids = sorted({i for i, _ in items})
        number = {i: k for k, i in enumerate(self.ids)}
        self.words = w = Words.of(*as_bytes([t for _, t in items]))
        owner = np.repeat(np.array([number[i] for i, _ in items], np.int64), np.diff(w.first))
        g = gram_hashes(w, GRAM)
        self.prints = np.unique(g[winnow(g)])
        self.sets: list[np.ndarray] = [np.array([k]) for k in range(len(self.ids))]  # one item each; others follow
        known: dict[bytes, int] = {}
        self.kinds: dict[int, _Windows] = {}
        for n, at in item_windows(w):
            if not len(at):
                continue
            a, b = window_hashes(w, at, n)
            order = np.lexsort((owner[at], b, a))
            a, b, at, item = a[order], b[order], at[order], owner[at][order]
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            apart = new.copy()
            apart[1:] |= item[1:] != item[:-1]
            item, begin = item[apart], np.flatnonzero(new[apart])
            size = np.diff(np.append(begin, len(item)))
            of = item[begin]
            for k in np.flatnonzero(size > 1).tolist():
                members = item[begin[k] : begin[k] + size[k]]
                of[k] = known.setdefault(members.tobytes(), len(self.sets))
                if of[k] == len(self.sets):
                    self.sets.append(members)
            a = a[new]
            self.kinds[n] = _Windows(a, b[new], at[new], of, int(np.diff(np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1], [True]]))).max()))

    def hits(self, d: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows found: first word in the documents, length, number of the set of items."""
        found = [np.zeros((0, 3), np.int64)]
        for n, known in self.kinds.items():
            if n == WINDOW:
                at = candidates(d, lambda g: np.isin(g, self.prints))
            else:
                h = gram_hashes(d, n)
                at = np.flatnonzero((h != _MAX) & np.isin(h, known.a))
            if not len(at):
                continue
            i = known.find(*window_hashes(d, at, n))
            at, i = at[i >= 0], i[i >= 0]
            sure, q = np.ones(len(at), bool), known.at[i]
            for k in range(n):
                length = d.end[at + k] - d.start[at + k]
                sure &= length == self.words.end[q + k] - self.words.start[q + k]
                m = np.flatnonzero(sure)
                sure[m] = equal_bytes(d.low, d.start[at[m] + k], self.words.low, self.words.start[q[m] + k], length[m])
            found.append(np.stack([at[sure], np.full(int(sure.sum()), n), known.items[i[sure]]], axis=1))
        rows = np.concatenate(found)
        return rows[:, 0], rows[:, 1], rows[:, 2]


def _kernel(items: list[tuple[str, str]]):
    def make():
        bench = Benchmark(items)

        def apply(data: np.ndarray, off: np.ndarray) -> list:
            d = Words.of(data, off)
            n_words = np.diff(d.first)
            p, n, of = bench.hits(d)
            edge = np.zeros(len(d.hash) + 1, np.int64)
            np.add.at(edge, p, 1)
            np.add.at(edge, p + n, -1)
            covered = np.cumsum(edge)[:-1] > 0
            spans: list = [[] for _ in n_words]
            names: list = [[] for _ in n_words]
            text = np.searchsorted(d.first, p, "right") - 1
            pairs = np.unique(np.stack([text, of], axis=1), axis=0)
            hit, begin = np.unique(pairs[:, 0], return_index=True)
            for t, i, j in zip(hit, begin, np.append(begin, len(pairs))[1:], strict=True):
                inside = np.flatnonzero(np.diff(covered[d.first[t] : d.first[t + 1]], prepend=False, append=False))
                spans[t] = inside.reshape(-1, 2).tolist()
                names[t] = [bench.ids[k] for k in np.unique(np.concatenate([bench.sets[x] for x in pairs[i:j, 1]]))]
            return [n_words, pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(names, pa.list_(pa.string()))]

        return apply

    return make


_SPANS = T.ArrayType(T.ArrayType(T.LongType()))
_FOUND = [("n_words", T.LongType()), ("spans", _SPANS), ("items", T.ArrayType(T.StringType()))]


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    rows = benchmark.select(benchmark[item_col].cast("string").alias("item"), benchmark[text_col].cast("string").alias("text"))
    return rows.where("item is not null and text is not null")


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES, keep: dict[str, str] | None = None) -> DataFrame:
    """One row per document: doc_id, kept columns, n_words, spans (word ranges hit, end exclusive, disjoint, in order), items (ids as strings, sorted)."""
    keep = keep or {}
    items = _items(benchmark, item_col, item_text_col)
    if (items.agg(F.sum(F.octet_length("text") + F.octet_length("item"))).first()[0] or 0) <= block_bytes:
        rows = [(r.item, r.text) for r in items.distinct().orderBy("item", "text").collect()]  # at most block_bytes
        return map_texts(docs, text_col, {"doc_id": id_col, **keep}, _FOUND, _kernel(rows))
    with Scratch(docs.sparkSession) as scratch:
        text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
        hits = scratch.keep(_joined(docs.select(F.md5(text).alias("digest"), text.alias("text")), items, scratch), "hits")
        scratch.only(hits)
        counted = lambda: lambda data, off: [np.diff(Words.of(data, off).first)]
        source = docs.select(docs[id_col].alias("__id"), F.md5(text).alias("__digest"), *[docs[c].alias(k) for k, c in keep.items()], docs[text_col].alias("__text_"))
        at = next((k for k, c in keep.items() if c == text_col), "__text_")
        rows = map_texts(source, at, {"doc_id": "__id", "__digest": "__digest", **{k: k for k in keep}}, [("n_words", T.LongType())], counted)
        few = hits.count() <= BROADCAST_TEXTS
        found = rows.join(F.broadcast(hits) if few else hits, F.col("__digest") == F.col("digest"), "left")
    return found.select("doc_id", *keep, "n_words", F.coalesce("spans", F.array().cast(_SPANS)).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


_WINDOW = "n long, a long, b long"


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of the items of a batch: item, n, a, b; and their fingerprints, as n = 0 and the gram's hash."""
    for batch in batches:
        names = batch.column(0)
        w = Words.of(*as_bytes(batch.column(1).to_pylist()))
        owner = np.repeat(np.arange(batch.num_rows), np.diff(w.first))
        g = gram_hashes(w, GRAM)
        at = winnow(g)
        parts = [(at, 0, g[at], g[at]), *((at, n, *window_hashes(w, at, n)) for n, at in item_windows(w))]
        for at, n, a, b in parts:
            if len(at):
                yield pa.RecordBatch.from_arrays([names.take(pa.array(owner[at])), pa.array(np.full(len(at), n)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["item", "n", "a", "b"])


def _bits(a: np.ndarray, n: int) -> np.ndarray:
    return ((a ^ np.uint64(n * 0x9E3779B1)) & np.uint64((1 << BITS) - 1)).astype(np.int64)


def _joined(texts: DataFrame, items: DataFrame, scratch: Scratch) -> DataFrame:
    """(digest, spans, items) of the texts (digest, text) that hold a window, whatever the size of the benchmark."""
    made = scratch.keep(items.mapInArrow(_windows, f"item string, {_WINDOW}").distinct(), "windows")
    # the bitmap holds fingerprints for windows of 8 words, and the windows themselves for shorter ones
    place = F.expr(f"cast((a ^ (n * {0x9E3779B1})) & {(1 << BITS) - 1} as long)")
    told = made.where(f"n <> {WINDOW}").select((F.shiftright(place, 3)).alias("at"), F.call_function("shiftleft", F.lit(1), place.bitwiseAND(F.lit(7)).cast("int")).alias("bit"))
    got = told.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()  # at most 2 ** (BITS - 3) rows
    bitmap = np.zeros(1 << (BITS - 3), np.uint8)
    bitmap[got.column(0).to_numpy()] = got.column(1).to_numpy()
    lengths = [r[0] for r in made.where(f"n > 0 and n < {WINDOW}").select("n").distinct().collect()]  # at most 7
    shared = texts.sparkSession.sparkContext.broadcast(bitmap)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        seen = lambda a, n: (known[_bits(a, n) >> 3] >> (_bits(a, n) & 7).astype(np.uint8) & 1).astype(bool)
        for batch in batches:
            data, off = text_buffer(batch.column(1))
            for i, j in slices(off, 1 << 20):
                d = Words.of(data[off[i] : off[j]], off[i : j + 1] - off[i])
                text = np.repeat(np.arange(i, j), np.diff(d.first))
                parts = [(WINDOW, candidates(d, lambda g: seen(g, 0)))]
                for n in lengths:
                    h = gram_hashes(d, n)
                    parts.append((n, np.flatnonzero((h != _MAX) & seen(h, n))))
                for n, at in parts:
                    if len(at):
                        a, b = window_hashes(d, at, n)
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0).take(pa.array(text[at])), pa.array(at - d.first[text[at] - i]), pa.array(np.full(len(at), n)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["digest", "p", "n", "a", "b"]
                        )

    key = ["n", "a", "b"]
    maybe = scratch.keep(texts.mapInArrow(scan, f"digest string, p long, {_WINDOW}").distinct(), "maybe")
    # windows of equal sets of items share one: told apart by size and two sums of hashes
    sets = F.struct(F.count("*").alias("n_items"), F.bit_xor(F.xxhash64("item")).alias("x"), F.bit_xor(F.xxhash64(F.lit("set"), "item")).alias("y"))
    windows = made.where("n > 0").groupBy(*key).agg(sets.alias("set"))
    places = maybe.groupBy(*key).agg(F.count("*").alias("places"))
    wanted = scratch.keep(windows.join(places, key), "wanted")
    hit = scratch.keep(join_counted(maybe, wanted, key, "places", maybe.count()).select("digest", "p", "n", "set"), "hit")
    one = wanted.groupBy("set").agg(F.min(F.struct(*key)).alias("w")).select("set", "w.*")
    members = made.join(one, key).select("set", "item")
    named = hit.select("digest", "set").distinct().join(members, "set").select("digest", "item").distinct()
    named = named.groupBy("digest").agg(F.array_sort(F.collect_list("item")).alias("items"))
    joined = F.aggregate(
        F.array_sort("ranges"),
        F.array().cast(_SPANS),
        lambda got, x: F.when((F.size(got) > 0) & (x["p"] <= F.element_at(got, -1)[1]), F.concat(F.slice(got, 1, F.size(got) - 1), F.array(F.array(F.element_at(got, -1)[0], F.greatest(F.element_at(got, -1)[1], x["p"] + x["n"]))))).otherwise(F.concat(got, F.array(F.array(x["p"], x["p"] + x["n"])))),
    )
    spans = hit.groupBy("digest").agg(F.collect_list(F.struct("p", "n")).alias("ranges")).select("digest", joined.alias("spans"))
    return spans.join(named, "digest")


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_items: int = 2, **names) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (at least ``min_items`` items occur)."""
    found = find(docs, benchmark, **names)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x[1] - x[0])
    n_items = F.size("items").cast("long")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), n_items.alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n_items >= min_items).alias("contaminated"))


def empty_digest() -> str:
    return hashlib.sha256(b"").hexdigest()


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, min_items: int = 2, **names) -> DataFrame:
    """``docs`` without those in which at least ``min_items`` items occur."""
    found = find(docs, benchmark, keep=carry(docs), **names)
    return restore(found.where(F.size("items") < min_items), docs)
