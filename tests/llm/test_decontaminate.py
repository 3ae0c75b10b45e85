"""Decontamination against a brute-force search of every window."""

from __future__ import annotations

import hashlib
import random
import re
import time

import pytest

from sparkdoc.llm import decontaminate as d
from sparkdoc.llm._text import as_bytes

DOCS = "doc_id long, text string, lang string, items string, row string"


def tokens(text: str | None) -> list[str]:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text: str | None, items: list[tuple[object, str | None]], min_items: int = 2) -> tuple:
    doc, hit, found = tokens(text), set(), set()
    for item, passage in items:
        words = tokens(passage)
        n = min(8, len(words))
        windows = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if n and item is not None else set()
        for p in range(len(doc) - n + 1):
            if windows and tuple(doc[p : p + n]) in windows:
                hit |= set(range(p, p + n))
                found.add(str(item))
    return len(doc), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= min_items


def fixture(seed: int = 1) -> tuple[list, list]:
    rng = random.Random(seed)
    vocabulary = ["a", "b", "Cc", "é", "Ünï", "x1", "long" * 10, "the", "of", "naïve"]
    text = lambda n: rng.choice(["", " "]) + rng.choice([" ", ", ", "\n", "-"]).join(rng.choices(vocabulary, k=n))
    items = [(i, text(rng.choice([3, 8, 12, 30]))) for i in range(12)]
    items += [(12, None), (13, ""), (14, "..."), (None, text(9)), (15, "Solo"), (16, items[0][1]), (0, items[1][1]), (17, " ".join(["the"] * 20))]
    docs = []
    for i in range(60):
        parts = [text(rng.randrange(0, 40)) for _ in range(3)]
        for k in range(2):
            passage = tokens(rng.choice(items)[1])
            cut = rng.randrange(0, max(1, len(passage) - 8))
            parts[k] += f" {'; '.join(passage[cut : cut + rng.choice([5, 8, 20])]).upper()}"
        docs.append((i, " ".join(parts), "en", "z", "z"))
    docs += [(100, None, None, None, None), (101, "", "en", "z", "z"), (102, "solo", "en", "z", "z"), (103, "the " * 3000, "en", "z", "z"), (None, items[3][1], "en", "z", "z"), docs[0], docs[0]]
    return docs, items


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_matches_brute_force(spark, tmp_path, block_bytes):
    docs, items = fixture()
    spark.createDataFrame(docs, DOCS).repartition(3).write.parquet(f"{tmp_path}/d")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = d.decontaminate(spark.read.parquet(f"{tmp_path}/d"), bench, block_bytes=block_bytes).collect()
    want = sorted(((r[0], *brute(r[1], items)) for r in docs), key=str)
    assert sorted((tuple(r) for r in got), key=str) == want
    assert sum(w[5] for w in want) > 5


def test_repeats_on_both_sides_take_linear_time():
    """Equal words, equal items and long words: each place of a document is looked up once."""
    for text, passage in (("same " * 20000, "same " * 20000), ("a b " * 10000, "b a " * 10000), ("x" * 200_000 + " same" * 20000, "same " * 9)):
        begun = time.perf_counter()
        bench = d.Benchmark([("1", passage), ("2", passage), ("3", passage)])
        words = d.Words.of(*as_bytes([text]))
        p, n, of = bench.hits(words)
        assert time.perf_counter() - begun < 5
        doc, item = tokens(text), tokens(passage)
        windows = {tuple(item[i : i + 8]) for i in range(2)}
        assert len(p) == sum(tuple(doc[k : k + 8]) in windows for k in range(len(doc) - 7))
        assert {tuple(bench.sets[x]) for x in of} == {(0, 1, 2)}


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_hot_windows_and_repeated_texts(spark, block_bytes):
    """A passage in a third of all documents and in all items; columns of names that are used inside."""
    passage = "one two three four five six seven eight nine"
    docs = [(i, f"head {i} {passage} tail" if i % 3 else f"nothing {i}", "k", "v", "w") for i in range(300)] + [(1000 + i, passage, "k", "v", "w") for i in range(200)]
    items = [(i, f"{passage} item {i} " + "filler words here " * 4) for i in range(40)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, __digest string, n_words string, digest string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = d.decontaminate(frame, bench, block_bytes=block_bytes).collect()
    assert sorted(map(tuple, got)) == sorted((r[0], *brute(r[1], items)) for r in docs)
    kept = d.drop_contaminated(frame, bench, min_items=1, block_bytes=block_bytes)
    assert kept.columns == frame.columns and sorted(map(tuple, kept.collect())) == [r for r in docs if not brute(r[1], items)[2]]


def test_empty_tables(spark):
    docs, items = fixture()
    none = spark.createDataFrame([], "item_id long, text string")
    got = d.decontaminate(spark.createDataFrame(docs[:3], DOCS), none).collect()
    assert [(r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got] == [(0, 0, d.empty_digest(), False)] * 3
    assert d.decontaminate(spark.createDataFrame([], DOCS), spark.createDataFrame(items, none.schema)).count() == 0
