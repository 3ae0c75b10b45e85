"""The pipeline against a brute-force version, stage by stage and as a whole."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

import corpus_pipeline as p
from sparkdoc.llm import mixing, sharding, toxicity
from sparkdoc.llm._text import as_bytes
from tests.llm.test_decontaminate import brute as contamination
from tests.llm.test_decontaminate import tokens
from tests.llm.test_simhash import brute as links
from tests.llm.test_simhash import fingerprint

LANGS = {"en": "the of and to", "de": "der und ein zu", "fr": "le et un que", "es": "el y los por"}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(12)
    passage = " ".join(f"leak{i}" for i in range(14))
    docs = []
    for i in range(260):
        lang = rng.choices(list(LANGS), [6, 2, 2, 1])[0]
        words = rng.choices(LANGS[lang].split() + [f"{lang}{k}" for k in range(200)], k=rng.randrange(30, 160))
        if i % 9 == 0:
            words += rng.choices(["vile", "foul", "rotten"], k=4)
        if i % 17 == 3:
            words += passage.split()[2:12]
        rng.shuffle(words) if i % 17 != 3 else None
        docs.append((i, " ".join(words), lang, f"s{i % 3}"))
    docs += [(300 + i, docs[i][1], docs[i][2], "s0") for i in range(1, 40, 2)]
    docs += [(400 + i, docs[i][1] + " end", docs[i][2], "s0") for i in range(2, 30, 4)]
    docs += [(500, None, None, None), (501, "", "en", "s1"), (None, "the of nobody", "en", "s1"), (None, docs[1][1], "en", "s1")]
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(*d, len(d[1] or "")) for d in docs], SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 9 == 0)) for i in range(200)] + [(None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, passage), (2, "too short"), (3, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def draw(doc_id: int | None, text: str | None) -> float:
    signed = lambda h: (h - (1 << 64) if h >> 63 else h).to_bytes(8, "little", signed=True)
    first = xxhash.xxh64_intdigest(str(doc_id) if doc_id is not None else text or "", seed=42)
    return (xxhash.xxh64_intdigest(b"rate", seed=xxhash.xxh64_intdigest(signed(first), seed=42)) >> 11) / (1 << 53)


def brute(spark, folder: str) -> tuple[Counter, list[int]]:
    """Rows by (id, text) with their counts, and the loads of the shards."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    tables = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.train(*tables)
    clean = [d for d in docs if model.above(model.scores(*as_bytes([d[1]])))[0, 0] < toxicity.REJECT]
    _, root = links([fingerprint(d[1]) for d in clean])
    least: dict[int, int | None] = defaultdict(lambda: None)
    for d, r in zip(clean, root, strict=True):
        if d[0] is not None:
            least[r] = d[0] if least[r] is None else min(least[r], d[0])
    one = [d for d, r in zip(clean, root, strict=True) if d[0] is None or d[0] == least[r]]
    kept = [d for d in one if contamination(d[1], items)[2] == 0]
    domain, steps, scale = mixing.plan(spark.createDataFrame(kept, "doc_id long, text string"), *tables)
    q, _ = domain.posteriors(*as_bytes([d[1] for d in kept]))
    rates = mixing._rates(q, steps) * scale
    assert np.allclose(rates, own_rates(q, [len(tokens(d[1])) for d in kept], domain.domains), atol=1e-4) and rates.min() > 1 - 1e-9
    copies = [int(np.floor(r + 1e-9)) + (draw(*d) < r - np.floor(r + 1e-9)) for d, r in zip(kept, rates, strict=True)]
    rows = Counter({d: int(n) for d, n in zip(kept, copies, strict=True)})
    groups: Counter = Counter()
    for d, n in rows.items():
        groups[d[1] or ""] += n * (len((d[1] or "").encode()) + 1)
    capacity = max(max(groups.values()), -(-sum(groups.values()) // p.SHARDS))
    while max(sharding.naive(list(groups.values()), capacity)) >= p.SHARDS:
        capacity += 1
    loads = Counter()
    for size, b in zip(sorted(groups.values(), reverse=True), sharding.naive(list(groups.values()), capacity), strict=True):
        loads[b] += size
    assert sorted(loads.values()) == own_loads(list(groups.values()), capacity)
    return rows, sorted(loads.values())


def own_rates(q: np.ndarray, n: list[int], domains: list[str]) -> np.ndarray:
    """The rates nearest to 1 (by tokens) at which the named domains' expected tokens stand as their targets do, least rate 1: by linear equations."""
    gram = (q * np.array(n, float)[:, None]).T @ q
    have, weight = gram.sum(axis=1), np.array([mixing.TARGETS[d] for d in domains])
    weight = weight / weight.sum()
    move = np.linalg.solve(gram, have - weight * (have / weight).max())
    pure = 1 - move
    assert pure.min() > 0  # so no rate had to be projected
    return (1 - q @ move) / pure.min()


def own_loads(sizes: list[int], capacity: int) -> list[int]:
    """Each size, the largest first, into the fullest bin that holds it."""
    loads: list[int] = []
    for size in sorted(sizes, reverse=True):
        fits = [b for b, load in enumerate(loads) if load + size <= capacity]
        if fits:
            loads[max(fits, key=loads.__getitem__)] += size
        else:
            loads.append(size)
    return sorted(loads)


def test_run_matches_brute_force(spark, sf_dir):
    out = p.run(spark, sf_dir)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard", "slot"]
    got = out.collect()
    rows, loads = brute(spark, sf_dir)
    assert Counter((r.doc_id, r.text) for r in got) == rows
    load, slots, shard_of = Counter(), defaultdict(list), defaultdict(set)
    for r in got:
        load[r.shard] += len((r.text or "").encode()) + 1
        slots[r.shard].append(r.slot)
        shard_of[r.text or ""].add(r.shard)
    assert sorted(load.values()) == loads
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in shard_of.values())
    ids = {r.doc_id for r in got}
    assert not ids & {i for i in range(0, 260, 9)} and not ids & {i for i in range(3, 260, 17)} and not ids & set(range(300, 340)) and {4, 5, 7} <= ids


def test_stages_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in p.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.schema.names == docs.schema.names and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    for _, stage in p.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
