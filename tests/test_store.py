"""The store: scenarios of flushing, reopening, fencing and compaction, and random operations against a dict."""

from __future__ import annotations

import random
import time

import pytest

from sparkdoc.sources.cache import SegmentCache
from sparkdoc.sources.manifest import Manifest, ManifestStore, Segment
from sparkdoc.sources.objects import HadoopStore, MemoryStore, NotFoundError, PreconditionError, r2_options, s3_options
from sparkdoc.sources.store import ClosedError, StaleWriterError, Store


def items(df):
    return [(r.key, bytes(r.value)) for r in df.collect()]


def test_put_get_delete_reopen(spark, tmp_path):
    s = Store(spark, f"{tmp_path}/db")
    assert (s.put("a", b"1"), s.put("b", b"2"), s.delete("a"), s.put("c", b"")) == (1, 2, 3, 4)
    assert s.get("a").deleted and s.get("b").value == b"2" and s.get("c").deleted and s.get("x") is None
    assert items(s.scan()) == [("b", b"2")]
    s.flush()
    s.flush()
    s.put("lost", b"x")
    s.close()
    with pytest.raises(ClosedError):
        s.put("a", b"1")
    s = Store(spark, f"{tmp_path}/db")
    assert s.get("lost") is None and s.get("a").deleted and s.get("b").seq == 2
    assert s.put("d", b"4") == 5
    assert [e.key for e in s.scan_range("b", 5).entries] == ["d"]
    page = s.scan_range("", 1)
    assert [e.key for e in page.entries] == ["b"] and page.has_more and s.scan_range("", 0).has_more and not s.scan_range("", 2).has_more
    assert [(r.key, r.is_deleted) for r in s.scan_since(2).collect()] == [("a", True), ("c", True), ("d", False)]


def test_compaction_keeps_markers_and_history(spark, tmp_path):
    s = Store(spark, f"{tmp_path}/db", compaction_threshold=2)
    for n in range(3):
        s.put("k", str(n).encode())
        s.put(f"only{n}", b"x")
        s.flush()
    s.delete("only0")
    s.flush()
    version = s.manifest.version
    before = items(s.scan())
    assert s.maybe_compact() and not s.maybe_compact()
    assert items(s.scan()) == before == [("k", b"2"), ("only1", b"x"), ("only2", b"x")]
    assert len(s.manifest.l0) == 0 and s.manifest.sorted_runs[0].sstables[0].rows == 4 and s.get("only0").deleted
    assert items(s.snapshot(version)) == before
    s.put("new", b"n")
    s.flush()
    s.compact()
    assert len(s.manifest.sorted_runs) == 1 and items(Store(spark, f"{tmp_path}/db").scan()) == [*before[:1], ("new", b"n"), *before[1:]]


def test_stale_writer_commits_nothing(spark, tmp_path):
    old = Store(spark, f"{tmp_path}/db")
    old.put("a", b"old")
    new = Store(spark, f"{tmp_path}/db")
    with pytest.raises(StaleWriterError):
        old.flush()
    new.put("b", b"new")
    new.flush()
    assert items(Store(spark, f"{tmp_path}/db", read_only=True).scan()) == [("b", b"new")]


def test_full_buffer_flushes_and_failure_keeps_it(spark, tmp_path, monkeypatch):
    s = Store(spark, f"{tmp_path}/db", max_buffer_bytes=400)
    s.put("a", b"x" * 10)
    assert not s.manifest.l0
    s.put("b", b"x" * 300)
    assert len(s.manifest.l0) == 1
    s.put("c", b"y")
    with monkeypatch.context() as m:
        m.setattr(s.manifests, "save", lambda _: (_ for _ in ()).throw(OSError("down")))
        with pytest.raises(OSError):
            s.flush()
    s.flush()
    assert [k for k, _ in items(s.scan())] == ["a", "b", "c"]


def test_bulk_write_batches_vacuum(spark, tmp_path):
    s = Store(spark, f"{tmp_path}/db", "string")
    s.write(spark.createDataFrame([("a", "1"), ("b", None)], "key string, value string"), batch=0)
    s.write(spark.createDataFrame([("a", "again")], "key string, value string"), batch=0)
    s.write(spark.createDataFrame([("b", "2")], "key string, value string"), batch=1)
    assert [(r.key, r.value) for r in s.scan().collect()] == [("a", "1"), ("b", "2")]
    s.compact()
    assert len(s.vacuum()) == 2 and [(r.key, r.value) for r in s.scan().collect()] == [("a", "1"), ("b", "2")]


@pytest.mark.parametrize("seed", [1, 2])
def test_random_operations_match_a_dict(spark, tmp_path, seed):
    rng, model, seq = random.Random(seed), {}, 0
    s = Store(spark, f"{tmp_path}/db", compaction_threshold=2)
    flushed = ({}, 0)
    for _ in range(60):
        r, key = rng.random(), f"k{rng.randrange(8)}"
        if r < 0.5:
            seq += 1
            model[key] = (seq, str(seq).encode())
            assert s.put(key, model[key][1]) == seq
        elif r < 0.65:
            seq += 1
            model[key] = (seq, None)
            assert s.delete(key) == seq
        elif r < 0.82:
            s.flush()
            flushed = (dict(model), seq)
        elif r < 0.9:
            s.flush()
            flushed = (dict(model), seq)
            s.maybe_compact()
        elif r < 0.94:
            s.close()
            s = Store(spark, f"{tmp_path}/db", compaction_threshold=2)
            model, seq = dict(flushed[0]), flushed[1]
        else:
            assert items(s.scan()) == sorted((k, v) for k, (_, v) in model.items() if v is not None)
            got = s.get(key)
            assert (got and (got.seq, got.value)) == model.get(key)
    assert items(s.scan()) == sorted((k, v) for k, (_, v) in model.items() if v is not None)


@pytest.mark.parametrize("kind", ["memory", "hadoop"])
def test_object_stores(spark, tmp_path, kind):
    o = MemoryStore() if kind == "memory" else HadoopStore(spark, f"file://{tmp_path}/objects")
    o.put("a/1", b"hello", if_none_match=True)
    with pytest.raises(PreconditionError):
        o.put("a/1", b"x", if_none_match=True)
    o.put("a/2", b"y")
    o.put("b", b"z")
    assert o.get("a/1") == b"hello" and o.get_range("a/1", 1, 3) == b"ell" and o.get_range("a/1", 3, 99) == b"lo"
    with pytest.raises(ValueError):
        o.get_range("a/1", 9, 1)
    assert o.head("a/1").size == 5 and o.list("a/") == ["a/1", "a/2"] and o.list() == ["a/1", "a/2", "b"] and o.list("zz/") == []
    o.delete("a/1")
    o.delete("a/1")
    assert not o.exists("a/1") and o.exists("b")
    with pytest.raises(NotFoundError):
        o.get("a/1")


def test_manifests():
    m = ManifestStore(MemoryStore())
    assert m.latest() is None
    first = Manifest().next(writer_epoch=1, l0=(Segment("s", "p", "a", "b", 1, 41, 9, 3),))
    m.save(first)
    with pytest.raises(PreconditionError):
        m.save(first)
    assert m.latest().last_seq_num == 41 and m.versions() == [1]
    m.save(m.latest().next(last_seq_num=50))
    assert m.latest().version == 2 and m.latest().last_seq_num == 50 and m.load(1).l0 == first.l0


def test_s3_settings():
    assert r2_options("acc", "a", "b")["spark.hadoop.fs.s3a.endpoint.region"] == "auto"
    assert s3_options("http://x")["spark.hadoop.fs.s3a.path.style.access"] == "true" and s3_options() == {}
    with pytest.raises(ValueError):
        s3_options(access_key="a")


def test_segment_cache(spark, tmp_path):
    frame = lambda n: spark.range(n)
    c = SegmentCache(100)
    a = c.put("a", frame(1), 40)
    c.put("b", frame(2), 40)
    assert c.get("a") is a and a.is_cached and len(c) == 2 and c.size == 80
    c.put("c", frame(3), 50)  # b was used longest ago
    assert "b" not in c and "a" in c and c.get("x") is None
    assert not c.put("large", frame(4), 101).is_cached and "large" not in c
    assert c.load("a", 40, lambda: 1 / 0) is a
    c.clear()
    assert len(c) == 0 and not a.is_cached
    s = Store(spark, f"{tmp_path}/db", "string", cache=SegmentCache.on_disk())
    for k in ("a", "b"):
        s.put(k, k)
        s.flush()
    assert [r.key for r in s.scan().collect()] == [r.key for r in s.scan().collect()] == ["a", "b"] and len(s.cache) == 2
    s.close()
    assert len(s.cache) == 0


def test_background_compaction(spark, tmp_path):
    s = Store(spark, f"{tmp_path}/db", "string", compaction_threshold=2)
    for k in ("a", "b"):
        s.put(k, k)
        s.flush()
    s.compact_every(0.2)
    until = time.time() + 60
    while s.manifests.latest().l0 and time.time() < until:
        time.sleep(0.2)
    assert not s.manifests.latest().l0 and [r.key for r in s.scan().collect()] == ["a", "b"]
    s.close()


def test_conditional_create_by_rename(spark, tmp_path):
    """As on file systems that aren't local: a draft is renamed, one of two writers wins, and nobody sees a part."""
    store = HadoopStore(spark, f"file://{tmp_path}/o")
    store._local = None
    store.put("m/1", b"first", if_none_match=True)
    with pytest.raises(PreconditionError):
        store.put("m/1", b"second", if_none_match=True)
    raced, create = [], store._fill

    def slow(out, data):  # another writer commits while this one's draft is written
        create(out, data)
        if not raced:
            raced.append(1)
            assert store.list("m/") == ["m/1"]
            HadoopStore(spark, f"file://{tmp_path}/o").put("m/2", b"winner", if_none_match=True)

    store._fill = slow
    with pytest.raises(PreconditionError):
        store.put("m/2", b"loser", if_none_match=True)
    assert store.get("m/2") == b"winner" and store.get("m/1") == b"first" and store.list("m/") == ["m/1", "m/2"]
    assert not [p for p in (tmp_path / "o/m").iterdir() if "draft" in p.name and not p.name.endswith(".crc")]
