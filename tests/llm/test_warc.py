"""WARC records round trip; the loser tree and the histories against sorting."""

from __future__ import annotations

import hashlib
import heapq
import io
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkdoc.llm import _spark
from sparkdoc.llm import warc as w
from sparkdoc.llm._spark import Scratch


def rows() -> list[tuple]:
    rng = random.Random(6)
    same, small = "é" * 500, "s" * 999
    out = [(i, f"http://www.Ex{rng.randrange(4)}.com:80/A/{rng.randrange(3)}?q={rng.randrange(2)}#f", f"<p>{i}</p>" * rng.randrange(0, 400), "t") for i in range(200)]
    out += [(300 + i, "https://hot.example.org/", same, "t") for i in range(150)] + [(500, "u v\r\nX: y", small, "t"), (501, None, small, "t")]
    out += [(502, "http://a", None, None), (503, "http://a", "", None), (None, "http://b", same, None), (700, "http://c", "z" * 1000, None), (700, "http://c", "z" * 1000, None), (699, "http://c", "z" * 1000, None)]
    return out


def want(data: list[tuple]) -> list[tuple]:
    out = []
    for page, _, html, _ in data:
        payload = (html or "").encode()
        same = [r[0] for r in data if (r[2] or "").encode() == payload and r[0] is not None]
        newest = max(same, default=None)
        revisit = len(payload) >= 1000 and page is not None and page < newest
        out.append((page, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if revisit else "response", newest if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("broadcast_rows", [w.BROADCAST_ROWS, 0])
def test_round_trip(spark, broadcast_rows):
    pages = spark.createDataFrame(rows(), "page_id long, url string, html string, digest string").repartition(3)
    got = w.archive(pages, broadcast_rows=broadcast_rows).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == want(rows())
    history = Counter(r.urlkey for r in got)
    for key, n in history.items():
        mine = sorted((r.capture_no, r.page_id is not None, r.page_id or 0) for r in got if r.urlkey == key)
        assert [m[0] for m in mine] == list(range(n)) and [m[1:] for m in mine] == sorted(m[1:] for m in mine)
    assert history["org,example,hot)/"] == 150
    assert w.archive(pages.limit(0)).count() == 0


def test_history_of_a_url_that_spans_ranges(spark):
    pages = spark.createDataFrame(rows(), "page_id long, url string, html string, digest string").repartition(4)
    scratch = Scratch(spark)
    runs = w.write(pages, scratch.folder("warc"), scratch)
    got = sorted((r.pid, r.idx, r.urlkey, r.captured, r.page_id is not None, r.page_id or 0, r.capture_no) for r in w.merge_index(runs, scratch, range_rows=40).collect())
    assert len({g[0] for g in got}) > 3
    keys = [g[2:6] for g in got]
    assert keys == sorted(keys) and len(keys) == len(rows())
    seen = Counter()
    for g in got:
        assert g[6] == seen[g[2]]
        seen[g[2]] += 1


def test_large_ids_keep_their_order(spark):
    ids = [5, 10**9 - 1, 10**9, 3 * 10**9, 2**40, 2**62, -7, -(2**50), None]
    assert [w.capture_time(i) for i in sorted(i for i in ids if i is not None)] == sorted(w.capture_time(i) for i in ids if i is not None)
    got = w.archive(spark.createDataFrame([(i, "http://a/", f"x{i}") for i in ids], "page_id long, url string, html string")).collect()
    mine = {r.page_id: r.capture_no for r in got}
    known = sorted(i for i in ids if i is not None)
    assert sorted(known, key=mine.get) == known


def test_nothing_large_is_broadcast_and_nothing_stays(spark, tmp_path, monkeypatch):
    plans = []
    kept = Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df, tag: (plans.append((tag, df._jdf.queryExecution().executedPlan().toString())), kept(self, df, tag))[1])
    monkeypatch.setattr(_spark, "shared_dir", lambda spark: f"file://{tmp_path}/shared")
    pages = spark.createDataFrame(rows(), "page_id long, url string, html string, digest string")
    got = w.archive(pages)
    joined = dict(plans)["records"]
    assert "SortMergeJoin" in joined and joined.count("BroadcastExchange") <= 2  # where a URL's count goes on; hot payloads
    stays = lambda: [p.name.split("-")[0] for p in (tmp_path / "shared").iterdir()]
    assert stays() == ["records"] and got.count() == len(rows())
    with pytest.raises(Exception, match="no"):
        w.archive(pages.withColumn("html", F.raise_error(F.lit("no")).cast("string")))
    assert stays() == ["records"]


def test_loser_tree():
    rng = random.Random(1)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted(rng.choices(range(40), k=rng.randrange(0, 30))) for _ in range(k)]
        assert list(w.LoserTree([iter(r) for r in runs])) == list(heapq.merge(*runs))
    assert w.natural_runs([1, 2, 2, 1, 5, 0]) == [(0, 3), (3, 5), (5, 6)] and w.natural_runs([]) == []


def test_records():
    payload = "<p>x\r\n\r\ny</p>".encode()
    digest = hashlib.sha1(payload).hexdigest()
    one, two = w.encode(4, "http://a/ b", payload, digest, None), w.encode(3, None, payload, digest, 4)
    stream = w.member(one) + w.member(two)
    for chunk in (1, 7, 1 << 20):
        found = list(w.members(io.BytesIO(stream), chunk))
        assert [f[2] for f in found] == [one, two] and found[1][0] == found[0][1]
    assert w.decode(one)["payload"] == payload and w.decode(two)["refers_to"] == 4 and b"http://a/%20b" in one
    with pytest.raises(ValueError):
        list(w.members(io.BytesIO(stream[:-3])))
    with pytest.raises(ValueError):
        w.decode(one.replace(b"<p>x", b"<p>z"))


@pytest.mark.parametrize(("url", "key"), [("http://www.A.com/B?c#d", "com,a)/b?c"), ("https://u@x.y.org:8080", "org,y,x:8080)/"), ("https://x.org:443/", "org,x)/"), ("no url", "no url"), ("", "")])
def test_url_key(url, key):
    assert w.url_key(url) == key
