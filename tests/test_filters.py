"""Every filter operator over scalars, arrays, missing and empty values, typed and loose."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from sparkdoc.operators.filters import Filter, FilterError, columns_of, predicate, search, validate

DOCS = [
    ("d1", "red", 1.5, True, ["a", "b"], [1, 2]),
    ("d2", "blue", 2.0, False, ["b", None], [3]),
    ("d3", "red", 10.0, None, [], []),
    ("d4", None, None, True, None, [None]),
    ("d5", "", 0.0, False, ["c"], [None, 5]),
]
FIELDS = ("color", "score", "active", "tags", "nums")
SCHEMA = "id string, color string, score double, active boolean, tags array<string>, nums array<long>"


def value(x):
    return isinstance(x, (str, bool, int, float))


def kind(x):
    return "b" if isinstance(x, bool) else "s" if isinstance(x, str) else "n"


def model(doc: dict, f: Filter) -> bool:
    """What a filter means, one document at a time."""
    raw = doc.get(f.field)
    have = [x for x in (raw if isinstance(raw, list) else [raw]) if value(x)]
    same = lambda v: value(v) and any(kind(x) == kind(v) and x == v for x in have)
    if f.op in ("eq", "contains"):
        return same(f.value)
    if f.op == "neq":
        return bool(have) and not same(f.value)
    if f.op == "in":
        return any(same(v) for v in f.value)
    test = {"gt": lambda x: x > f.value, "gte": lambda x: x >= f.value, "lt": lambda x: x < f.value, "lte": lambda x: x <= f.value}[f.op]
    return any(kind(x) == "n" and test(x) for x in have)


VALUES = ["red", "", "a", "b", 1, 1.5, 2, 5, True, False, None, [1], "1"]
CASES = [Filter(f, op, v) for f in (*FIELDS, "unknown") for op in ("eq", "neq", "contains") for v in VALUES]
CASES += [Filter(f, op, v) for f in (*FIELDS, "unknown") for op in ("gt", "gte", "lt", "lte") for v in (-1, 1.5, 2, 100)]
CASES += [Filter(f, "in", v) for f in FIELDS for v in ([], ["red", 2], [True, "b", 3], (1.5, None))]


@pytest.fixture(scope="module")
def both(spark):
    typed = spark.createDataFrame(DOCS, SCHEMA)
    loose = spark.createDataFrame([(d[0], json.dumps({k: v for k, v in zip(FIELDS, d[1:], strict=True) if v is not None})) for d in DOCS], "id string, attributes string")
    return typed, loose.withColumn("v", F.parse_json("attributes"))


def test_all_cases(both):
    typed, loose = both
    columns = {c: (typed[c], typed.schema[c].dataType) for c in FIELDS}
    hits = [predicate([c], columns=columns) for c in CASES]
    loose_hits = [predicate([c], attributes=loose["v"]) for c in CASES]
    got = {r.id: r for r in typed.select("id", F.array(*hits).alias("h")).collect()}
    for part in range(0, len(CASES), 60):
        found = loose.select("id", F.array(*loose_hits[part : part + 60]).alias("h")).collect()
        for r in found:
            doc = dict(zip(FIELDS, next(d for d in DOCS if d[0] == r.id)[1:], strict=True))
            for c, hit, typed_hit in zip(CASES[part:], r.h, got[r.id].h[part:], strict=False):
                assert hit == model(doc, c), (r.id, c)
                assert typed_hit == model(doc, c), (r.id, c)


def test_and_order_pages(both):
    typed, _ = both
    ids = lambda *a, **k: [r.id for r in search(typed, *a, **k).collect()]
    assert ids([]) == ["d1", "d2", "d3", "d4", "d5"]
    assert ids([Filter("color", "eq", "red"), Filter("score", "gt", 2)]) == ["d3"]
    assert ids([Filter("nums", "gt", 1), Filter("nums", "lt", 2)]) == ["d1"]
    assert ids([], 2, 1) == ["d2", "d3"] and ids([], 0, 3) == ["d4", "d5"] and ids([], 2, -5) == ["d1", "d2"] and ids([], 2, 9) == []
    assert ids([Filter("color", "eq", "red")], indexed=["score"]) == []


@pytest.mark.parametrize("bad", [Filter("", "eq", 1), Filter("a", "like", 1), Filter("a", "gt", "1"), Filter("a", "lt", True), Filter("a", "in", "abc")])
def test_meaningless_filters(bad):
    with pytest.raises(FilterError):
        validate([bad])


def test_filters_reach_the_scan(spark, tmp_path):
    """The plan names every scalar comparison among the filters that the Parquet reader gets."""
    rows = [(i, "en" if i % 3 else "de", 100 * i, bool(i % 2), i / 2) for i in range(40)]
    spark.createDataFrame(rows, "id long, lang string, n_chars long, active boolean, score double").write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    wanted = [
        (Filter("lang", "eq", "en"), "EqualTo(lang,en)"), (Filter("n_chars", "gt", 1000), "GreaterThan(n_chars,1000)"), (Filter("n_chars", "gte", 1000), "GreaterThanOrEqual(n_chars,1000)"), (Filter("n_chars", "lt", 9), "LessThan(n_chars,9)"),
        (Filter("n_chars", "lte", 9), "LessThanOrEqual(n_chars,9)"), (Filter("lang", "neq", "en"), "Not(EqualTo(lang,en))"), (Filter("lang", "in", ["en", "fr", 7]), "In(lang, [en,fr])"), (Filter("score", "gt", 2.5), "GreaterThan(score,2.5)"),
    ]
    for f, text in wanted:
        plan = docs.where(predicate([f], columns=columns_of(docs)))._jdf.queryExecution().executedPlan().toString()
        assert text in plan.split("PushedFilters: ", 1)[1].split("]\n")[0].split(", ReadSchema")[0], f
    plan = search(docs, [f for f, _ in wanted[:2]])._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lang,en)" in plan and "GreaterThan(n_chars,1000)" in plan and "coalesce" not in plan
    assert [r.id for r in search(docs, [f for f, _ in wanted[:2]]).collect()] == [i for i in range(11, 40) if i % 3]
