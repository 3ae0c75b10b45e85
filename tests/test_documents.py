"""Document tables: schemas, versions, searches, index maintenance."""

from __future__ import annotations

import datetime

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkdoc.functions.names import ulid, validate_name
from sparkdoc.functions.schema import FieldDefinition, FieldType, Schema, ValidationError, diff, violations
from sparkdoc.operators import fulltext as X
from sparkdoc.operators import vector as V
from sparkdoc.operators.filters import Filter
from sparkdoc.operators.table import Document, DocumentTable, FullTextUnavailableError, VectorUnavailableError
from sparkdoc.sources.objects import MemoryStore
from sparkdoc.sources.store import ClosedError, Store
from sparkdoc.streaming.index import Builder, StoreIndexer, load_checkpoint, save_checkpoint, start

SCHEMA = Schema({"title": FieldDefinition(FieldType.STRING, full_text=True), "kind": FieldDefinition(FieldType.STRING, indexed=True), "hidden": FieldDefinition(FieldType.STRING), "score": FieldDefinition(FieldType.FLOAT, indexed=True)}, "model-a", 2)


class Fixed:
    def embed(self, texts, model):
        return [[1.0, 0.0] if "fox" in t else [0.0, 1.0] for t in texts]


def test_three_searches(spark, tmp_path):
    with DocumentTable(spark, f"{tmp_path}", "docs", SCHEMA, Fixed()) as table:
        table.put_documents([Document("1", "the quick brown fox", {"title": "Animals", "kind": "note", "score": 1}), Document("2", "lazy dogs", {"title": "Storage Fox-Notes", "kind": "memo", "hidden": "x"})])
        assert [d.id for d in table.search_attributes([Filter("kind", "eq", "note")])] == ["1"]
        assert table.search_attributes([Filter("hidden", "eq", "x")]) == [] and [d.id for d in table.search_attributes([Filter("score", "gte", 1)])] == ["1"]
        found, total = table.search_text("fox")
        assert {d.id for d in found} == {"1", "2"} and total == 2
        assert [d.id for d in table.search_text("attr_title:storage")[0]] == ["2"] and table.search_text("attr_kind:note")[1] == 0
        assert [d.id for d in table.search_vector([1.0, 0.1], 1)] == ["1"] and [d.id for d in table.search_vector_by_text("a fox", 2)] == ["1", "2"]
        assert table.search_vector([1.0, 0.0], 0) == []
        with pytest.raises(V.DimensionError):
            table.search_vector([1.0], 1)
        table.delete_document("1")
        table.delete_document("1")
        assert table.get_document("1") is None and table.search_text("quick")[1] == 0
    with pytest.raises(ClosedError):
        table.get_document("2")


def test_versions_times_and_round_trip(spark, tmp_path):
    table = DocumentTable(spark, f"{tmp_path}", "docs")
    stamp = datetime.datetime(2020, 1, 2, 3, 4, 5, 678901, datetime.UTC)
    first = table.put_document(Document("a", "x", {"n": 1, "tags": ["p", "q"], "ok": True}, [0.5, 0.25], "m", stamp, None, 7))
    assert (first.version, first.created_at) == (7, stamp)
    got = table.get_document("a")
    assert (got.attributes, got.embedding, got.embedding_model, got.version, got.created_at) == ({"n": 1, "tags": ["p", "q"], "ok": True}, [0.5, 0.25], "m", 7, stamp)
    both = table.put_documents([Document("a", "y"), Document("a", "z"), Document(content="new")])
    assert [d.version for d in both] == [8, 8, 1] and len(both[2].id) == 26
    assert table.get_document("a").content == "z" and table.get_document("a").created_at == stamp
    table.delete_document("a")
    assert table.put_document(Document("a")).version == 1
    docs, more = table.list_documents(1)
    assert len(docs) == 1 and more
    with pytest.raises(ValidationError):
        table.put_document(Document("n", attributes={"x": float("nan")}))
    with pytest.raises(FullTextUnavailableError):
        DocumentTable(spark, f"{tmp_path}", "plain", full_text=False).search_text("x")
    with pytest.raises(VectorUnavailableError):
        table.search_vector([1.0], 1)


def test_bulk_is_all_or_nothing_and_frames_upsert(spark, tmp_path):
    table = DocumentTable(spark, f"{tmp_path}", "docs", SCHEMA)
    with pytest.raises(ValidationError):
        table.put_documents([Document("1", "ok"), Document("2", "bad", {"nope": 1})])
    assert table.documents().count() == 0
    rows = spark.createDataFrame([("1", "one", '{"kind": "a"}'), ("2", "two", None)], "id string, content string, attributes string")
    table.upsert(rows)
    table.upsert(rows.where("id = '2'"))
    assert {r.id: r.version for r in table.documents().collect()} == {"1": 1, "2": 2}
    with pytest.raises(ValidationError):
        table.upsert(rows.withColumn("attributes", F.lit('{"score": "high"}')))


def test_frames_are_embedded(spark, tmp_path):
    table = DocumentTable(spark, f"{tmp_path}", "docs", SCHEMA, Fixed())
    rows = [("1", "a fox", '{"kind": "x"}'), ("2", None, '{"title": "fox"}'), ("3", None, None), ("4", "dog", None)]
    table.upsert(spark.createDataFrame(rows, "id string, content string, attributes string"))
    got = {r.id: (r.embedding, r.embedding_model) for r in table.documents().collect()}
    assert got == {"1": ([1.0, 0.0], "model-a"), "2": ([1.0, 0.0], "model-a"), "3": (None, None), "4": ([0.0, 1.0], "model-a")}
    assert [d.id for d in table.search_vector([1.0, 0.0], 2)] == ["1", "2"]


def test_schema_change_skips_old_vectors(spark, tmp_path):
    table = DocumentTable(spark, f"{tmp_path}", "docs", SCHEMA, Fixed())
    table.put_document(Document("1", "fox", {"kind": "a"}))
    table.rebuild_indexes()
    assert table.index_status().last_indexed == table.store.last_seq
    assert [r.id for r in table.text_index().search(["fox"]).collect()] == ["1"]
    assert table.set_schema(SCHEMA.evolve(embedding_dims=3)).embedding
    assert table.search_vector([1.0, 0.0, 0.0], 5) == [] and [d.id for d in table.search_attributes([Filter("kind", "eq", "a")])] == ["1"]
    table.reset_indexes()
    assert table.index_status().last_indexed == 0
    table.wait_for_indexes()
    assert table.index_status().last_indexed == 1
    again = DocumentTable(spark, f"{tmp_path}", "docs", SCHEMA)
    assert again.get_document("1").content == "fox"


def test_validation():
    kinds = {t.value.replace("[]", "s_"): FieldDefinition(t) for t in FieldType}
    s = Schema({**kinds, "must": FieldDefinition(FieldType.STRING, required=True)})
    good = {"must": "", "string": "x", "int": 3.5, "float": 1, "bool": False, "s_string": [], "s_int": [1, 2.5], "s_float": (1.0,), "datetime": "2026-07-14T01:02:03Z", "reference": "id"}
    s.validate(good)
    bad = [{"must": None}, {}, {"must": "", "x": 1}, {"must": "", "int": True}, {"must": "", "bool": 0}, {"must": "", "s_string": ["a", 1]}, {"must": "", "s_int": "12"}, {"must": "", "datetime": "2026-07-14"}, {"must": "", "string": None}]
    for attributes in bad:
        with pytest.raises(ValidationError):
            s.validate(attributes)
    with pytest.raises(ValidationError):
        FieldType.parse("decimal")
    assert FieldType.parse("[]float") is FieldType.FLOATS


def test_validation_of_a_table(spark):
    s = Schema({"n": FieldDefinition(FieldType.INT, required=True), "d": FieldDefinition(FieldType.DATETIME), "t": FieldDefinition(FieldType.STRINGS), "b": FieldDefinition(FieldType.BOOL)})
    rows = ['{"n": 1}', '{"n": "1"}', "{}", None, '{"n": 2, "x": 1}', '{"n": 1, "d": "2026-07-14"}', '{"n": 1, "d": "2026-07-14T01:02:03+02:00"}', '{"n": 1, "t": ["a", 1]}', '{"n": 1, "t": ["a"], "b": true}', '{"n": null}', '{"n": 1, "b": null}']
    got = [r[0] for r in spark.createDataFrame([(r,) for r in rows], "a string").select(violations(s, F.col("a"))).collect()]
    assert got == [[], ["type n"], ["missing n"], ["missing n"], ["unknown x"], ["type d"], [], ["type t"], [], ["type n"], ["type b"]]


def test_diff_and_names():
    assert not diff(SCHEMA, SCHEMA) and diff(SCHEMA, SCHEMA.evolve(embedding_model="b")).embedding
    changed = diff(SCHEMA, Schema({"title": FieldDefinition(FieldType.STRING, indexed=True)}, "model-a", 2))
    assert changed.indexed and changed.full_text and not changed.embedding
    for bad in ("", ".", "..", "a/b", "a\\b"):
        with pytest.raises(ValueError):
            validate_name(bad)
    assert ulid(1, b"\0" * 10) < ulid(2, b"\0" * 10) and len(ulid()) == 26


def test_query_grammar():
    assert X.parse('a +b -c f:d "e F" g-h') == [X.Clause(("a",)), X.Clause(("b",), None, True), X.Clause(("c",), None, False, True), X.Clause(("d",), "f"), X.Clause(("e", "f")), X.Clause(("g", "h"))]
    assert X.parse("  ") == []
    with pytest.raises(X.QueryError):
        X.parse('un"closed')


def test_text_ranking_and_stored_index(spark, tmp_path):
    docs = spark.createDataFrame([("1", "fox fox dog"), ("2", "fox cat"), ("3", "bird"), ("4", None), ("5", "big brown fox")], "id string, content string")
    assert [r.id for r in X.ranked(X.search(docs, "fox")).collect()] == ["1", "2", "5"]
    assert [r.id for r in X.search(docs, '"brown fox"').collect()] == ["5"] and [r.id for r in X.search(docs, "+fox -dog cat").orderBy("id").collect()] == ["2", "5"]
    X.PostingsIndex.write(docs, f"{tmp_path}/i", "id", {"content": "content"})
    stored = {r.id: round(r.score, 9) for r in X.PostingsIndex.open(spark, f"{tmp_path}/i").search(["fox", "dog"]).collect()}
    assert stored == {r.id: round(r.score, 9) for r in X.search(docs, "fox dog").collect()}


def test_packed_postings(spark):
    """A row a term and chunk holds what the postings hold, and packing shuffles nothing."""
    texts = [("1", "a a b a", "x"), ("2", "b a", None), ("3", "", "y"), ("4", None, None), (None, "c", "x")]
    docs, fields = spark.createDataFrame(texts, "id string, content string, more string"), {"content": "content", "attr_more": "more"}
    packed = X.packed(docs, "id", fields, 3)
    assert "Exchange" not in packed._jdf.queryExecution().executedPlan().toString()
    assert packed.groupBy("chunk", "field", "term").count().where("count > 1").isEmpty()
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(X._unpacked(packed, True).where("term <> ''")) == rows(X.postings(docs, "id", fields))
    assert rows(X._unpacked(packed).where("term = ''").select("id", "field", "dl")) == rows(X.postings(docs, "id", fields, places=False).select("id", "field", "dl").distinct())


def test_postings_are_counted_in_small_chunks():
    words = pa.array([[f"w{k}" for k in range(60_000)]] * 9 + [None, ["x"] * (X.CHUNK_WORDS + 1)])
    batch = pa.RecordBatch.from_arrays([pa.array(range(11)), words], names=["id", "w0"])
    sizes = [(len(ids), int(length.sum())) for ids, _, length, _ in X._chunks(iter([batch]), ["content"], X.CHUNK_WORDS)]
    assert sum(n for _, n in sizes) == 540_000 + X.CHUNK_WORDS + 1 and all(n <= 1 << 18 or rows == 1 for rows, n in sizes)


def test_index_generations(spark, tmp_path):
    """Changes in generations, their merge, phrases that overlap themselves, and the plan of a query."""
    texts = {"1": "a a a b", "2": "b a", "3": "the a a fox", "4": "", "5": None}
    frame = lambda d: spark.createDataFrame(list(d.items()), "id string, content string")
    index, fields = X.PostingsIndex.open(spark, f"{tmp_path}/i"), {"content": "content"}
    assert not index.exists() and index.search("a").count() == 0
    index.apply(frame(texts), frame(texts), "id", fields)
    queries = ["a", '"a a"', '"a b"', "+a -fox", "b the", "nobody", 'content:"the a" b', "other:a", "-a"]
    scores = lambda rows: {r.id: round(r.score, 9) for r in rows.collect()}
    for step in range(X.MERGE + 2):
        for q in queries:
            assert scores(index.search(q)) == scores(X.search(frame(texts), q)), (step, q)
            if step not in (0, 1, X.MERGE + 1):
                break
        assert index.count() == sum(bool(x) for x in texts.values()) and len(index._state()["generations"]) < X.MERGE
        texts[str(step % 5 + 1)] = f"a b a c{step}"
        one = str(step % 5 + 1)
        if step % 4 == 3:
            del texts[one]
        index.apply(frame(texts).where(F.col("id") == one), frame({one: ""}), "id", fields)
    plan = index.search("a fox")._jdf.queryExecution().executedPlan().toString()
    assert "In(term, [a,fox])" in plan


def test_frames_of_wrong_dimensions_write_nothing(spark, tmp_path):
    table = DocumentTable(spark, f"{tmp_path}", "docs", SCHEMA)
    rows = spark.createDataFrame([("1", "one", [1.0, 2.0]), ("2", "two", [1.0, 2.0, 3.0]), ("3", "three", None)], "id string, content string, embedding array<float>").withColumn("attributes", F.lit(None).cast("string"))
    with pytest.raises(Exception, match="dimensions"):
        table.upsert(rows)
    assert table.documents().count() == 0 and table.upsert(rows.where("id <> '2'")) > 0 and table.documents().count() == 2


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0]), (4, [1.0]), (5, None), (6, [2.0, 0.0])], "id long, embedding array<float>")
    got = [(r.id, r.distance if r.distance is None else round(r.distance, 6)) for r in V.nearest(v, [1.0, 0.0], 9).collect()]
    assert got == [(1, 0.0), (6, 0.0), (3, 0.292893), (2, None)]
    pair = v.where("size(embedding) = 2").select("id", V.cosine_distance(F.col("embedding"), F.col("embedding")).alias("d")).orderBy("id").collect()
    assert [r.d is not None and abs(r.d) < 1e-6 for r in pair] == [True, False, True, True]


class Recorder:
    def __init__(self):
        self.resets, self.seen = 0, []

    def reset(self):
        self.resets += 1

    def apply(self, changes):
        self.seen.append(sorted((r.key, r.value) for r in changes.collect()))


def test_builder(spark, tmp_path):
    store, objects, log = Store(spark, f"{tmp_path}/db", "string"), MemoryStore(), Recorder()
    store.put("a", "1")
    store.put("b", "2")
    store.flush()
    builder = Builder(store, log, "idx", objects)
    assert builder.catch_up() == 2 and log.resets == 1 and load_checkpoint(objects, "idx") == 2
    store.delete("a")
    store.flush()
    assert builder.catch_up() == 3 and builder.catch_up() == 3
    assert log.seen == [[("a", "1"), ("b", "2")], [("a", None)]]
    save_checkpoint(objects, "idx", 99)
    builder.catch_up()
    assert log.resets == 2 and load_checkpoint(objects, "idx") == 3
    with pytest.raises(ValueError):
        Builder(store, None, "idx", objects)
    index = StoreIndexer(Store(spark, f"{tmp_path}/index", "string"))
    Builder(store, index, "s", objects).rebuild()
    Builder(store, index, "s", objects).rebuild()
    assert [(r.key, r.value) for r in index.index.scan().collect()] == [("b", "2")]


def test_stream_follows_a_log(spark, tmp_path):
    schema = "key string, seq long, value string"
    index = Store(spark, f"{tmp_path}/index", "string")
    spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], schema).write.parquet(f"{tmp_path}/log/1")
    start(f"{tmp_path}/log", index, f"{tmp_path}/cp").awaitTermination()
    spark.createDataFrame([("a", 3, None), ("c", 4, "z")], schema).write.parquet(f"{tmp_path}/log/2")
    start(f"{tmp_path}/log", index, f"{tmp_path}/cp").awaitTermination()
    assert [(r.key, r.value) for r in index.scan().collect()] == [("b", "y"), ("c", "z")]
