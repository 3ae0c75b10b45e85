"""Queries over the driver's tables, each beside the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkdoc.functions.schema import FieldDefinition, FieldType, Schema, violations
from sparkdoc.operators import documents as D
from sparkdoc.operators import entries as E
from sparkdoc.operators import filters as A
from sparkdoc.operators import fulltext as X
from sparkdoc.operators import vector as V
from sparkdoc.operators.filters import Filter
from sparkdoc.plans import stored
from sparkdoc.plans import tables as t

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

EVENTS = "events_log as (select lpad(user_id::varchar, 6, '0') || '#' || lpad(json_extract_string(props, '$.k'), 3, '0') as key, event_id + 1 as seq, case when event_type <> 'error' then value end as value from events)"
ORDERS = "orders_log as (select lpad(o_custkey::varchar, 8, '0') as key, o_orderkey + 1 as seq, case when o_orderstatus <> 'P' then o_totalprice end as value from orders)"
DOCS = "docs as (select d.doc_id as id, d.text as content, d.lang, d.source, d.n_chars, l.quality::bigint as quality, l.toxic = 1 as toxic from documents d left join labels l on l.doc_id = d.doc_id)"
USERS = "users as (select user_id as id, list_sort(list(distinct event_type)) as types, list(case when event_type <> 'error' then floor(value) end) as vals from events group by user_id)"
PARTS = "parts as (select p_partkey as id, string_split(p_type, ' ') as words, p_size as size from part)"


def newest(log: str, where: str = "true") -> str:
    return f"(select key, seq, value from (select *, row_number() over (partition by key order by seq desc) as rn from {log} where {where}) where rn = 1)"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


def add(name: str, f: Query, sql: str | None = None) -> None:
    query(name, sql)(f)


# --- entry log ---------------------------------------------------------------------------------

KEY = "000007#029"
add("kv_get", lambda s, d: E.get(t.events_log(s, d), KEY).withColumn("is_tombstone", F.col("value").isNull()), f"with {EVENTS} select key, seq, value, value is null as is_tombstone from {newest('events_log')} where key = '{KEY}'")
add("kv_get_absent", lambda s, d: E.get(t.events_log(s, d), "nobody").agg(F.count("*").alias("found")), f"with {EVENTS} select count(*) as found from {newest('events_log')} where key = 'nobody'")
add("kv_scan", lambda s, d: E.scan(t.events_log(s, d)), f"with {EVENTS} select * from {newest('events_log')} where value is not null")
add("kv_scan_orders", lambda s, d: E.scan(t.orders_log(s, d)), f"with {ORDERS} select * from {newest('orders_log')} where value is not null")


def _range_sql(after: str, limit: int) -> str:
    return f"with {EVENTS}, probe as (select *, row_number() over (order by key) as n, count(*) over () as total from {newest('events_log')} where value is not null and key > '{after}') select key, seq, value, total > {limit} as has_more from probe where n <= {limit}"


add("kv_scan_range", lambda s, d: E.scan_range(t.events_log(s, d), "", 100), _range_sql("", 100))
add("kv_scan_range_page2", lambda s, d: E.scan_range(t.events_log(s, d), "000003#000", 50), _range_sql("000003#000", 50))
add("kv_scan_range_last", lambda s, d: E.scan_range(t.events_log(s, d), "000010", 10_000_000), _range_sql("000010", 10_000_000))
add("kv_scan_range_limit0", lambda s, d: E.has_more(t.events_log(s, d), "", 0), f"with {EVENTS} select 0::bigint as page_rows, count(*) > 0 as has_more from {newest('events_log')} where value is not null")
add("kv_scan_since", lambda s, d: E.scan_since(t.events_log(s, d), 900), f"with {EVENTS} select key, seq, value, value is null as is_deleted from {newest('events_log', 'seq > 900')}")
add("kv_time_travel", lambda s, d: E.as_of(t.events_log(s, d), 500), f"with {EVENTS} select * from {newest('events_log', 'seq <= 500')} where value is not null")
add("kv_tombstones", lambda s, d: E.deleted(t.events_log(s, d)), f"with {EVENTS} select key, seq from {newest('events_log')} where value is null")
add("kv_max_seq", lambda s, d: E.max_seq(t.events_log(s, d)), f"with {EVENTS} select max(seq)::bigint as max_seq from events_log")


def _segments(s: SparkSession, d: str) -> DataFrame:
    """Four flushes, a quarter of the log each."""
    return stored.quarters(s, d)[0]


SEGMENTS = f"{EVENTS}, seg as (select *, least(floor((seq - 1) * 4 / (select max(seq) from events_log)), 3)::bigint as segment from events_log)"


def _compacted(s: SparkSession, d: str) -> DataFrame:
    return E.compact(*[_segments(s, d).where(F.col("segment") == k) for k in range(4)])


add("kv_compact", _compacted, f"with {EVENTS} select * from {newest('events_log')}")
add("kv_compact_then_scan", lambda s, d: E.scan(_compacted(s, d), unique=True), f"with {EVENTS} select * from {newest('events_log')} where value is not null")
add("kv_merge", lambda s, d: E.merge(*[_segments(s, d).where(F.col("segment") == k) for k in (0, 2)]), f"with {SEGMENTS} select * from {newest('seg', 'segment in (0, 2)')} where value is not null")
STATS = "min(key) as min_key, max(key) as max_key, min(seq)::bigint as min_seq, max(seq)::bigint as max_seq, count(*) as n"
add("kv_segment_stats", lambda s, d: E.segment_stats(_segments(s, d), "segment"), f"with {SEGMENTS} select segment, {STATS} from seg group by segment")
add("kv_segment_stats_empty", lambda s, d: E.segment_stats(t.events_log(s, d).where("seq < 0")), "select '' as min_key, '' as max_key, 0::bigint as min_seq, 0::bigint as max_seq, 0::bigint as n")
add("kv_prune_segments", lambda s, d: E.segment_stats(_segments(s, d), "segment").where("max_seq > 600"), f"with {SEGMENTS} select segment, {STATS} from seg group by segment having max(seq) > 600")

# --- attribute filters -------------------------------------------------------------------------

ATTRIBUTES = ("lang", "source", "n_chars", "quality", "toxic")
SHOWN = "id, lang, source, n_chars, quality, toxic"


def _search(*filters: Filter, limit: int = 0, offset: int = 0, indexed: tuple[str, ...] | None = None) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        return A.search(t.documents(s, d), filters, limit, offset, columns=ATTRIBUTES, indexed=indexed).drop("content")

    return run


def _docs(where: str, tail: str = "") -> str:
    return f"with {DOCS} select {SHOWN} from docs where {where} {tail}"


add("attr_eq_string", _search(Filter("lang", "eq", "de")), _docs("lang = 'de'"))
add("attr_eq_number", _search(Filter("quality", "eq", 1)), _docs("quality = 1"))
add("attr_eq_bool", _search(Filter("toxic", "eq", True)), _docs("toxic"))
add("attr_neq_scalar", _search(Filter("quality", "neq", 1)), _docs("quality is not null and quality <> 1"))
add("attr_neq_other_kind", _search(Filter("quality", "neq", "1")), _docs("quality is not null"))
add("attr_gt", _search(Filter("n_chars", "gt", 3000)), _docs("n_chars > 3000"))
add("attr_gte", _search(Filter("n_chars", "gte", 416)), _docs("n_chars >= 416"))
add("attr_lt", _search(Filter("n_chars", "lt", 416)), _docs("n_chars < 416"))
add("attr_lte", _search(Filter("n_chars", "lte", 416)), _docs("n_chars <= 416"))
add("attr_in", _search(Filter("lang", "in", ["fr", "es", "xx"])), _docs("lang in ('fr', 'es', 'xx')"))
add("attr_in_mixed", _search(Filter("quality", "in", ["1", 0, True])), _docs("quality = 0"))
add("attr_in_empty", lambda s, d: _search(Filter("lang", "in", []))(s, d).agg(F.count("*").alias("n")), "select 0::bigint as n")
add("attr_and", _search(Filter("lang", "eq", "en"), Filter("n_chars", "gt", 1000), Filter("toxic", "eq", False)), _docs("lang = 'en' and n_chars > 1000 and not toxic"))
add("attr_page", _search(Filter("lang", "eq", "en"), limit=20, offset=10), _docs("lang = 'en'", "order by id limit 20 offset 10"))
add("attr_page_beyond", lambda s, d: _search(limit=5, offset=10_000_000)(s, d).agg(F.count("*").alias("n")), "select 0::bigint as n")
add("attr_all", _search(), _docs("true"))
add("attr_kind_mismatch", lambda s, d: _search(Filter("lang", "gt", 1))(s, d).agg(F.count("*").alias("n")), "select 0::bigint as n")
add("attr_unindexed", lambda s, d: _search(Filter("lang", "eq", "en"), indexed=("source",))(s, d).agg(F.count("*").alias("n")), "select 0::bigint as n")
add("attr_count", lambda s, d: t.documents(s, d).agg(F.count("*").alias("documents")), f"with {DOCS} select count(*) as documents from docs")


def _users(*filters: Filter) -> Query:
    return lambda s, d: A.search(t.tagged(s, d), filters, columns=("types", "values")).select("id", "types")


def _users_sql(where: str) -> str:
    return f"with {USERS} select id, types from users where {where}"


add("attr_contains", _users(Filter("types", "contains", "signup")), _users_sql("list_contains(types, 'signup')"))
add("attr_eq_array", _users(Filter("values", "eq", 12)), _users_sql("list_contains(vals, 12)"))
add("attr_neq_array", _users(Filter("values", "neq", 12)), _users_sql("len(list_filter(vals, lambda x: x is not null)) > 0 and not list_contains(list_filter(vals, lambda x: x is not null), 12)"))
add("attr_range_array", _users(Filter("values", "gt", 300)), _users_sql("len(list_filter(vals, lambda x: x > 300)) > 0"))
add("attr_in_array", _users(Filter("values", "in", [7, 11, "x"])), _users_sql("len(list_filter(vals, lambda x: x in (7, 11))) > 0"))
add("attr_and_array", _users(Filter("values", "gt", 100), Filter("values", "lt", 5)), _users_sql("len(list_filter(vals, lambda x: x > 100)) > 0 and len(list_filter(vals, lambda x: x < 5)) > 0"))
add("attr_array_page", lambda s, d: A.search(t.part_tokens(s, d), [Filter("words", "eq", "PROMO"), Filter("size", "lte", 10)], 15, 5, columns=("words", "size")).select("id", "size"), f"with {PARTS} select id, size from parts where list_contains(words, 'PROMO') and size <= 10 order by id limit 15 offset 5")


def _loose(*filters: Filter) -> Query:
    """The same filters over attributes without a schema."""

    def run(s: SparkSession, d: str) -> DataFrame:
        docs = t.documents(s, d)
        json = F.to_json(F.struct(*[c for c in ATTRIBUTES if c != "n_chars"], F.col("n_chars").cast("double").alias("n_chars")))
        return docs.where(A.predicate(filters, attributes=F.parse_json(json))).drop("content")

    return run


add("attr_variant_eq", _loose(Filter("lang", "eq", "es"), Filter("n_chars", "gte", 100)), _docs("lang = 'es' and n_chars >= 100"))
add("attr_variant_neq", _loose(Filter("toxic", "neq", True)), _docs("toxic is not null and not toxic"))

# --- documents ---------------------------------------------------------------------------------

NOW = "2026-01-01 00:00:00"


def _doc_rows(s: SparkSession, d: str) -> DataFrame:
    docs = t.documents(s, d)
    return docs.select(F.lpad(F.col("id").cast("string"), 8, "0").alias("id"), "content", F.to_json(F.struct("lang", "quality", "source", "toxic")).alias("attributes"), F.lit(None).cast("array<float>").alias("embedding"), F.lit(None).cast("string").alias("embedding_model"), "lang")


def _upserted(s: SparkSession, d: str) -> DataFrame:
    """All stored at an earlier time; then the English ones written again, and the French ones under new ids."""
    rows = _doc_rows(s, d)
    first = D.prepare(rows, None, F.lit("2025-01-01 00:00:00").cast("timestamp"))
    batch = rows.where("lang = 'en'").unionByName(rows.where("lang = 'fr'").withColumn("id", F.concat(F.lit("new"), "id")))
    return D.prepare(batch, first, F.lit(NOW).cast("timestamp"))


add(
    "doc_upsert_versions",
    lambda s, d: _upserted(s, d).select("id", "version", F.date_format("created_at", "yyyy-MM-dd").alias("created"), F.date_format("updated_at", "yyyy-MM-dd").alias("updated")),
    f"with {DOCS} select lpad(id::varchar, 8, '0') as id, 2::bigint as version, '2025-01-01' as created, '2026-01-01' as updated from docs where lang = 'en' union all select 'new' || lpad(id::varchar, 8, '0'), 1, '2026-01-01', '2026-01-01' from docs where lang = 'fr'",
)
add("doc_list_page", lambda s, d: D.list_page(D.as_entries(_doc_rows(s, d), F.col("id").cast("long") + 1), 25, "00000100").select("id", F.length("content").alias("size")), f"with {DOCS} select lpad(id::varchar, 8, '0') as id, length(content) as size from docs where id > 100 order by 1 limit 25")


def _deleted_docs(s: SparkSession, d: str) -> DataFrame:
    """All stored, then the German ones deleted."""
    docs = _doc_rows(s, d)
    rows = D.as_entries(docs, F.col("id").cast("long") + 1)
    later = rows.agg(F.max("seq")).first()[0] or 0
    gone = docs.where("lang = 'de'").select(F.col("id").alias("key"), (F.col("id").cast("long") + 1 + later).alias("seq"), F.lit(None).cast(rows.schema["value"].dataType).alias("value"))
    return E.live(rows.unionByName(gone)).select(F.col("key").alias("id"), F.length("value.content").alias("size"))


add("doc_delete", _deleted_docs, f"with {DOCS} select lpad(id::varchar, 8, '0') as id, length(content) as size from docs where lang <> 'de'")

RULES = Schema({"lang": FieldDefinition(FieldType.STRING, required=True), "source": FieldDefinition(FieldType.INT), "quality": FieldDefinition(FieldType.INT, required=True)})
add(
    "doc_validate",
    lambda s, d: _doc_rows(s, d).select(F.explode(violations(RULES, F.col("attributes"))).alias("violation")).groupBy("violation").agg(F.count("*").alias("n")),
    f"with {DOCS} select 'type source' as violation, count(*) as n from docs union all select 'missing quality', count(*) from docs where quality is null having count(*) > 0 union all select 'unknown toxic', count(*) from docs where toxic is not null having count(*) > 0",
)
add(
    "doc_embedding_text",
    lambda s, d: t.documents(s, d).select("id", F.md5(D.embedding_text(F.col("content"), {"source": F.col("source"), "lang": F.col("lang"), "n_chars": F.col("n_chars")}, {"source": FieldType.STRING, "lang": FieldType.STRING, "n_chars": FieldType.INT})).alias("digest")),
    f"with {DOCS} select id, md5(concat_ws(chr(10), content, lang, source)) as digest from docs",
)

# --- full text ---------------------------------------------------------------------------------

FIELDS = {"content": "content", "attr_lang": "lang"}
WORDS = "words as (select id, list_filter(string_split_regex(lower(content), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') as w, [lang] as l from docs)"
add("fts_tokens", lambda s, d: t.documents(s, d).select("id", F.size(X.tokens(F.col("content"))).cast("long").alias("terms")), f"with {DOCS}, {WORDS} select id, len(w) as terms from words")
add("fts_postings", lambda s, d: X.postings(t.documents(s, d), "id", {"content": "content"}, places=False).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")), f"with {DOCS}, {WORDS}, p as (select id, unnest(w) as term from words) select term, count(distinct id) as df, count(*) as cf from p group by term")
add("fts_term", lambda s, d: X.search(t.documents(s, d), "the", fields=FIELDS).select("id"), f"with {DOCS}, {WORDS} select id from words where list_contains(w, 'the')")
add("fts_field", lambda s, d: X.search(t.documents(s, d), "attr_lang:de", fields=FIELDS).select("id"), f"with {DOCS}, {WORDS} select id from words where list_contains(l, 'de')")
add("fts_unmapped", lambda s, d: X.total(X.search(t.documents(s, d), "attr_source:src1", fields=FIELDS)), "select 0::bigint as total")
add("fts_bool", lambda s, d: X.search(t.documents(s, d), "+the -was er", fields=FIELDS).select("id"), f"with {DOCS}, {WORDS} select id from words where list_contains(w, 'the') and not list_contains(w, 'was')")
add("fts_phrase", lambda s, d: X.search(t.documents(s, d), '"of the"', fields={"content": "content"}).select("id"), f"with {DOCS}, {WORDS} select id from words where contains(' ' || array_to_string(w, ' ') || ' ', ' of the ')")
add("fts_total", lambda s, d: X.total(X.search(t.documents(s, d), "the der", fields=FIELDS)), f"with {DOCS}, {WORDS} select count(*) as total from words where list_contains(w, 'the') or list_contains(w, 'der')")
BM25 = f"""with {DOCS}, {WORDS}, p as (
  select id, len(w) as dl, len(list_filter(w, lambda x: x = 'the')) as the, len(list_filter(w, lambda x: x = 'der')) as der from words where len(w) > 0
), c as (
  select count(*) as n, avg(dl) as mean, count(*) filter (the > 0) as df1, count(*) filter (der > 0) as df2 from p
), s as (
  select id, ln(1 + (n - df1 + 0.5) / (df1 + 0.5)) * the * 2.2 / (the + 1.2 * (0.25 + 0.75 * dl / mean)) + ln(1 + (n - df2 + 0.5) / (df2 + 0.5)) * der * 2.2 / (der + 1.2 * (0.25 + 0.75 * dl / mean)) as score
  from p, c where the > 0 or der > 0
) """
add("fts_bm25", lambda s, d: X.search(t.documents(s, d), "the der", fields={"content": "content"}).select("id", F.round("score", 6).alias("score")), BM25 + "select id, round(score, 6) as score from s")
add("fts_page", lambda s, d: X.ranked(X.search(t.documents(s, d), "the der", fields={"content": "content"}), 0, 5).select("id"), BM25 + "select id from s order by score desc, id limit 10 offset 5")

# --- vectors -----------------------------------------------------------------------------------

POINT = [round(0.01 * ((7 * i) % 13 - 6), 2) for i in range(64)]
_LIST = "[" + ", ".join(str(x) for x in POINT) + "]::double[]"


def _vectors(s: SparkSession, d: str) -> DataFrame:
    return t.read(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


KNN = f"select vec_id as id, list_cosine_distance(embedding::double[], {_LIST}) as distance from embeddings order by distance, id limit 10"
add("vec_knn", lambda s, d: V.nearest(_vectors(s, d), POINT, 10).select("id", F.round("distance", 6).alias("distance")), f"select id, round(distance, 6) as distance from ({KNN})")
add("vec_knn_zero", lambda s, d: V.nearest(_vectors(s, d), POINT, 0).agg(F.count("*").alias("n")), "select 0::bigint as n")
add(
    "vec_knn_filtered_dims",
    lambda s, d: V.nearest(_vectors(s, d).withColumn("embedding", F.when(F.col("label") == 3, F.slice("embedding", 1, 3)).otherwise(F.col("embedding"))), POINT, 10).select("id", F.round("distance", 6).alias("distance")),
    f"select id, round(distance, 6) as distance from (select vec_id as id, list_cosine_distance(embedding::double[], {_LIST}) as distance from embeddings where label <> 3 order by distance, id limit 10)",
)


def _documents_with_vectors(s: SparkSession, d: str) -> DataFrame:
    return t.documents(s, d).join(_vectors(s, d).drop("label"), "id", "left")


add(
    "vec_knn_docs",
    lambda s, d: V.nearest_documents(_documents_with_vectors(s, d), POINT, 7).select("id", "lang", F.round("distance", 6).alias("distance")),
    f"with {DOCS}, near as (select vec_id as id, list_cosine_distance(embedding::double[], {_LIST}) as distance from embeddings where vec_id in (select id from docs) order by distance, id limit 7) select near.id, lang, round(distance, 6) as distance from near join docs on docs.id = near.id",
)


# --- index maintenance -------------------------------------------------------------------------


def _caught_up(s: SparkSession, d: str) -> DataFrame:
    """Built at 600, then brought up to date from the changes since."""
    log = t.events_log(s, d)
    return D.apply_changes(E.as_of(log, 600), E.scan_since(log, 600))


add("idx_rebuild", lambda s, d: E.live(t.events_log(s, d)), f"with {EVENTS} select * from {newest('events_log')} where value is not null")
add("idx_catchup", _caught_up, f"with {EVENTS} select * from {newest('events_log')} where value is not null")


def _streamed(s: SparkSession, d: str) -> DataFrame:
    from sparkdoc.streaming.index import stream_latest

    return stream_latest(s, t.events_log(s, d))


add("stream_index", _streamed, f"with {EVENTS} select * from {newest('events_log')} where value is not null")


def _stored(s: SparkSession, d: str) -> DataFrame:
    """Written in two flushes through the store, compacted, and scanned."""
    from sparkdoc.sources.store import scratch_store

    log = t.orders_log(s, d)
    store = scratch_store(s, "double")
    half = log.agg(F.expr("percentile_approx(seq, 0.5)")).first()[0]
    store.write(log.where(F.col("seq") <= half))
    store.write(log.where(F.col("seq") > half))
    store.compact()
    return store.scan()


add("store_round_trip", _stored, f"with {ORDERS} select * from {newest('orders_log')} where value is not null")


QUERIES |= stored.QUERIES
SQL |= stored.SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["kv_scan_range"](spark, sf_dir)


__all__ = ["QUERIES", "SQL", "flagship"]
