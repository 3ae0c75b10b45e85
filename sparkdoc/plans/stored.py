"""Queries that go through the store, the document table and the indexes, each beside its SQL.

Each writes a store of its own into the shared folder. Whole tables go in as DataFrames; what is put one entry at a
time is ``nation`` and ``region``, which don't grow.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkdoc.functions.names import validate_name
from sparkdoc.functions.schema import FieldDefinition, FieldType, Schema, diff
from sparkdoc.operators import fulltext as X
from sparkdoc.operators.filters import Filter, FilterError, validate
from sparkdoc.operators.table import Document, DocumentTable, FullTextUnavailableError, IndexDegradedError, VectorUnavailableError
from sparkdoc.plans import tables as t
from sparkdoc.sources.cache import SegmentCache
from sparkdoc.sources.objects import HadoopStore, MemoryStore, NotFoundError, ObjectStore, PreconditionError, s3_options
from sparkdoc.sources.store import StaleWriterError, Store, scratch_store, shared_folder
from sparkdoc.streaming.index import Builder, StoreIndexer, load_checkpoint

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

EVENTS = "events_log as (select lpad(user_id::varchar, 6, '0') || '#' || lpad(json_extract_string(props, '$.k'), 3, '0') as key, event_id + 1 as seq, case when event_type <> 'error' then value end as value from events)"
NEWEST = "newest as (select key, seq, value from (select *, row_number() over (partition by key order by seq desc) as rn from events_log) where rn = 1)"
NATIONS = "nations as (select n_name as key, n_regionkey::double as value, n_regionkey as region, row_number() over (order by n_nationkey) as n from nation)"


def query(name: str, sql: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name], SQL[name] = f, sql
        return f

    return register


def nations(s: SparkSession, d: str) -> list:
    """The rows of nation (25 of them), in order."""
    return t.read(s, d, "nation").orderBy("n_nationkey").collect()


def quarters(s: SparkSession, d: str) -> tuple[DataFrame, int]:
    """The events log with the quarter of its sequence numbers that each entry is in, and the largest number."""
    log = t.events_log(s, d)
    top = log.agg(F.max("seq")).first()[0] or 1
    return log.withColumn("segment", F.least(F.floor((F.col("seq") - 1) * 4 / top), F.lit(3))), top


def _folder(s: SparkSession, tag: str) -> str:
    return f"{shared_folder(s)}/{tag}-{uuid.uuid4().hex}"


def _folders(df: DataFrame) -> int:
    """Segments that a plan reads."""
    return len({f.rpartition("/")[0] for f in df.inputFiles()})


def _events_store(s: SparkSession, d: str) -> tuple[Store, int]:
    """The events log in four segments of rising sequence numbers."""
    log, top = quarters(s, d)
    store = scratch_store(s, "double")
    for k in range(4):
        store.write(log.where(F.col("segment") == k).drop("segment"))
    return store, top


# --- store -------------------------------------------------------------------------------------


@query("store_since", f"with {EVENTS}, top as (select max(seq) as m from events_log), late as (select *, row_number() over (partition by key order by seq desc) as rn from events_log, top where seq > m * 5 // 8) select key, seq, value, value is null as is_deleted, 2 as segments from late where rn = 1")
def _since(s: SparkSession, d: str) -> DataFrame:
    """Changes after five eighths of the log: only the two segments that hold any are read."""
    store, top = _events_store(s, d)
    found = store.scan_since(top * 5 // 8)
    return found.withColumn("segments", F.lit(_folders(found)))


@query("store_range", f"with {EVENTS}, {NEWEST}, half as (select max(key) as k from (select distinct key from events_log order by key limit (select count(distinct key) // 2 from events_log))), page as (select *, row_number() over (order by key) as rn, count(*) over () as total from newest, half where value is not null and key > k) select key, seq, value, total > 200 as has_more, 1 as segments from page where rn <= 200")
def _range(s: SparkSession, d: str) -> DataFrame:
    """A page of a store of two segments with disjoint keys: the one that ends before the page isn't read."""
    log = t.events_log(s, d)
    keys = log.select("key").distinct()
    half = keys.orderBy("key").limit(keys.count() // 2).agg(F.max("key")).first()[0]
    store = scratch_store(s, "double")
    store.write(log.where(F.col("key") <= half))
    store.write(log.where(F.col("key") > half))
    page = store.scan_range(half, 200)
    read, _ = store.entries(lambda x: x.max_key > half)
    return s.createDataFrame([(e.key, e.seq, e.value, page.has_more, _folders(read)) for e in page.entries], "key string, seq long, value double, has_more boolean, segments int")


@query("store_get", f"with {NATIONS} select key, true as found, region = 0 as deleted, case when region <> 0 then value end as value from nations union all select 'ATLANTIS', false, false, null")
def _get(s: SparkSession, d: str) -> DataFrame:
    """Point reads of present, deleted and absent keys, after a flush."""
    rows, store = nations(s, d), scratch_store(s, "double")
    for r in rows:
        store.put(r.n_name, float(r.n_regionkey))
    store.flush()
    for r in rows:
        if r.n_regionkey == 0:
            store.delete(r.n_name)
    store.flush()
    found = [(k, store.get(k)) for k in [*(r.n_name for r in rows), "ATLANTIS"]]
    return s.createDataFrame([(k, e is not None, e is not None and e.deleted, e.value if e else None) for k, e in found], "key string, found boolean, deleted boolean, value double")


@query("store_buffer", f"with {NATIONS}, late as (select *, (select count(*) from nations) + row_number() over (order by n) as m from nations where region in (1, 2)) select key, n as seq, value from nations where region not in (1, 2) union all select key, m, value + 100 from late where region = 1")
def _buffer(s: SparkSession, d: str) -> DataFrame:
    """What a writer reads before it flushes: region 1 written again, region 2 deleted, in the buffer alone."""
    rows, store = nations(s, d), scratch_store(s, "double")
    for r in rows:
        store.put(r.n_name, float(r.n_regionkey))
    store.flush()
    for r in rows:
        if r.n_regionkey == 1:
            store.put(r.n_name, r.n_regionkey + 100.0)
        elif r.n_regionkey == 2:
            store.delete(r.n_name)
    return store.scan()


@query("store_buffer_bytes", "select sum(2 * length(n_name) + 128)::bigint as bytes, 0::bigint as flushed from nation")
def _buffer_bytes(s: SparkSession, d: str) -> DataFrame:
    """The buffer's size by keys, values and a constant for each entry; a key written twice counts once."""
    store = scratch_store(s, "binary")
    for r in [*nations(s, d), *nations(s, d)]:
        store.put(r.n_name, r.n_name.encode())
    held = store.buffered_bytes
    store.flush()
    return s.createDataFrame([(held, store.buffered_bytes)], "bytes long, flushed long")


@query("store_reopen", f"with {NATIONS} select key, n as seq, value, (select count(*) from nations) as last_seq, 2 as epoch from nations")
def _reopen(s: SparkSession, d: str) -> DataFrame:
    """What was flushed is there after closing and opening again; what wasn't is lost."""
    store = scratch_store(s, "double")
    for r in nations(s, d):
        store.put(r.n_name, float(r.n_regionkey))
    store.flush()
    store.put("LOST", 1.0)
    store.close()
    again = Store(s, store.path, "double")
    return again.scan().withColumns({"last_seq": F.lit(again.last_seq).cast("long"), "epoch": F.lit(again.epoch)})


@query("store_manifests", "with r as (select n_regionkey as region, count(*) as n from nation group by 1), f as (select row_number() over (order by region) as k, sum(n) over (order by region) as seq from r) select 1::bigint as version, 0::bigint as segments, 0::bigint as last_seq, 1::bigint as next_flush, 0::bigint as entries union all select k + 1, k, seq::bigint, k + 1, seq::bigint from f")
def _manifests(s: SparkSession, d: str) -> DataFrame:
    """Every manifest of a store that is flushed once a region: opening makes the first."""
    rows, store = nations(s, d), scratch_store(s, "double")
    for region in sorted({r.n_regionkey for r in rows}):
        for r in rows:
            if r.n_regionkey == region:
                store.put(r.n_name, float(region))
        store.flush()
    made = [store.manifests.load(v) for v in store.manifests.versions()]
    return s.createDataFrame([(m.version, len(m.l0), m.last_seq_num, m.wal_id_next, sum(x.rows for x in m.l0)) for m in made], "version long, segments long, last_seq long, next_flush long, entries long")


@query("store_fencing", f"with {NATIONS} select key, value, true as stale from nations")
def _fencing(s: SparkSession, d: str) -> DataFrame:
    """A writer that another has followed can't commit; the follower can."""
    first = scratch_store(s, "double")
    second = Store(s, first.path, "double")
    for r in nations(s, d):
        first.put("old " + r.n_name, 0.0)
        second.put(r.n_name, float(r.n_regionkey))
    try:
        first.flush()
        stale = False
    except StaleWriterError:
        stale = True
    second.flush()
    return second.scan().select("key", "value", F.lit(stale).alias("stale"))


class _Raced(MemoryStore):
    """Manifests of which someone else creates every third first."""

    def put(self, key: str, data: bytes, if_none_match: bool = False):
        if if_none_match and int(key.rpartition("/")[2].partition(".")[0]) % 3 == 0 and not self.exists(key):
            before = max(k for k in self.list() if k < key)
            version = int(key.rpartition("/")[2].partition(".")[0])
            super().put(key, self.get(before).replace(f'"version": {version - 1}'.encode(), f'"version": {version}'.encode()))
        return super().put(key, data, if_none_match)


@query("store_raced_commits", f"with {NATIONS} select key, value, (select count(distinct region) from nations) as flushes, 8::bigint as version from nations")
def _raced(s: SparkSession, d: str) -> DataFrame:
    """Commits that lose a race are made again on what the winner left: six commits and two by others."""
    rows, objects = nations(s, d), _Raced()
    store = Store(s, _folder(s, "raced"), "double", objects=objects)
    flushes = sorted({r.n_regionkey for r in rows})
    for region in flushes:
        for r in rows:
            if r.n_regionkey == region:
                store.put(r.n_name, float(region))
        store.flush()
    return store.scan().select("key", "value", F.lit(len(flushes)).cast("long").alias("flushes"), F.lit(store.manifests.latest().version).cast("long").alias("version"))


@query("store_auto_compact", f"with {NATIONS} select key, n as seq, value, 1 as level0, 1 as runs from (select key, value, row_number() over (order by region, n) as n from nations)")
def _auto(s: SparkSession, d: str) -> DataFrame:
    """A store that compacts when four flushes have come: after five, one is left beside the run."""
    rows, store = nations(s, d), scratch_store(s, "double")
    for region in sorted({r.n_regionkey for r in rows}):
        for r in rows:
            if r.n_regionkey == region:
                store.put(r.n_name, float(region))
        store.flush()
        store.maybe_compact()
    m = store.manifests.latest()
    return store.scan().withColumns({"level0": F.lit(len(m.l0)), "runs": F.lit(len(m.sorted_runs))})


@query("store_compact_markers", f"with {EVENTS}, {NEWEST} select key, seq, value from newest")
def _markers(s: SparkSession, d: str) -> DataFrame:
    """Entries of a compacted store: one a key, delete markers included."""
    store, _ = _events_store(s, d)
    store.compact()
    return store.entries()[0]


@query("store_snapshot", f"with {EVENTS}, top as (select max(seq) as m from events_log), early as (select *, row_number() over (partition by key order by seq desc) as rn from events_log, top where (seq - 1) * 4 < 2 * m) select key, seq, value from early where rn = 1 and value is not null")
def _snapshot(s: SparkSession, d: str) -> DataFrame:
    """The third manifest: after two of four segments, whatever came later."""
    store, _ = _events_store(s, d)
    return store.snapshot(3)


@query("store_vacuum", f"with {EVENTS}, {NEWEST} select key, seq, value, 4 as removed from newest where value is not null")
def _vacuum(s: SparkSession, d: str) -> DataFrame:
    store, _ = _events_store(s, d)
    store.compact()
    removed = store.vacuum()
    return store.scan().withColumn("removed", F.lit(len(removed)))


@query("store_empty_values", "select lpad(c_custkey::varchar, 8, '0') as key, c_name as name from customer where c_acctbal >= 0")
def _empty_values(s: SparkSession, d: str) -> DataFrame:
    """Binary values: an empty one is a delete marker."""
    c, store = t.read(s, d, "customer"), scratch_store(s, "binary")
    rows = c.select(F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("key"), F.col("c_name").cast("binary").alias("value"), "c_acctbal")
    store.write(rows.drop("c_acctbal"))
    store.write(rows.where("c_acctbal < 0").select("key", F.lit(b"").alias("value")))
    return store.scan().select("key", F.col("value").cast("string").alias("name"))


def _cached(make: Callable[[], SegmentCache]) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        store, _ = _events_store(s, d)
        cache = make()
        reader = Store(s, store.path, "double", read_only=True, cache=cache)
        reader.scan().count()
        out = reader.scan().withColumn("held", F.lit(sum(x.path in cache for x in reader.manifest.segments())))
        return out

    return run


for _name, _make in {"store_memory_cache": SegmentCache, "store_disk_cache": SegmentCache.on_disk}.items():
    query(_name, f"with {EVENTS}, {NEWEST} select key, seq, value, 4 as held from newest where value is not null")(_cached(_make))


# --- objects -----------------------------------------------------------------------------------


def _objects(make: Callable[[SparkSession], ObjectStore]) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        """Objects of the regions' names: written, found again, one deleted."""
        o, names = make(s), [r.r_name for r in t.read(s, d, "region").orderBy("r_regionkey").collect()]
        taken = {}
        for n in names:
            o.put(f"r/{n}", n.encode())
            try:
                o.put(f"r/{n}", b"again", if_none_match=True)
                taken[n] = False
            except PreconditionError:
                taken[n] = True
        o.put("other", b"")
        o.delete(f"r/{names[0]}")
        try:
            o.get(f"r/{names[0]}")
            gone = False
        except NotFoundError:
            gone = not o.exists(f"r/{names[0]}")
        rows = [(k, o.get(k).decode(), o.head(k).size, o.get_range(k, 1, 3).decode(), taken[k[2:]], o.exists(k), gone) for k in o.list("r/")]
        return s.createDataFrame(rows, "key string, data string, size long, part string, taken boolean, present boolean, gone boolean")

    return run


for _name, _make in {"obj_memory": lambda s: MemoryStore(), "obj_hadoop": lambda s: HadoopStore(s, _folder(s, "objects"))}.items():
    query(_name, "select 'r/' || r_name as key, r_name as data, strlen(r_name) as size, substr(r_name, 2, 3) as part, true as taken, true as present, true as gone from region where r_regionkey <> 0")(_objects(_make))


@query("obj_s3_options", "select * from (values ('spark.hadoop.fs.s3a.access.key', 'k'), ('spark.hadoop.fs.s3a.endpoint', 'https://x'), ('spark.hadoop.fs.s3a.endpoint.region', 'auto'), ('spark.hadoop.fs.s3a.path.style.access', 'true'), ('spark.hadoop.fs.s3a.secret.key', 's')) v(name, value)")
def _s3(s: SparkSession, d: str) -> DataFrame:
    return s.createDataFrame(sorted(s3_options("https://x", "", "k", "s").items()), "name string, value string")


# --- documents ---------------------------------------------------------------------------------

_PLAIN = Schema({"region": FieldDefinition(FieldType.INT, indexed=True), "title": FieldDefinition(FieldType.STRING, full_text=True)})


def _nation_table(s: SparkSession, d: str, **options) -> DocumentTable:
    table = DocumentTable(s, _folder(s, "tables"), "nations", **{"schema": _PLAIN} | options)
    table.put_documents([Document(r.n_name, f"the nation {r.n_name.lower()}", {"region": r.n_regionkey}) for r in nations(s, d)])
    return table


NATION_DOCS = "docs as (select n_name as id, 'the nation ' || lower(n_name) as content, n_regionkey as region from nation)"


@query("doc_put_get", f"with {NATION_DOCS} select id, content, region::bigint as region, case when region = 1 then 2 else 1 end::bigint as version, true as created_first, true as updated_later from docs where region <> 2")
def _put_get(s: SparkSession, d: str) -> DataFrame:
    """Documents put in bulk, region 1 put again, region 2 deleted; each read by its id."""
    table = _nation_table(s, d)
    before = {r.n_name: table.get_document(r.n_name) for r in nations(s, d)[:1]}
    table.put_documents([Document(r.n_name, f"the nation {r.n_name.lower()}", {"region": 1}) for r in nations(s, d) if r.n_regionkey == 1])
    for r in nations(s, d):
        if r.n_regionkey == 2:
            table.delete_document(r.n_name)
    found = [x for r in nations(s, d) if (x := table.get_document(r.n_name))]
    first = next(iter(before.values())).created_at
    return s.createDataFrame([(x.id, x.content, x.attributes["region"], x.version, x.created_at == first, x.updated_at >= x.created_at) for x in found], "id string, content string, region long, version long, created_first boolean, updated_later boolean")


@query("doc_list_pages", "select n_name as id, (row_number() over (order by n_name) - 1) // 7 as page, (row_number() over (order by n_name) - 1) // 7 < ((select count(*) from nation) - 1) // 7 as more from nation")
def _list_pages(s: SparkSession, d: str) -> DataFrame:
    table, after, rows, page, more = _nation_table(s, d), "", [], 0, True
    while more:
        docs, more = table.list_documents(7, after)
        rows += [(x.id, page, more) for x in docs]
        after, page = docs[-1].id, page + 1
    return s.createDataFrame(rows, "id string, page long, more boolean")


@query("doc_upsert_frame", "select lpad(doc_id::varchar, 8, '0') as id, length(text) as size, case when lang = 'en' then 2 else 1 end::bigint as version, lang from documents")
def _upsert_frame(s: SparkSession, d: str) -> DataFrame:
    """All documents written as a frame, then the English ones again."""
    table, rows = DocumentTable(s, _folder(s, "tables"), "docs"), _frame(s, d)
    table.upsert(rows)
    table.upsert(rows.where("lang = 'en'"))
    return table.documents().select("id", F.length("content").alias("size"), "version", F.get_json_object("attributes", "$.lang").alias("lang"))


def _frame(s: SparkSession, d: str) -> DataFrame:
    docs = t.read(s, d, "documents")
    return docs.select(F.lpad(F.col("doc_id").cast("string"), 8, "0").alias("id"), F.col("text").alias("content"), F.to_json(F.struct("lang")).alias("attributes"), "lang")


class _Lengths:
    """An embedder for queries whose answer SQL can compute."""

    def embed(self, texts: list[str], model: str) -> list[list[float]]:
        return [[float(len(x)), float(ord(x[0]))] for x in texts]


@query("doc_embed_frame", "select lpad(doc_id::varchar, 8, '0') as id, length(text)::float as size, ascii(text)::float as first, 'm' as model from documents where text <> ''")
def _embed_frame(s: SparkSession, d: str) -> DataFrame:
    """All documents embedded as they are written."""
    table = DocumentTable(s, _folder(s, "tables"), "docs", Schema({"lang": FieldDefinition(FieldType.INT)}, "m", 2), _Lengths())
    table.upsert(_frame(s, d).withColumn("attributes", F.lit("{}")))
    return table.documents().where("embedding is not null").select("id", F.col("embedding")[0].alias("size"), F.col("embedding")[1].alias("first"), F.col("embedding_model").alias("model"))


@query("doc_schema_diff", "select * from (values ('model', false, false, true), ('none', false, false, false), ('title', true, true, false), ('indexed', true, false, false)) v(change, indexed, full_text, embedding)")
def _diff(s: SparkSession, d: str) -> DataFrame:
    old = Schema({"a": FieldDefinition(FieldType.INT, indexed=True)}, "m", 2)
    title = FieldDefinition(FieldType.STRING, indexed=True, full_text=True)
    new = {"model": old.evolve(embedding_model="n"), "none": old, "title": old.evolve(fields={**old.fields, "title": title}), "indexed": old.evolve(fields={"a": FieldDefinition(FieldType.INT)})}
    changes = [(k, diff(old, x)) for k, x in new.items()]
    return s.createDataFrame([(k, bool(c.indexed), bool(c.full_text), bool(c.embedding)) for k, c in changes], "change string, indexed boolean, full_text boolean, embedding boolean")


@query("doc_names", "select n_name as name, true as valid from nation union all select * from (values ('', false), ('.', false), ('..', false), ('a/b', false)) v(name, valid)")
def _names(s: SparkSession, d: str) -> DataFrame:
    def valid(name: str) -> bool:
        try:
            return validate_name(name) == name
        except ValueError:
            return False

    return s.createDataFrame([(n, valid(n)) for n in [*(r.n_name for r in nations(s, d)), "", ".", "..", "a/b"]], "name string, valid boolean")


@query("attr_validation", "select * from (values (0, false), (1, false), (2, false), (3, false), (4, true), (5, true)) v(n, valid)")
def _validation(s: SparkSession, d: str) -> DataFrame:
    cases = [Filter("", "eq", 1), Filter("a", "like", 1), Filter("a", "gt", "1"), Filter("a", "in", 1), Filter("a", "in", []), Filter("a", "gte", 1.5)]

    def valid(f: Filter) -> bool:
        try:
            validate([f])
            return True
        except FilterError:
            return False

    return s.createDataFrame([(k, valid(f)) for k, f in enumerate(cases)], "n int, valid boolean")


@query("attr_table_search", f"with {NATION_DOCS} select id, region::bigint as region from docs where region in (1, 3) and region > 1")
def _table_search(s: SparkSession, d: str) -> DataFrame:
    found = _nation_table(s, d).search_attributes([Filter("region", "in", [1, 3]), Filter("region", "gt", 1)])
    return s.createDataFrame([(x.id, x.attributes["region"]) for x in found], "id string, region long")


@query("vec_by_text", "select n_name as id, row_number() over (order by list_cosine_distance([length(n_name), ascii(n_name)]::double[], [5, 67]::double[]), n_name) as place from nation qualify place <= 5")
def _by_text(s: SparkSession, d: str) -> DataFrame:
    """The nearest documents to a text, embedded on writing and on asking."""
    table = DocumentTable(s, _folder(s, "tables"), "nations", Schema({}, "m", 2), _Lengths())
    table.put_documents([Document(r.n_name, r.n_name) for r in nations(s, d)])
    return s.createDataFrame([(x.id, k + 1) for k, x in enumerate(table.search_vector_by_text("CHINA", 5))], "id string, place long")


@query("doc_unavailable", "select * from (values ('closed', true), ('degraded', true), ('text', true), ('vector', true)) v(what, raised)")
def _unavailable(s: SparkSession, d: str) -> DataFrame:
    """Searches that a table doesn't offer, or not any more."""

    def raised(work: Callable[[], object], kind: type) -> bool:
        try:
            work()
            return False
        except kind:
            return True

    table = _nation_table(s, d, full_text=False)
    rows = [("text", raised(lambda: table.search_text("x"), FullTextUnavailableError)), ("vector", raised(lambda: table.search_vector([1.0], 1), VectorUnavailableError))]
    table._error = OSError("disk")
    rows.append(("degraded", raised(lambda: table.search_attributes([]), IndexDegradedError)))
    table.close()
    rows.append(("closed", raised(lambda: table.documents(), RuntimeError)))
    return s.createDataFrame(rows, "what string, raised boolean")


# --- text index --------------------------------------------------------------------------------

DOCS = "docs as (select doc_id as id, text as content, lang from documents)"
WORDS = "words as (select id, list_filter(string_split_regex(lower(content), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') as w from docs)"
SCORES = """p as (
  select id, len(w) as dl, len(list_filter(w, lambda x: x = 'the')) as the, len(list_filter(w, lambda x: x = 'der')) as der from words where len(w) > 0
), c as (
  select count(*) as n, avg(dl) as mean, count(*) filter (the > 0) as df1, count(*) filter (der > 0) as df2 from p
), s as (
  select id, ln(1 + (n - df1 + 0.5) / (df1 + 0.5)) * the * 2.2 / (the + 1.2 * (0.25 + 0.75 * dl / mean)) + ln(1 + (n - df2 + 0.5) / (df2 + 0.5)) * der * 2.2 / (der + 1.2 * (0.25 + 0.75 * dl / mean)) as score
  from p, c where the > 0 or der > 0
)"""


def _content(s: SparkSession, d: str) -> DataFrame:
    return t.read(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), "lang")


@query("fts_index", f"with {DOCS}, {WORDS}, {SCORES} select id, round(score, 6) as score from s")
def _index(s: SparkSession, d: str) -> DataFrame:
    """All documents indexed; a query answered from the postings of its terms."""
    index = X.PostingsIndex.open(s, _folder(s, "index"))
    index.build(_content(s, d), "id", {"content": "content"})
    return index.search("the der").select("id", F.round("score", 6).alias("score"))


@query("fts_index_delta", f"with docs as (select doc_id as id, case when lang = 'en' then text || ' der' else text end as content from documents where lang <> 'fr'), {WORDS}, {SCORES} select id, round(score, 6) as score from s")
def _index_delta(s: SparkSession, d: str) -> DataFrame:
    """The index after the English documents changed and the French ones went: two generations on top of the first."""
    index, docs, fields = X.PostingsIndex.open(s, _folder(s, "index")), _content(s, d), {"content": "content"}
    index.build(docs, "id", fields)
    changed = docs.where("lang = 'en'").withColumn("content", F.concat("content", F.lit(" der")))
    index.apply(changed, changed, "id", fields)
    index.apply(docs.limit(0), docs.where("lang = 'fr'"), "id", fields)
    return index.search("the der").select("id", F.round("score", 6).alias("score"))


@query("fts_index_merge", f"with docs as (select doc_id as id, text as content from documents where lang <> 'fr'), {WORDS} select id, (select count(*) from words where len(w) > 0) as documents from words where contains(' ' || array_to_string(w, ' ') || ' ', ' of the ')")
def _index_merge(s: SparkSession, d: str) -> DataFrame:
    """A phrase from an index whose generations were merged."""
    index, docs, fields = X.PostingsIndex.open(s, _folder(s, "index")), _content(s, d), {"content": "content"}
    index.build(docs.where("lang <> 'de'"), "id", fields)
    index.apply(docs.where("lang = 'de'"), docs.where("lang in ('de', 'fr')"), "id", fields)
    index.merge()
    return index.search('"of the"').select("id").withColumn("documents", F.lit(index.count()).cast("long"))


@query("fts_table_search", f"with {NATION_DOCS} select id, 1 as hits, true as ready, 26::bigint as indexed from docs where id = 'CHINA' union all select 'NEW', 1, true, 26")
def _text_search(s: SparkSession, d: str) -> DataFrame:
    """Text searches of a table: what was put after the index was written is found too."""
    table = _nation_table(s, d)
    table.wait_for_indexes()
    found, total = table.search_text("+the +china")
    table.put_document(Document("NEW", "of the brand new", {"title": "Sunrise"}))
    more, again = table.search_text("attr_title:sunrise")
    status = table.index_status()
    rows = [(x.id, n, status.ready, status.last_indexed) for docs, n in ((found, total), (more, again)) for x in docs]
    return s.createDataFrame(rows, "id string, hits int, ready boolean, indexed long")


# --- index maintenance -------------------------------------------------------------------------


def _built(s: SparkSession, d: str, later: bool) -> DataFrame:
    log, _ = quarters(s, d)
    log = log.drop("segment") if not later else log
    store, index = scratch_store(s, "double"), scratch_store(s, "double")
    builder = Builder(store, StoreIndexer(index), "events", store.files)
    if later:
        for k in range(4):  # the first rebuilds, the others catch up
            store.write(log.where(F.col("segment") == k).drop("segment"))
            builder.catch_up()
    else:
        store.write(log)
        builder.rebuild()
    return index.scan().select("key", "value").withColumn("checkpoint", F.lit(load_checkpoint(store.files, "events")).cast("long"))


_BUILT = f"with {EVENTS}, {NEWEST} select key, value, (select max(seq) from events_log)::bigint as checkpoint from newest where value is not null"
query("idx_builder_rebuild", _BUILT)(lambda s, d: _built(s, d, False))
query("idx_builder_catchup", _BUILT)(lambda s, d: _built(s, d, True))


@query("idx_status", "select * from (values ('after', true, 26::bigint, 26::bigint), ('before', true, 25, 0), ('reset', true, 26, 0), ('schema', true, 26, 26), ('stale', true, 26, 25), ('wait', true, 25, 25)) v(stage, ready, accepted, indexed)")
def _status(s: SparkSession, d: str) -> DataFrame:
    """The status of a table's index from its first write to a reset."""
    table, rows = _nation_table(s, d), []

    def note(at: str) -> None:
        x = table.index_status()
        rows.append((at, x.ready, x.last_accepted, x.last_indexed))

    note("before")
    table.wait_for_indexes()
    note("wait")
    table.put_document(Document("NEW", "x"))
    note("stale")
    table.wait_for_indexes()
    note("after")
    table.reset_indexes()
    note("reset")
    table.wait_for_indexes()
    table.set_schema(_PLAIN.evolve(fields={"region": FieldDefinition(FieldType.INT)}))
    note("schema")
    return s.createDataFrame(rows, "stage string, ready boolean, accepted long, indexed long")
