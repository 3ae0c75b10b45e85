"""A document table: versioned documents in a store, searched by attributes, text and vectors.

Attribute and vector searches read the table's snapshot. Text searches read a written inverted index, to which
they first apply what was written since; all are always up to date.
"""

from __future__ import annotations

import bisect
import datetime
import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkdoc.functions.names import ulid, validate_name
from sparkdoc.functions.schema import FieldType, Schema, SchemaChange, ValidationError, diff, violations
from sparkdoc.operators import documents as D
from sparkdoc.operators import entries as E
from sparkdoc.operators import filters as A
from sparkdoc.operators import fulltext as X
from sparkdoc.operators import vector as V
from sparkdoc.sources.store import ClosedError, Store
from sparkdoc.streaming.index import Builder, delete_checkpoint, load_checkpoint, save_checkpoint


class FullTextUnavailableError(RuntimeError):
    """The table was opened without full text."""


class VectorUnavailableError(RuntimeError):
    """The schema names no vector dimensions."""


class IndexDegradedError(RuntimeError):
    """The last index build failed; a successful one heals it."""


class Embedder(Protocol):
    def embed(self, texts: list[str], model: str) -> list[list[float]]: ...


@dataclass
class Document:
    id: str = ""
    content: str = ""
    attributes: dict[str, Any] = field(default_factory=dict)
    embedding: list[float] = field(default_factory=list)
    embedding_model: str = ""
    created_at: datetime.datetime | None = None
    updated_at: datetime.datetime | None = None
    version: int = 0


@dataclass(frozen=True)
class IndexStatus:
    ready: bool
    last_accepted: int
    last_indexed: int
    error: Exception | None = None


def _utc(x: datetime.datetime | None) -> datetime.datetime | None:
    return x if x is None or x.tzinfo else x.replace(tzinfo=datetime.UTC)


def _json(attributes: dict[str, Any]) -> str:
    text = lambda x: x.isoformat().replace("+00:00", "Z") if isinstance(x, datetime.datetime) else str(x)
    try:
        return json.dumps(attributes, allow_nan=False, default=text, sort_keys=True)
    except ValueError as e:
        raise ValidationError(f"attributes can't be stored: {e}") from e


def _document(row: Any) -> Document:
    return Document(row.id, row.content or "", json.loads(row.attributes) if row.attributes else {}, list(row.embedding or []), row.embedding_model or "", _utc(row.created_at), _utc(row.updated_at), row.version)


class DocumentTable:
    def __init__(self, spark: SparkSession, path: str, name: str, schema: Schema | None = None, embedder: Embedder | None = None, full_text: bool = True) -> None:
        self.spark, self.name = spark, validate_name(name)
        self.path = f"{path.rstrip('/')}/{name}"
        self.store = Store(spark, self.path, D.DOCUMENT)
        self._schema, self.embedder, self._full_text = schema, embedder, full_text
        self._error: Exception | None = None
        self._closed = False

    def __enter__(self) -> DocumentTable:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    @property
    def schema(self) -> Schema | None:
        return self._schema

    @property
    def system(self) -> str:
        return f"table-{self.name}"

    def _open(self) -> None:
        if self._closed:
            raise ClosedError(self.name)

    # --- writing

    def put_document(self, doc: Document) -> Document:
        return self.put_documents([doc])[0]

    def put_documents(self, docs: Sequence[Document]) -> list[Document]:
        """Validate all, then write all in one flush; the stored documents, with ids, times and versions."""
        self._open()
        for d in docs:
            if self._schema:
                self._schema.validate(d.attributes)
            _json(d.attributes)
        now = datetime.datetime.now(datetime.UTC)
        named = [replace(d, id=d.id or ulid()) for d in docs]
        ids = sorted({d.id for d in named})
        known = {r.id: r for r in self._live(F.col("key").isin(ids), ids).select("id", "created_at", "version").collect()} if ids else {}
        embedded = self._embed(named)
        out = []
        for d in embedded:
            old = known.get(d.id)
            created = _utc(old.created_at) if old else d.created_at or now
            out.append(replace(d, created_at=created, updated_at=now, version=old.version + 1 if old else d.version or 1))
            self._dimensions(d.embedding)
        for d in out:
            self.store.put(d.id, (d.content or None, _json(d.attributes) if d.attributes else None, [float(x) for x in d.embedding] or None, d.embedding_model or None, d.created_at, d.updated_at, d.version))
        self.store.flush()
        return out

    def _dimensions(self, vector: Sequence[float]) -> None:
        dims = self._schema.embedding_dims if self._schema else 0
        if dims > 0 and len(vector) and len(vector) != dims:
            raise V.DimensionError(f"vector has {len(vector)} dimensions, the schema {dims}")

    def _embed(self, docs: list[Document]) -> list[Document]:
        model = self._schema.embedding_model if self._schema else ""
        if not (self.embedder and model):
            return docs
        texts = [self._text(d) for d in docs]
        some = [k for k, t in enumerate(texts) if t]
        vectors = self.embedder.embed([texts[k] for k in some], model) if some else []
        made = dict(zip(some, vectors, strict=True))
        return [replace(d, embedding=list(made[k]), embedding_model=model) if k in made else d for k, d in enumerate(docs)]

    @staticmethod
    def _text(d: Document) -> str:
        parts = [d.content] if d.content else []
        for name in sorted(d.attributes):
            v = d.attributes[name]
            if isinstance(v, str):
                parts.append(v)
            elif isinstance(v, (list, tuple)) and v and all(isinstance(x, str) for x in v):
                parts.extend(v)
        return "\n".join(parts)

    def upsert(self, df: DataFrame) -> int:
        """Write a DataFrame of documents (id, content, attributes as JSON, embedding, embedding_model): one segment.

        Every row is validated before any is written. Of several rows of one id one stays, all with the next
        version.
        """
        self._open()
        if self._schema:
            bad = df.select("id", violations(self._schema, F.col("attributes")).alias("v")).where(F.size("v") > 0).limit(3).collect()
            if bad:
                raise ValidationError("; ".join(f"{r.id}: {', '.join(r.v)}" for r in bad))
        df = self._embed_frame(df)
        dims = self._schema.embedding_dims if self._schema else 0
        if dims > 0 and "embedding" in df.columns:  # checked as it is written: a failed write commits nothing
            wrong = F.concat(F.lit("vector of other dimensions than the schema's: "), F.col("id"))
            df = df.withColumn("embedding", F.when((F.size("embedding") > 0) & (F.size("embedding") != dims), F.raise_error(wrong).cast(df.schema["embedding"].dataType)).otherwise(F.col("embedding")))
        prepared = D.prepare(df, self._live(F.lit(True)), F.current_timestamp())
        entries = D.as_entries(prepared, F.monotonically_increasing_id() + self.store.last_seq + 1)
        return self.store.write(entries)

    def _embed_frame(self, df: DataFrame) -> DataFrame:
        """Embed the texts of a frame in Arrow batches on the executors; the write that follows runs it once a row."""
        model, embedder = self._schema.embedding_model if self._schema else "", self.embedder
        if not (embedder and model):
            return df

        @F.pandas_udf("array<float>")
        def embed(texts: pd.Series) -> pd.Series:
            some = texts.notna() & (texts != "")
            out = pd.Series([None] * len(texts), index=texts.index, dtype=object)
            if some.any():
                out[some] = pd.Series([list(map(float, v)) for v in embedder.embed(texts[some].tolist(), model)], index=texts.index[some], dtype=object)
            return out

        kinds = {n: f.type for n, f in self._schema.fields.items()}
        json = lambda n: F.get_json_object("attributes", f"$['{n}']")
        values = {n: F.from_json(json(n), "array<string>") if t is FieldType.STRINGS else json(n) for n, t in kinds.items()}
        made = df.withColumn("__vector", embed(D.embedding_text(F.nullif(F.col("content"), F.lit("")), values, kinds)))
        old = {c: F.col(c) if c in df.columns else F.lit(None) for c in ("embedding", "embedding_model")}
        return made.withColumns({"embedding": F.coalesce("__vector", old["embedding"].cast("array<float>")), "embedding_model": F.when(F.col("__vector").isNotNull(), model).otherwise(old["embedding_model"].cast("string"))}).drop("__vector")

    def delete_document(self, id: str) -> None:
        self._open()
        self.store.delete(id)
        self.store.flush()

    # --- reading

    def _live(self, where: Any, keys: Sequence[str] | None = None) -> DataFrame:
        """Live documents; with ``keys`` (sorted), only segments are read whose range holds one."""
        df, unique = self.store.entries(lambda s: keys is None or (at := bisect.bisect_left(keys, s.min_key)) < len(keys) and keys[at] <= s.max_key)
        return D.of_entries(E.latest(df.where(where), unique))

    def documents(self) -> DataFrame:
        """All live documents."""
        self._open()
        return self._live(F.lit(True))

    def get_document(self, id: str) -> Document | None:
        self._open()
        rows = self._live(F.col("key") == F.lit(id), [id]).collect()  # one key
        return _document(rows[0]) if rows else None

    def list_documents(self, limit: int, after: str = "") -> tuple[list[Document], bool]:
        """Documents with id > after in id order, and whether more follow."""
        self._open()
        df, unique = self.store.entries(lambda s: s.max_key > after)
        rows = D.of_entries(E.live(df.where(F.col("key") > F.lit(after)), unique)).orderBy("id").limit(limit + 1).collect()
        return [_document(r) for r in rows[:limit]], len(rows) > limit

    def search_attributes(self, filters: Sequence[A.Filter], limit: int = 0, offset: int = 0) -> list[Document]:
        found = self.attribute_hits(filters)
        return [_document(r) for r in A.page(found, limit, offset, "id").collect()]

    def attribute_hits(self, filters: Sequence[A.Filter]) -> DataFrame:
        self._open()
        self._healthy()
        A.validate(filters)
        docs = self.documents()
        indexed = self._schema.indexed() if self._schema else None
        return docs.where(A.predicate(filters, attributes=F.parse_json(F.coalesce("attributes", F.lit("{}"))), indexed=indexed))

    def _text_fields(self, docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
        fields = {"content": "content"}
        for name, f in sorted((self._schema.fields if self._schema else {}).items()):
            if f.full_text or f.type in (FieldType.INT, FieldType.FLOAT, FieldType.BOOL, FieldType.DATETIME):
                docs = docs.withColumn(f"attr_{name}", F.get_json_object("attributes", f"$['{name}']"))
                fields[f"attr_{name}"] = f"attr_{name}"
        return docs, fields

    def search_text(self, query: str, limit: int = 0, offset: int = 0) -> tuple[list[Document], int]:
        """A page of documents by falling relevance, and the number of all hits."""
        self._open()
        self._healthy()
        if not self._full_text:
            raise FullTextUnavailableError(self.name)
        self.wait_for_indexes()
        hits = self.text_index().search(query).cache()
        total = hits.count()
        top = {r.id: r.score for r in X.ranked(hits, limit, offset).collect()}  # a page
        hits.unpersist()
        ids = sorted(top)
        rows = self._live(F.col("key").isin(ids), ids).collect() if ids else []
        return [_document(r) for r in sorted(rows, key=lambda r: (-top[r.id], r.id))], total

    def search_vector(self, query: Sequence[float], k: int) -> list[Document]:
        """The ``k`` nearest documents by cosine distance."""
        self._open()
        self._healthy()
        dims = self._schema.embedding_dims if self._schema else 0
        if dims <= 0:
            raise VectorUnavailableError(self.name)
        return [_document(r) for r in V.nearest_documents(self.documents(), query, k, dims=dims).collect()]

    def search_vector_by_text(self, text: str, k: int) -> list[Document]:
        self._open()
        if not self.embedder:
            raise VectorUnavailableError("no embedder")
        (vector,) = self.embedder.embed([text], self._schema.embedding_model if self._schema else "")
        return self.search_vector(vector, k)

    # --- indexes

    def _healthy(self) -> None:
        if self._error:
            raise IndexDegradedError(str(self._error)) from self._error

    def index_status(self) -> IndexStatus:
        return IndexStatus(self._error is None and not self._closed, self.store.last_seq, max(load_checkpoint(self.store.files, self.system), 0), self._error)

    def _builder(self) -> Builder:
        return Builder(self.store, X.TextIndexer(self.text_index(), self._text_fields, D.of_entries), self.system, self.store.files)

    def wait_for_indexes(self) -> None:
        """Bring the written index up to the last accepted write: what changed since its checkpoint is applied."""
        self._maintain(lambda: self._builder().catch_up() if self.text_index().exists() else self._builder().rebuild())

    def rebuild_indexes(self) -> None:
        """Write the inverted index of the snapshot anew; a failure stays until a later success."""
        self._error = None
        self._maintain(lambda: self._builder().rebuild())

    def _maintain(self, work: Callable[[], int]) -> None:
        self._open()
        self._healthy()
        try:
            if self._full_text:
                work()
            else:
                save_checkpoint(self.store.files, self.system, self.store.last_seq)
        except Exception as e:
            self._error = e
            raise

    def text_index(self) -> X.PostingsIndex:
        return X.PostingsIndex(self.spark, self.store.files)

    def reset_indexes(self) -> None:
        self._open()
        delete_checkpoint(self.store.files, self.system)
        self.text_index().reset()

    def set_schema(self, schema: Schema | None) -> SchemaChange:
        """Change the schema; stored documents aren't validated again. Rebuilds a written index if its fields changed."""
        self._open()
        change, self._schema = diff(self._schema, schema), schema
        if change and self.text_index().exists():
            self.rebuild_indexes()
        return change

    def close(self) -> None:
        self._closed = True
        self.store.close()
