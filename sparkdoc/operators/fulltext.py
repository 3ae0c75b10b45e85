"""Full-text search: analyzer, postings, a small query grammar, BM25 ranking.

Terms are lower-cased runs of letters and digits. A bare word is looked up in the content and in all
full-text fields; ``field:word`` in one field. ``+`` requires, ``-`` excludes, double quotes hold a phrase
(all its words, in a row). Fields that aren't mapped match nothing.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkdoc.sources.objects import HadoopStore, NotFoundError

K1, B = 1.2, 0.75
DEFAULT_LIMIT = 10
_SEPARATORS = r"[^\p{L}\p{N}]+"


class QueryError(ValueError):
    """A query string that can't be parsed."""


def tokens(text: Column) -> Column:
    """Terms of a text in order."""
    return F.filter(F.split(F.lower(text), _SEPARATORS), lambda t: t != "")


def projection(docs: DataFrame, id_col: str, fields: dict[str, str]) -> DataFrame:
    """(id, field, text) of the mapped columns that hold something; ``fields`` maps field names to columns."""
    parts = F.array(*[F.struct(F.lit(name).alias("field"), docs[c].cast("string").alias("text")) for name, c in fields.items()])
    return docs.select(docs[id_col].alias("id"), F.explode(parts).alias("p")).select("id", "p.field", "p.text").where("text is not null and text <> ''")


#: Words that a kernel sorts at a time: to count them in their rows, and to pack them for an index.
CHUNK_WORDS, PACKED_WORDS = 1 << 18, 1 << 21
_POSTING = "field string, term string, tf long, dl long"
_PACKED = "chunk long, field string, term string"


def _words(docs: DataFrame, id_col: str, fields: dict[str, str]) -> DataFrame:
    return docs.select(docs[id_col].alias("id"), *[tokens(docs[c].cast("string")).alias(f"w{k}") for k, c in enumerate(fields.values())])


def _chunks(batches: Iterator[pa.RecordBatch], names: list[str], most: int) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray, str]]:
    """(ids, words, words a row, field) of about ``most`` words each; a longer row is a chunk of its own."""
    for batch in batches:
        for k, name in enumerate(names):
            length = pc.fill_null(pc.list_value_length(batch.column(k + 1)), 0).to_numpy().astype(np.int64)
            end = np.cumsum(length)
            i = 0
            while i < len(end):
                j = max(i + 1, int(np.searchsorted(end, end[i] - length[i] + most, side="right")))
                if length[i:j].any():
                    yield batch.column(0).slice(i, j - i), batch.column(k + 1).slice(i, j - i), length[i:j], name
                i = j


def postings(docs: DataFrame, id_col: str, fields: dict[str, str], places: bool = True) -> DataFrame:
    """(id, field, term, tf, dl, pos): how often a term stands in a field and where (unless not asked for), and how many terms the field has.

    A row's terms are counted inside the row, so nothing is shuffled.
    """
    names, source = list(fields), _words(docs, id_col, fields)
    schema = T.StructType([source.schema["id"], *T._parse_datatype_string(_POSTING + ", pos array<int>" * places).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, words, length, name in _chunks(batches, names, CHUNK_WORDS):
            yield _count(ids, words, length, name, places, schema.names)

    return source.mapInArrow(run, schema)


def _count(ids: pa.Array, words: pa.Array, length: np.ndarray, name: str, places: bool, columns: list[str]) -> pa.RecordBatch:
    """Run lengths of the sorted (row, term) pairs of some rows."""
    coded = words.flatten().dictionary_encode()
    row = np.repeat(np.arange(len(length)), length)
    key = row * len(coded.dictionary) + coded.indices.to_numpy()
    order = np.argsort(key, kind="stable")
    key = key[order]
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    owner, code = np.divmod(key[begin], len(coded.dictionary))
    made = [ids.take(pa.array(owner)), pa.array([name]).take(pa.array(np.zeros(len(owner), np.int8))), coded.dictionary.take(pa.array(code)), pa.array(np.diff(np.append(begin, len(row)))), pa.array(length[owner])]
    if places:
        place = (np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length))[order]
        made.append(pa.ListArray.from_arrays(pa.array(np.append(begin, len(row)), pa.int32()), pa.array(place, pa.int32())))
    return pa.RecordBatch.from_arrays(made, names=columns)


def packed(docs: DataFrame, id_col: str, fields: dict[str, str], generation: int = 0) -> DataFrame:
    """(chunk, field, term, ids, tf, dl, pos): the postings of each term and field in a chunk of rows; ``pos`` holds the places of all, ``tf`` of them each.

    A blank term has the rows of a chunk that have terms. No chunk has the number of one of another generation.
    """
    names, source = list(fields), _words(docs, id_col, fields)
    schema = T.StructType([*T._parse_datatype_string(_PACKED).fields, T.StructField("ids", T.ArrayType(source.schema["id"].dataType)), *T._parse_datatype_string("tf array<int>, dl array<int>, pos array<int>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = generation << 44 | TaskContext.get().partitionId() << 24
        for ids, words, length, name in _chunks(batches, names, PACKED_WORDS):
            yield _pack(ids, words, length, name, chunk, schema.names)
            chunk += 1

    return source.mapInArrow(run, schema)


def _lists(cut: np.ndarray, values: pa.Array | np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(cut, pa.int32()), values if isinstance(values, pa.Array) else pa.array(values, pa.int32()))


def _pack(ids: pa.Array, words: pa.Array, length: np.ndarray, name: str, chunk: int, columns: list[str]) -> pa.RecordBatch:
    """Words sorted by term, and cut into rows and terms; a row for the blank term goes before."""
    coded = words.flatten().dictionary_encode()
    code = coded.indices.to_numpy()
    order = np.argsort(code.astype(np.uint16) if len(coded.dictionary) <= 1 << 16 else code, kind="stable")  # words come row by row
    row = np.repeat(np.arange(len(length), dtype=np.int32), length)[order]
    place = (np.arange(len(code)) - np.repeat(np.cumsum(length) - length, length)).astype(np.int32)[order]
    code = code[order]
    next_term = np.concatenate([[True], code[1:] != code[:-1]])
    begin = np.flatnonzero(next_term | np.concatenate([[True], row[1:] != row[:-1]]))
    tf, owner, some = np.diff(np.append(begin, len(row))), row[begin], np.flatnonzero(length)
    terms = np.flatnonzero(next_term)
    cut = np.concatenate([[0], len(some) + np.append(np.searchsorted(begin, terms), len(begin))])
    whose = np.concatenate([some, owner])
    n = len(terms) + 1
    term = pa.concat_arrays([pa.array([""], coded.dictionary.type), coded.dictionary.take(pa.array(code[terms]))])
    same = lambda x: x.take(pa.array(np.zeros(n, np.int8)))
    return pa.RecordBatch.from_arrays(
        [same(pa.array([chunk], pa.int64())), same(pa.array([name])), term, _lists(cut, ids.take(pa.array(whose))), _lists(cut, np.concatenate([np.zeros(len(some), np.int64), tf])), _lists(cut, length[whose]), _lists(np.concatenate([[0], terms, [len(row)]]), place)],
        names=columns,
    )


def _unpacked(rows: DataFrame, places: bool = False) -> DataFrame:
    """(id, field, term, tf, dl) of packed postings, and pos if asked for."""
    schema = T.StructType([T.StructField("id", rows.schema["ids"].dataType.elementType), *T._parse_datatype_string(_POSTING + ", pos array<int>" * places).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = pc.list_value_length(b.column(2)).to_numpy(zero_copy_only=False)
            owner, tf = pa.array(np.repeat(np.arange(len(n)), n)), b.column(3).flatten()
            made = [b.column(2).flatten(), b.column(0).take(owner), b.column(1).take(owner), tf.cast(pa.int64()), b.column(4).flatten().cast(pa.int64())]
            if places:
                made.append(_lists(np.concatenate([[0], np.cumsum(tf.to_numpy())]), b.column(5).flatten()))
            yield pa.RecordBatch.from_arrays(made, names=schema.names)

    return rows.select("field", "term", "ids", "tf", "dl", *["pos"] * places).mapInArrow(run, schema)


def _without(left: pa.Table, right: pa.Table) -> pa.Table:
    """A chunk's packed postings without those of the ids of ``right``."""
    if not right.num_rows or not left.num_rows:
        return left
    ids, tf, dl, pos = (left.column(c).combine_chunks() for c in ("ids", "tf", "dl", "pos"))
    cuts = lambda x: np.concatenate([[0], np.cumsum(pc.list_value_length(x).to_numpy(zero_copy_only=False))])
    before = lambda kept: np.concatenate([[0], np.cumsum(kept)])
    stays = pc.invert(pc.is_in(ids.flatten(), value_set=right.column("id").combine_chunks()))
    kept = stays.to_numpy(zero_copy_only=False)
    placed = np.repeat(kept, tf.flatten().to_numpy())
    cut, at = before(kept)[cuts(ids)], before(placed)[cuts(pos)]
    made = [left.column(c) for c in ("chunk", "field", "term")] + [_lists(cut, x.flatten().filter(stays)) for x in (ids, tf, dl)] + [_lists(at, pos.flatten().filter(pa.array(placed)))]
    return pa.table(made, names=left.column_names).filter(pa.array(np.diff(cut) > 0))


@dataclass(frozen=True)
class Clause:
    terms: tuple[str, ...]
    field: str | None = None
    must: bool = False
    must_not: bool = False


_CLAUSE = re.compile(r'\s*([+-])?(?:([A-Za-z_][\w.]*):)?(?:"([^"]*)"|(\S+))')


def parse(query: str) -> list[Clause]:
    out, at = [], 0
    while at < len(query.rstrip()):
        m = _CLAUSE.match(query, at)
        if not m or m.group(4) and '"' in m.group(4):
            raise QueryError(f"can't parse {query[at:]!r}")
        at = m.end()
        words = tuple(w for w in re.split(r"[\W_]+", (m.group(3) if m.group(3) is not None else m.group(4)).lower()) if w)
        if words:
            out.append(Clause(words, m.group(2), m.group(1) == "+", m.group(1) == "-"))
    return out


def _occurrences(words: Column, terms: Sequence[str]) -> Column:
    """How often the terms stand in a row (overlaps count once)."""
    if len(terms) == 1:
        return F.size(F.filter(words, lambda w: w == terms[0])).cast("long")
    row = F.concat(F.lit(" "), F.array_join(words, "  "), F.lit(" "))  # each term between spaces of its own
    wanted = f" {'  '.join(terms)} "
    return ((F.length(row) - F.length(F.replace(row, F.lit(wanted), F.lit("")))) / len(wanted)).cast("long")


def search(docs: DataFrame, query: str, id_col: str = "id", fields: dict[str, str] | None = None) -> DataFrame:
    """All hits (id, score), unordered: BM25 summed over clauses and fields.

    Only terms of the query are counted; the corpus sums (documents and their mean length per field) take a second
    scan of the text. Nothing but sums is shuffled. ``PostingsIndex`` answers the same without a scan.
    """
    fields = fields or {"content": "content"}
    kept = _over(parse(query), fields)
    words = docs.select(docs[id_col].alias("id"), *[tokens(docs[c].cast("string")).alias(f"w_{f}") for f, c in fields.items()])
    counted = words.select(
        "id",
        *[F.coalesce(F.size(f"w_{f}"), F.lit(0)).cast("long").alias(f"n_{f}") for f in fields],
        *[F.coalesce(_occurrences(F.col(f"w_{f}"), c.terms), F.lit(0)).alias(f"t_{k}_{f}") for k, c, over in kept for f in over],
    )
    sums = [F.sum((F.col(f"n_{f}") > 0).cast("long")).alias(f"docs_{f}") for f in fields] + [F.sum(f"n_{f}").alias(f"length_{f}") for f in fields]
    return _scored(counted, kept, sums)


def _over(clauses: list[Clause], fields: Iterable[str]) -> list[tuple[int, Clause, list[str]]]:
    """Clauses by number, with the fields that each looks at."""
    return [(k, c, [f for f in fields if c.field in (None, f)]) for k, c in enumerate(clauses)]


def _scored(counted: DataFrame, kept: list[tuple[int, Clause, list[str]]], sums: list[Column]) -> DataFrame:
    """Scores of rows (id, n_field, t_clause_field); ``sums`` give docs_field and length_field of the corpus."""
    sums = sums + [F.sum((F.col(f"t_{k}_{f}") > 0).cast("long")).alias(f"df_{k}_{f}") for k, _, over in kept for f in over]
    joined = counted.join(F.broadcast(counted.agg(*sums)), F.lit(True))  # with one row
    score, must, should, never = F.lit(0.0), F.lit(True), F.lit(False), F.lit(False)
    for k, c, over in kept:
        hit = F.lit(False)
        for f in over:
            tf, dl = F.col(f"t_{k}_{f}").cast("double"), F.col(f"n_{f}").cast("double")
            idf = F.log(1 + (F.col(f"docs_{f}") - F.col(f"df_{k}_{f}") + 0.5) / (F.col(f"df_{k}_{f}") + 0.5))
            mean = F.col(f"length_{f}") / F.col(f"docs_{f}")
            if not c.must_not:
                score = score + F.when(tf > 0, idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean))).otherwise(0.0)
            hit = hit | (tf > 0)
        must, never = (must & hit if c.must else must), (never | hit if c.must_not else never)
        should = should | hit if not c.must_not else should
    return joined.where(must & should & ~never).select("id", score.alias("score"))


def ranked(hits: DataFrame, limit: int = 0, offset: int = 0) -> DataFrame:
    """A page of hits by falling score, then id; a limit of 0 or less is ten, an offset below 0 is 0."""
    ordered = hits.orderBy(F.desc("score"), "id")
    return (ordered.offset(offset) if offset > 0 else ordered).limit(limit if limit > 0 else DEFAULT_LIMIT)


def total(hits: DataFrame) -> DataFrame:
    return hits.agg(F.count("*").alias("total"))


#: Generations of an index that are merged into one.
MERGE = 8


class PostingsIndex:
    """A stored inverted index: a query reads the rows of its terms in files sorted by term, and no text.

    Documents are added and removed in generations: each is a folder of postings with a list of the ids that it
    changes, so a change costs what it holds. A row counts unless a later generation changes its id. The corpus
    sums are kept with the list of generations, which one put replaces.
    """

    def __init__(self, spark: SparkSession, objects: HadoopStore, name: str = "text-index") -> None:
        self.spark, self.objects, self.name = spark, objects, name

    def _state(self) -> dict:
        try:
            return json.loads(self.objects.get(f"{self.name}/state.json"))
        except NotFoundError:
            return {"next": 0, "generations": [], "fields": {}}

    def _save(self, **state) -> None:
        self.objects.put(f"{self.name}/state.json", json.dumps(state).encode())

    def exists(self) -> bool:
        return self.objects.exists(f"{self.name}/state.json")

    @property
    def fields(self) -> list[str]:
        return sorted(self._state()["fields"])

    def count(self, field: str = "content") -> int:
        """Documents that have terms in a field."""
        return self._state()["fields"].get(field, [0, 0])[0]

    def _packed(self, g: int) -> DataFrame:
        return self.spark.read.parquet(self.objects.uri(f"{self.name}/g{g}/postings"))

    def _changed(self, g: int) -> DataFrame:
        return self.spark.read.parquet(self.objects.uri(f"{self.name}/g{g}/changed"))

    def _rows(self, state: dict, where: Column, places: bool = False) -> DataFrame:
        """Postings that count, of the terms that ``where`` lets through."""
        read = lambda g: _unpacked(self._packed(g).where(where), places)
        out = None
        for g in state["generations"]:
            if out is not None:
                out = out.join(self._changed(g), "id", "left_anti")
            out = read(g) if out is None else out.unionByName(read(g))
        return out

    def reset(self) -> None:
        """Forget everything."""
        self.objects.delete(self.name)

    def build(self, docs: DataFrame, id_col: str, fields: dict[str, str]) -> None:
        """Index ``docs`` from scratch; what was there stays readable until the new list of generations is put."""
        old = self._state()
        g = old["next"]
        self._write(packed(docs, id_col, fields, g), docs.select(docs[id_col].alias("id")).limit(0), g)
        self._save(next=g + 1, generations=[g], fields=self._sums([g], fields, {}))
        self._drop(old["generations"])

    def apply(self, docs: DataFrame, changed: DataFrame, id_col: str, fields: dict[str, str]) -> None:
        """Index ``docs`` in place of what the ids of ``changed`` (id) had; ids without a document are removed."""
        old = self._state()
        if not old["generations"]:
            return self.build(docs, id_col, fields)
        g = old["next"]
        self._write(packed(docs, id_col, fields, g), changed.select("id").distinct(), g)
        gone = self._rows(old, F.col("term") == "").join(self._changed(g), "id", "left_semi").groupBy("field").agg(F.count("*"), F.sum("dl")).collect()
        sums = {f: [n, size] for f, (n, size) in old["fields"].items()}
        for f, n, size in gone:
            sums[f] = [sums[f][0] - n, sums[f][1] - size]
        self._save(next=g + 1, generations=[*old["generations"], g], fields=self._sums([g], fields, sums))
        if len(old["generations"]) + 1 >= MERGE:
            self.merge()

    def merge(self) -> None:
        """Rewrite all generations as one; chunks meet the ids that later generations changed, and lose their postings."""
        old = self._state()
        g, out, later = old["next"], None, None
        for k in reversed(old["generations"]):
            rows = self._packed(k)
            changed = self._changed(k)
            if later is not None:
                heads = self._packed(k).where(F.col("term") == "").select("chunk", F.explode("ids").alias("id"))
                gone = heads.join(later, "id", "left_semi").distinct().select(F.col("chunk").alias("of"), "id")
                rows = rows.groupBy("chunk").cogroup(gone.groupBy("of")).applyInArrow(_without, rows.schema)
            out = rows if out is None else out.unionByName(rows)
            later = changed if later is None else later.unionByName(changed)
        self._write(out, changed.limit(0), g)
        self._save(next=g + 1, generations=[g], fields=old["fields"])
        self._drop(old["generations"])

    def _write(self, rows: DataFrame, changed: DataFrame, g: int) -> None:
        folder = self.objects.uri(f"{self.name}/g{g}")
        # each file is sorted by term: a query reads the pages of its terms in all files, and nothing is shuffled
        rows.sortWithinPartitions("term", "field").write.mode("overwrite").parquet(f"{folder}/postings")
        changed.write.mode("overwrite").parquet(f"{folder}/changed")

    def _sums(self, generations: list[int], fields: Iterable[str], sums: dict[str, list[int]]) -> dict[str, list[int]]:
        """Documents and terms of each field, those of new generations added."""
        out = {f: sums.get(f, [0, 0]) for f in {*fields, *sums}}
        for g in generations:
            heads = _unpacked(self._packed(g).where("term = ''"))
            for f, n, size in heads.groupBy("field").agg(F.count("*"), F.sum("dl")).collect():  # a row a field
                out[f] = [out[f][0] + n, out[f][1] + size]
        return out

    def _drop(self, generations: list[int]) -> None:
        for g in generations:
            self.objects.delete(f"{self.name}/g{g}")

    @staticmethod
    def write(docs: DataFrame, path: str, id_col: str, fields: dict[str, str]) -> None:
        """A new index of ``docs`` in a folder of its own."""
        PostingsIndex.open(docs.sparkSession, path).build(docs, id_col, fields)

    @staticmethod
    def open(spark: SparkSession, path: str) -> PostingsIndex:
        return PostingsIndex(spark, HadoopStore(spark, path), "index")

    def search(self, query: str | Iterable[str], field: str | None = None) -> DataFrame:
        """All hits (id, score), as ``search`` over the texts gives them; a list holds terms of which any is wanted."""
        state = self._state()
        clauses = parse(query) if isinstance(query, str) else [Clause((t,), field) for t in sorted({t.lower() for t in query})]
        kept = _over(clauses, sorted(state["fields"]))
        wanted = sorted({t for _, c, over in kept if over for t in c.terms})
        if not (wanted and state["generations"]):
            return self.spark.createDataFrame([], "id string, score double")
        of = lambda f, t, c: F.max(F.when((F.col("field") == f) & (F.col("term") == t), F.col(c)))
        looked = {(f, t) for _, c, over in kept for f in over for t in c.terms}
        phrased = {(f, t) for _, c, over in kept if len(c.terms) > 1 for f in over for t in c.terms}
        number = {t: k for k, t in enumerate(wanted)}
        rows = self._rows(state, F.col("term").isin(wanted), bool(phrased))
        grouped = rows.groupBy("id").agg(
            *[F.coalesce(F.max(F.when(F.col("field") == f, F.col("dl"))), F.lit(0)).alias(f"n_{f}") for f in sorted(state["fields"])],
            *[F.coalesce(of(f, t, "tf"), F.lit(0)).alias(f"f_{number[t]}_{f}") for f, t in sorted(looked)],
            *[of(f, t, "pos").alias(f"p_{number[t]}_{f}") for f, t in sorted(phrased)],
        )
        counted = grouped.select(
            "id", *[f"n_{f}" for f in sorted(state["fields"])],
            *[(F.col(f"f_{number[c.terms[0]]}_{f}") if len(c.terms) == 1 else _in_a_row([F.col(f"p_{number[t]}_{f}") for t in c.terms])).alias(f"t_{k}_{f}") for k, c, over in kept for f in over],
        )
        sums = [F.lit(n).alias(f"{name}_{f}") for f, pair in state["fields"].items() for name, n in zip(("docs", "length"), pair, strict=True)]
        return _scored(counted, kept, sums)


def _in_a_row(places: list[Column]) -> Column:
    """How often the terms of these places follow each other (overlaps count once); null places are none."""
    back = lambda p, k: F.transform(p, lambda x: x - F.lit(k))
    starts = reduce(F.array_intersect, [back(p, k) for k, p in enumerate(places)])
    step = lambda s, x: F.when(x >= s["next"], F.struct((s["n"] + 1).alias("n"), (x + len(places)).alias("next"))).otherwise(s)
    return F.coalesce(F.aggregate(F.array_sort(starts), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("next")), step)["n"], F.lit(0))


class TextIndexer:
    """Keeps a ``PostingsIndex`` up with a store of documents; ``prepare`` gives a frame of documents its text columns, and their names by field."""

    def __init__(self, index: PostingsIndex, prepare: Callable[[DataFrame], tuple[DataFrame, dict[str, str]]], documents: Callable[[DataFrame], DataFrame]) -> None:
        self.index, self.prepare, self.documents = index, prepare, documents

    def reset(self) -> None:
        self.index.reset()

    def apply(self, changes: DataFrame) -> None:
        docs, fields = self.prepare(self.documents(changes))
        self.index.apply(docs, changes.select(F.col("key").alias("id")), "id", fields)
