"""WARC archives with revisits, read back, and their index merged into capture histories.

Writing: each task writes one archive of gzip members, a record per page, into the shared folder, and
returns a capture run: index rows sorted by URL key and time. Of equal payloads of at least
``least_bytes`` bytes, the one with the largest page_id is a response and the others revisit it. Only
digests, lengths and ids are shuffled to find that out; the repeated payloads' table is broadcast if it is no
larger than ``broadcast_rows``. Beyond that only the hot ones are, with a bitmap of fixed size of the digests'
first bits: payloads that the bitmap tells apart from all repeated ones stay where they are, and the rest is shuffled.

Index: runs are exchanged by ranges of (URL key, time, id), so that a URL with very many captures spans
several ranges, and each range merges its runs with a loser tree (tournament tree): one comparison per
level and row. Rows of a run come in order; where an exchange breaks the order, a new run begins. The
result is one global order, with every capture's number in the history of its URL.

Reading: the archives are read from start to end and parsed; a revisit's payload is that of the record it
refers to, as its headers say.

Captures follow page_id; beyond about 4000 years of seconds their times stand still and the id alone orders them.
A null html is an empty payload; a null URL is written as urn:page and the id, and its key is that; a null page_id
is never referred to and its record is a response. Rows repeated with the largest page_id are responses all.
Unpaired or control characters in URLs are percent-encoded. An empty table gives no rows.
"""

from __future__ import annotations

import datetime
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkdoc.llm._spark import HOT_SHARE, Scratch, remove_path

LEAST_BYTES = 1000
#: Repeated payloads (a row of about 60 bytes each) that are broadcast.
BROADCAST_ROWS = 250_000
#: First bits of a digest that index the bitmap, of which at most 2 ** (BITS - 6) words of 64 bits (2 million) are broadcast.
BITS = 27
#: Index rows that one range should merge.
RANGE_ROWS = 100_000
_EPOCH = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: str) -> str:
    """Sort key of a URL: host labels reversed, without www and default ports, then the path; lower case, no fragment."""
    m = re.match(r"(?is)^(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)([^#]*)", url)
    if not m:
        return url.lower()
    host = m.group(1).rpartition("@")[2].lower()
    host, _, port = host.partition(":")
    labels = host.split(".")
    if labels[0].startswith("www") and labels[0][3:].isdigit() | (labels[0] == "www"):
        labels = labels[1:]
    port = "" if port in ("", "80", "443") else ":" + port
    return ",".join(reversed(labels)) + port + ")" + (m.group(2).lower() or "/")


def capture_time(page_id: int | None) -> str:
    """Time of a capture; pages have none of their own, so it follows the id, never falling, as far as years of four digits go."""
    at = _EPOCH + datetime.timedelta(seconds=min(max(page_id or 0, -(2**34)), 2**37))
    return at.replace(tzinfo=None).isoformat() + "Z"


def record_id(page_id: int | None, digest: str, row: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id} {digest} {row if page_id is None else ""}')}>"


def _line(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: quote(m.group()), value)


def encode(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, row: int = 0) -> bytes:
    """One WARC/1.1 record of an HTTP response, or of its headers alone if it revisits another."""
    uri = _line(url if url is not None else f"urn:page:{page_id}")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest, row)}", f"WARC-Date: {capture_time(page_id)}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest, 0)}", f"WARC-Refers-To-Date: {capture_time(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    if page_id is not None:
        head.append(f"X-Page: {page_id}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(record: bytes) -> bytes:
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(record) + squeeze.flush()


def members(stream: io.RawIOBase, chunk: int = 1 << 20) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, record) of every gzip member of a stream."""
    offset, rest = 0, b""
    while True:
        opened, used, parts = zlib.decompressobj(31), 0, []
        while not opened.eof:
            if not rest:
                rest = stream.read(chunk)
                if not rest:
                    if used:
                        raise ValueError("archive ends inside a record")
                    return
            parts.append(opened.decompress(rest))
            used += len(rest) - len(opened.unused_data)
            rest = opened.unused_data
        yield offset, used, b"".join(parts)
        offset += used


def decode(record: bytes) -> dict:
    """Headers and payload of a record; raises ValueError if it isn't what its headers say."""
    head, _, rest = record.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines)
    size = int(headers["Content-Length"])
    block = rest[:size]
    if first != "WARC/1.1" or len(block) != size or rest[size:] != b"\r\n\r\n":
        raise ValueError("not a WARC record")
    http, _, payload = block.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    revisit = headers["WARC-Type"] == "revisit"
    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    if not revisit:
        digest_read = hashlib.sha1(payload).hexdigest()
        if digest_read != digest or len(payload) != int(fields["Content-Length"]):
            raise ValueError("payload differs from its digest or length")
    return {"page_id": int(headers["X-Page"]) if "X-Page" in headers else None, "payload_bytes": int(fields["Content-Length"]), "payload_digest": digest, "record_type": headers["WARC-Type"], "refers_to": int(headers["X-Refers-To-Page"]) if revisit else None, "payload": payload}


class LoserTree:
    """Merge k sorted sequences: the winner is replayed against the losers on its way up, one comparison a level."""

    def __init__(self, runs: list[Iterator]) -> None:
        self.runs = runs
        self.k = k = len(runs)
        self.head: list = [next(r, None) for r in runs]
        self.lost = [-1] * k
        for i in range(k):
            self._replay(i)

    def _before(self, a: int, b: int) -> bool:
        if a == -1 or b == -1:  # while the tree fills, the empty seat wins and moves up
            return a == -1
        x, y = self.head[a], self.head[b]
        return y is None or (x is not None and (x, a) <= (y, b))

    def _replay(self, i: int) -> None:
        node = (i + self.k) // 2
        while node:
            if self._before(self.lost[node], i):
                self.lost[node], i = i, self.lost[node]
            node //= 2
        self.lost[0] = i

    def __iter__(self) -> Iterator:
        while self.k and self.head[self.lost[0]] is not None:
            i = self.lost[0]
            yield self.head[i]
            self.head[i] = next(self.runs[i], None)
            self._replay(i)


def natural_runs(keys: list) -> list[tuple[int, int]]:
    """Stretches of rising keys."""
    cuts = [0, *[i for i in range(1, len(keys)) if keys[i] < keys[i - 1]], len(keys)]
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if a < b]


_INDEX = "urlkey string, captured string, page_id long, file string, offset long, length long, digest string, record_type string"
_COLUMNS = ["urlkey", "captured", "page_id", "file", "offset", "length", "digest", "record_type"]


def _writer(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get()
        # an attempt has a file of its own: what a lost or repeated attempt wrote is in no index
        name = f"part-{at.partitionId():05d}-{at.taskAttemptId()}.warc.gz"
        system, path = fs.FileSystem.from_uri(folder)
        rows, offset, n = [], 0, 0
        with system.open_output_stream(f"{path}/{name}", compression=None) as out:
            for b in batches:
                for page_id, url, html, digest, refers_to in zip(*(b.column(k) for k in range(5)), strict=True):
                    page, address, target = page_id.as_py(), url.as_py(), refers_to.as_py()
                    payload = (html.as_py() or "").encode()
                    packed = member(encode(page, address, payload, digest.as_py(), target, at.partitionId() << 40 | n))
                    out.write(packed)
                    rows.append((url_key(address if address is not None else f"urn:page:{page}"), capture_time(page), page, name, offset, len(packed), digest.as_py(), "response" if target is None else "revisit"))
                    offset, n = offset + len(packed), n + 1
        rows.sort(key=lambda r: (r[0], r[1], r[2] is not None, r[2] or 0, r[4]))
        for i in range(0, len(rows), 10_000):
            columns = list(zip(*rows[i : i + 10_000], strict=True))
            kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=_COLUMNS)

    return run


def write(pages: DataFrame, folder: str, scratch: Scratch, least_bytes: int = LEAST_BYTES, broadcast_rows: int = BROADCAST_ROWS, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write archives into ``folder``, which must exist; the index, in sorted runs."""
    html = F.coalesce(pages[html_col].cast("string"), F.lit(""))
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    large = pages.select(pages[id_col].cast("long").alias("page_id"), F.octet_length(html).alias("size"), F.sha1(html.cast("binary")).alias("digest")).where((F.col("size") >= least_bytes) & F.col("page_id").isNotNull())
    repeated = scratch.keep(large.groupBy("digest").agg(F.max("page_id").alias("newest"), F.count("*").alias("n")).where("n > 1"), "repeated")
    joined = rows.join(F.broadcast(repeated), "digest", "left") if repeated.count() <= broadcast_rows else _routed(rows, repeated, pages.count())
    target = F.when(F.col("page_id") < F.col("newest"), F.col("newest"))
    return scratch.keep(joined.select("page_id", "url", "html", "digest", target.alias("refers_to")).mapInArrow(_writer(folder), _INDEX), "runs")


def _routed(rows: DataFrame, repeated: DataFrame, total: int) -> DataFrame:
    """``rows`` left-joined with ``repeated`` by digest; only rows whose digest's first bits are those of a repeated one that isn't hot are shuffled."""
    hot = repeated.where(F.col("n") > total * HOT_SHARE)  # at most 1 / HOT_SHARE
    rare = repeated.join(F.broadcast(hot.select("digest")), "digest", "left_anti")
    prefix = F.conv(F.substring("digest", 1, 8), 16, 10).cast("long").bitwiseAND(F.lit((1 << BITS) - 1))
    word, bit = F.shiftright(prefix, 6), F.call_function("shiftleft", F.lit(1).cast("long"), prefix.bitwiseAND(F.lit(63)).cast("int"))
    bitmap = rare.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits"))
    marked = rows.withColumn("word", word).join(F.broadcast(bitmap), "word", "left").join(F.broadcast(hot), "digest", "left")
    away = F.col("newest").isNull() & (F.coalesce(F.col("bits"), F.lit(0).cast("long")).bitwiseAND(bit) != 0)
    here = marked.where(~away).select(*rows.columns, "newest", "n")
    return here.unionByName(marked.where(away).select(*rows.columns).join(rare, "digest", "left"))


def merge_index(runs: DataFrame, scratch: Scratch, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Capture histories from sorted runs: the index in global order (pid, idx), with capture_no from 0 within each URL key."""
    order = ["urlkey", "captured", "page_id", "file", "offset"]
    total = runs.count()
    ranged = runs.repartitionByRange(max(1, -(-total // range_rows)), *order)
    schema = T.StructType([*runs.schema.fields, T.StructField("pid", T.IntegerType()), T.StructField("idx", T.LongType()), T.StructField("nth", T.LongType())])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        got = list(batches)
        if not got:
            return
        table = pa.Table.from_batches(got).combine_chunks()
        page = table.column("page_id").to_pylist()
        keys = list(zip(table.column("urlkey").to_pylist(), table.column("captured").to_pylist(), [(p is not None, p or 0) for p in page], table.column("file").to_pylist(), table.column("offset").to_pylist(), range(len(page)), strict=True))
        # runs of one task are sorted; a stretch ends where another task's rows begin or the exchange broke the order
        tree = LoserTree([iter(keys[a:b]) for a, b in natural_runs([k[:5] for k in keys])])
        place, nth, last, n = [], [], None, 0
        for k in tree:
            n = n + 1 if k[0] == last else 0
            last = k[0]
            place.append(k[5])
            nth.append(n)
        merged = table.take(pa.array(place))
        for b in merged.add_column(8, "pid", pa.array(np.full(len(nth), pid, np.int32))).add_column(9, "idx", pa.array(range(len(nth)), pa.int64())).add_column(10, "nth", pa.array(nth, pa.int64())).to_batches(10_000):
            yield b

    written = scratch.keep(ranged.mapInArrow(merge, schema), "index")
    # a URL that spans ranges goes on counting: only the first key of a range can have begun before it
    here = written.groupBy("pid").agg(F.min("urlkey").alias("first"), F.max("urlkey").alias("last"))
    tails = written.groupBy("pid", "urlkey").count().join(F.broadcast(here), "pid").where("urlkey = first or urlkey = last").select("pid", "urlkey", "count")
    before = F.sum("count").over(Window.partitionBy("urlkey").orderBy("pid")) - F.col("count")
    carried = tails.select("pid", "urlkey", before.alias("before"))  # two rows a range at most
    return written.join(F.broadcast(carried), ["pid", "urlkey"], "left").select(*_COLUMNS, "pid", "idx", (F.col("nth") + F.coalesce("before", F.lit(0))).alias("capture_no"))


_READ = "file string, offset long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read(files: DataFrame, folder: str) -> DataFrame:
    """Every record of the archives named in ``files`` (file), each read from start to end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = fs.FileSystem.from_uri(folder)
        names = [c.split(" ")[0] for c in _READ.split(", ")]
        schema = pa.schema([(n, pa.int64() if t == "long" else pa.string()) for n, t in (c.split(" ") for c in _READ.split(", "))])
        for b in batches:
            for name in b.column(0).to_pylist():
                rows = []
                with system.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for offset, _, record in members(stream):
                        rows.append({"file": name, "offset": offset, **decode(record)})
                        if len(rows) == 5000:
                            yield pa.RecordBatch.from_pylist([{k: r[k] for k in names} for r in rows], schema=schema)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist([{k: r[k] for k in names} for r in rows], schema=schema)

    return files.mapInArrow(run, _READ)


def archive(pages: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Write, merge the index, read back: page_id, payload_bytes, payload_digest, record_type, refers_to, urlkey, capture_no.

    Archives in a ``folder`` of the caller's stay there; without one they are gone when this returns.
    """
    with Scratch(pages.sparkSession) as scratch:
        target = folder or scratch.folder("warc")
        runs = write(pages, target, scratch, **options)
        history = merge_index(runs, scratch)
        names = scratch.keep(runs.groupBy("file").agg(F.max(F.col("offset") + F.col("length")).alias("bytes")), "files")
        files = names.repartition(max(1, names.count()), "file").select("file")
        # Spark takes what is read for as small as the list of files: it must not broadcast it
        found = read(files, target).hint("merge").join(history.select("file", "offset", "urlkey", "capture_no").hint("merge"), ["file", "offset"])
        out = scratch.keep(found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "capture_no"), "records")
        scratch.only(out)
        if not folder:
            remove_path(pages.sparkSession, scratch.folders.pop())
    return out
