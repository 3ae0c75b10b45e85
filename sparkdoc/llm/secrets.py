"""Secret scans: Aho-Corasick keywords, anchored expressions at the hits, then checksums inside the token.

One automaton finds the keywords of all kinds in a pass over the whole text; an expression is tried only where
one of its keywords begins. Hexadecimal runs have no keyword: one expression goes over the text for them. All
is linear in a text: a match takes its characters, and where a token's parts fail, later keywords in the same
part, which would fail alike, are passed over. Kinds:

* ``assign``, ``access``, ``hex``: the base kinds (a name set to a value, an access key id, a hexadecimal run).
* ``forge`` (``ghp_`` and its like) and ``package`` (``npm_``): tokens whose last six characters must be the
  base-62 CRC-32 of the thirty before them.
* ``jwt``: ``eyJ...``, whose header must decode to a JSON object that names an algorithm.
* ``pem``: a private key block, whose body must decode from base 64 to a DER sequence of its own length.

Spans are code points, end exclusive, leftmost and not overlapping within a kind. A null or empty text
has no spans; rows with null or repeated ids keep one output row each; an empty table gives none.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "forge", "package", "jwt", "pem")


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join([*(_either(w) for w in ("password", "passwd", "secret", "token")), _either("api") + "_?" + _either("key")])
_ASSIGN = re.compile(rf"({_NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_FORGE = re.compile(r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
_PACKAGE = re.compile(r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
_JWT = re.compile(r"(eyJ[A-Za-z0-9_-]++)\.(eyJ[A-Za-z0-9_-]++)\.[A-Za-z0-9_-]++")
_PEM = re.compile(r"-----BEGIN ((?:[A-Z]++ )?PRIVATE KEY)-----([A-Za-z0-9+/=\s]++)-----END \1-----")
_PART = re.compile(r"[A-Za-z0-9_-]++")
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62_crc32(payload: str) -> str:
    """CRC-32 of the payload as six base-62 digits."""
    n, out = zlib.crc32(payload.encode()), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        out = _DIGITS[r] + out
    return out


def _long_enough(group: int, least: int) -> Callable[[re.Match], bool]:
    return lambda m: m.end(group) - m.start(group) >= least


def _checksum(m: re.Match) -> bool:
    token = m.group().partition("_")[2]
    return base62_crc32(token[:-6]) == token[-6:]


def _jose(m: re.Match) -> bool:
    try:
        head = json.loads(base64.urlsafe_b64decode(m.group(1) + "=" * (-len(m.group(1)) % 4)))
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str)


def _der(m: re.Match) -> bool:
    try:
        raw = base64.b64decode("".join(m.group(2).split()), validate=True)
    except (binascii.Error, ValueError):
        return False
    if len(raw) < 2 or raw[0] != 0x30:
        return False
    more = raw[1] & 0x7F if raw[1] & 0x80 else 0
    size = int.from_bytes(raw[2 : 2 + more]) if more else raw[1]
    return more <= 4 and len(raw) == 2 + more + size


#: Keyword (lower case): kind, expression, what a match must pass. A match that fails still takes its characters.
_RULES: dict[str, tuple[str, re.Pattern, Callable[[re.Match], bool]]] = {
    **{w: ("assign", _ASSIGN, _long_enough(2, 12)) for w in ("password", "passwd", "secret", "token", "apikey", "api_key")},
    "akia": ("access", _ACCESS, _long_enough(0, 18)),
    **{f"gh{c}_": ("forge", _FORGE, _checksum) for c in "pousr"},
    "npm_": ("package", _PACKAGE, _checksum),
    "eyj": ("jwt", _JWT, _jose),
    "-----begin ": ("pem", _PEM, _der),
}
_UPPER = {c: c + 32 for c in range(65, 91)}


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for word, rule in _RULES.items():
        a.add_word(word, (len(word), rule))
    a.make_automaton()
    return a


def scan(text: str | None, words: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """All spans of a text as (start, kind's rank, end)."""
    if not text:
        return []
    low = text.lower()
    if len(low) != len(text):  # a few letters change length; ASCII ones don't
        low = text.translate(_UPPER)
    found = [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    over, failed = dict.fromkeys(KINDS, 0), 0
    hits = sorted(((stop - size + 1, rule) for stop, (size, rule) in words.iter(low)), key=lambda h: h[0])
    for start, (kind, expression, valid) in hits:
        if start < over[kind] or kind == "jwt" and start < failed:
            continue
        if m := expression.match(text, start):
            over[kind] = m.end()
            if valid(m):
                found.append((start, KINDS.index(kind), m.end()))
        elif kind == "jwt" and text.startswith("eyJ", start):
            failed = _PART.match(text, start).end()  # what follows this part decides for every start in it
    found.sort()
    return found


def render(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


_OUT = T.StructType(
    [
        T.StructField("n_assign", T.LongType()),
        T.StructField("n_access", T.LongType()),
        T.StructField("n_hex", T.LongType()),
        T.StructField("base_sha256", T.StringType()),
        T.StructField("spans", T.StringType()),
    ]
)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    schema = T.StructType([source.schema["doc_id"], *_OUT.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = automaton()
        for batch in batches:
            counts: tuple[list, list, list] = ([], [], [])
            digests, spans = [], []
            for value in batch.column(1):
                found = scan(value.as_py(), words)
                for k in range(3):
                    counts[k].append(sum(f[1] == k for f in found))
                digests.append(hashlib.sha256(render([f for f in found if f[1] < 3]).encode()).hexdigest())
                spans.append(render(found))
            columns = [*(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=schema.names)

    return source.mapInArrow(run, schema)
