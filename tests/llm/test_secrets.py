"""Secret scans against expressions run over whole texts, and the checksums of the method's own kinds."""

from __future__ import annotations

import base64
import hashlib
import json
import random
import re
import time

from sparkdoc.llm import secrets as s

ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def brute(text: str | None) -> list[tuple[str, int, int]]:
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in re.finditer(ASSIGN, text, re.I | re.A) if len(m.group(2)) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 16]
    return sorted(found)


def texts() -> list[str | None]:
    rng = random.Random(5)
    pieces = ["password", "PassWd", "token", "api_key", "apikey", "APIKEY", "secret", " = ", ":", '"', "'", "abcdef0123456789", "AKIA", "ABCDEFGH01234567", "é", "İ", "ſecret", "toKen", " ", "\n", "x", "=", "0" * 15, "0" * 16, "t", "Zz9/+"]
    return [None, "", *("".join(rng.choices(pieces, k=rng.randrange(1, 30))) for _ in range(3000))]


def test_base_spans_match_brute_force():
    words = s.automaton()
    for t in texts():
        got = [x for x in s.scan(t, words) if x[1] < 3]
        assert got == brute(t), t
    assert sum(bool(brute(t)) for t in texts()) > 500


def test_checksummed_kinds():
    words = s.automaton()
    body = "a1B2c3D4e5F6g7H8i9J0k1L2m3N4o5"
    good = f"ghp_{body}{s.base62_crc32(body)}"
    assert s.scan(f"x {good} y", words) == [(2, 3, 42)]
    assert s.scan(f"x ghp_{body}zzzzzz y", words) == []
    assert s.scan(f"x {good}Z", words) == []
    assert s.scan(f"npm_{body}{s.base62_crc32(body)}", words)[0][1] == 4
    part = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    assert [x[1] for x in s.scan(f"{part({'alg': 'HS256'})}.{part({'sub': 1})}.abc", words)] == [5]
    assert s.scan(f"{part({'typ': 'x'})}.{part({'sub': 1})}.abc", words) == []
    der = base64.b64encode(bytes([0x30, 3, 2, 1, 0])).decode()
    pem = f"-----BEGIN PRIVATE KEY-----\n{der}\n-----END PRIVATE KEY-----"
    assert s.scan(pem, words) == [(0, 6, len(pem))]
    assert s.scan(pem.replace(der, "AAAA"), words) == []


def jwt_brute(text: str) -> list[tuple[int, int]]:
    """Every start in turn, without memory."""
    found, at = [], 0
    while at < len(text):
        m = re.compile(r"(eyJ[A-Za-z0-9_-]+)\.(eyJ[A-Za-z0-9_-]+)\.[A-Za-z0-9_-]+").match(text, at)
        if m and s._jose(m):
            found.append((m.start(), m.end()))
        at = m.end() if m else at + 1
    return found


def test_tokens_match_every_start_in_turn():
    rng, words = random.Random(8), s.automaton()
    part = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    pieces = [part({"alg": "HS256"}), part({"sub": 1}), "eyJ", "EYJ", "eyj", ".", ".", ".", "x", "-", " ", "abc", part({"alg": "none"}) + ".eyJ"]
    cases = ["".join(rng.choices(pieces, k=rng.randrange(1, 14))) for _ in range(4000)]
    for t in cases:
        assert [(a, b) for a, k, b in s.scan(t, words) if k == 5] == jwt_brute(t), t
    assert sum(bool(jwt_brute(t)) for t in cases) > 50


def test_long_adversarial_texts_take_linear_time():
    words = s.automaton()
    pieces = ["eyJ", "eyJ.", "eyJa.eyJ", "eyJa.eyJb.", "token", "token=", "password ", "-----BEGIN ", "-----BEGIN PRIVATE KEY-----A", "AKIA", "ghp_", "0123456789abcde ", "a" * 15 + "g", "-----BEGIN A"]
    for piece in pieces:
        begun = time.perf_counter()
        s.scan(piece * ((1 << 20) // len(piece)), words)
        assert time.perf_counter() - begun < 5, piece
    for text in ("token" + " " * (1 << 20), "-----BEGIN PRIVATE KEY-----" + "A" * (1 << 20), "eyJ" + "a" * (1 << 20) + ".eyJ" + "b" * (1 << 20)):
        begun = time.perf_counter()
        s.scan(text, words)
        assert time.perf_counter() - begun < 5


def test_query_columns(spark):
    rows = [(1, "token=abcdefghijklmnop", "x"), (1, "token=abcdefghijklmnop", "x"), (2, None, None), (None, "AKIA" + "A" * 14, "y"), (3, "é " * 50_000 + "f" * 16, "z")]
    got = s.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string, spans string")).collect()
    assert len(got) == 5
    by = {r.doc_id: r for r in got}
    assert by[1].base_sha256 == hashlib.sha256(b"assign:0:22").hexdigest() and by[1].spans == "assign:0:22"
    assert (by[2].n_assign, by[2].n_access, by[2].n_hex, by[2].spans) == (0, 0, 0, "")
    assert by[None].n_access == 1 and by[3].spans == "hex:100000:100016"
    assert s.scan_secrets(spark.createDataFrame([], "doc_id long, text string")).count() == 0
