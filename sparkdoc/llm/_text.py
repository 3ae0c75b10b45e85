"""Vectorised byte kernels: words, XXH64 of many slices at once, hashed word features."""

from __future__ import annotations

import numpy as np
import xxhash

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: ASCII white space: space and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of words made of digits, lower-case ASCII letters and every character beyond ASCII.
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True

_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def xxh64(data: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of the slices ``data[start : start + length]``, as uint64."""
    buf = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(buf) - 7,), "<u8", buf, strides=(1,))
    four = np.ndarray((len(buf) - 3,), "<u4", buf, strides=(1,))
    h = length.astype(np.uint64) + np.uint64((seed + int(_P5)) % 2**64)
    for i in range(3):
        m = np.flatnonzero(length >= 8 * (i + 1))
        if not len(m):
            break
        lane = _rotl(eight[start[m] + 8 * i] * _P2, 31) * _P1
        h[m] = _rotl(h[m] ^ lane, 27) * _P1 + _P4
    m = np.flatnonzero(length & 4)
    h[m] = _rotl(h[m] ^ (four[start[m] + (length[m] & ~7)].astype(np.uint64) * _P1), 23) * _P2 + _P3
    for i in range(3):
        m = np.flatnonzero((length & 3) > i)
        h[m] = _rotl(h[m] ^ (buf[start[m] + (length[m] & ~3) + i].astype(np.uint64) * _P5), 11) * _P1
    h ^= h >> np.uint64(33)
    h *= _P2
    h ^= h >> np.uint64(29)
    h *= _P3
    h ^= h >> np.uint64(32)
    for k in np.flatnonzero(length >= 32):
        h[k] = xxhash.xxh64_intdigest(data[start[k] : start[k] + length[k]].tobytes(), seed=seed)
    return h


def words(data: np.ndarray, off: np.ndarray, member: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, starts and ends of all words, and the words before each text (one more than texts)."""
    low = LOWER[data]
    if not len(low):
        return low, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = np.zeros(len(low) + 1, bool)
    inside[:-1] = member[low]
    before = np.zeros(len(low) + 1, bool)
    before[1:] = inside[:-1]
    before[off] = False  # a text's first byte has nothing before it
    starts = np.flatnonzero(inside & ~before)
    last = np.zeros(len(low) + 1, bool)
    last[:-1] = inside[1:]
    last[off[off > 0] - 1] = False
    ends = np.flatnonzero(inside & ~last) + 1
    return low, starts, ends, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, off: np.ndarray, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """XXH64 of every word and of the longer words' first ``prefixes`` bytes, the text of each, and the words in each text."""
    low, s, e, first = words(data, off)
    n, doc = e - s, np.repeat(np.arange(len(off) - 1), np.diff(first))
    found, of = [xxh64(low, s, n)], [doc]
    for k in prefixes:
        m = np.flatnonzero(n > k)
        found.append(xxh64(low, s[m], np.full(len(m), k), seed=1000 + k))
        of.append(doc[m])
    return np.concatenate(found), np.concatenate(of), np.diff(first)


def word_counts(data: np.ndarray, off: np.ndarray, vocabulary: np.ndarray, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sparse counts of the words and prefixes whose hashes are in the sorted vocabulary: text, column, count; and words a text."""
    h, doc, total = word_hashes(data, off, prefixes)
    if not len(vocabulary) or not len(h):
        none = np.zeros(0, np.int64)
        return none, none, none, total
    maybe = np.zeros(1 << 16, bool)
    maybe[(vocabulary & np.uint64(0xFFFF)).astype(np.int64)] = True
    hit = np.flatnonzero(maybe[(h & np.uint64(0xFFFF)).astype(np.int64)])
    at = np.minimum(np.searchsorted(vocabulary, h[hit]), len(vocabulary) - 1)
    known = vocabulary[at] == h[hit]
    key, n = np.unique(doc[hit[known]] * len(vocabulary) + at[known], return_counts=True)
    return key // len(vocabulary), key % len(vocabulary), n, total


def distinct_words(data: np.ndarray, off: np.ndarray, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words and prefixes of each text: text numbers and hashes."""
    h, doc, _ = word_hashes(data, off, prefixes)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], h[new]


def as_bytes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a list of texts; None is empty."""
    raw = [(t or "").encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    return np.frombuffer(b"".join(raw), np.uint8), off
