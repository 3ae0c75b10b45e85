"""Names and ids."""

from __future__ import annotations

import os
import time

_CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def validate_name(name: str) -> str:
    """A table name that is safe as one step of a path."""
    if name in ("", ".", "..") or "/" in name or "\\" in name:
        raise ValueError(f"unsafe name {name!r}")
    return name


def ulid(milliseconds: int | None = None, entropy: bytes | None = None) -> str:
    """A sortable id: 48 bits of time, 80 of chance, 26 characters."""
    t = int(time.time() * 1000) if milliseconds is None else milliseconds
    n = t << 80 | int.from_bytes(entropy or os.urandom(10), "big")
    return "".join(_CROCKFORD[n >> 5 * k & 31] for k in range(25, -1, -1))
