"""Byte-accurate windows, redaction and excerpts of UTF-8 text; Arrow batches, no shuffle."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.rowmap import map_rows
from .text import SECRET

WINDOW = 8192
REDACTED = b"[redacted]"
_SECRET = re.compile(SECRET)


def floor(data: bytes, at: int) -> int:
    """The last character boundary at or before ``at``."""
    if at >= len(data):
        return len(data)
    while at > 0 and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def windows(data: bytes, size: int = WINDOW) -> list[tuple[int, int]]:
    """Half-open byte ranges of at most ``size`` bytes that never split a character; none for an empty text."""
    if size < 4:
        raise ValueError("a window must hold any character")
    out, at = [], 0
    while at < len(data):
        end = floor(data, at + size)
        out.append((at, end))
        at = end
    return out


def secret_spans(text: str) -> list[tuple[int, int]]:
    """Byte ranges of secrets."""
    out, seen, at = [], 0, 0
    for m in _SECRET.finditer(text):
        at += len(text[seen : m.start()].encode())
        end = at + len(m.group().encode())
        out.append((at, end))
        seen, at = m.end(), end
    return out


def blank(data: bytes, spans: list[tuple[int, int]], offset: int = 0) -> bytes:
    """A stretch that begins at ``offset`` with its secret ranges replaced; a range cut by its edge is replaced as far as it lies inside."""
    out, at = [], 0
    for a, b in spans:
        a, b = max(a - offset, 0), min(b - offset, len(data))
        if a < b and a >= at:
            out += [data[at:a], REDACTED]
            at = b
    return b"".join(out) + data[at:]


def excerpt(data: bytes, spans: list[tuple[int, int]], most: int) -> tuple[bytes, int]:
    """The longest prefix whose redacted form fits ``most`` bytes, redacted, and its own length; found by binary search over boundaries."""
    lo, hi = 0, len(data)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if len(blank(data[: floor(data, mid)], spans)) <= most:
            lo = mid
        else:
            hi = mid - 1
    cut = floor(data, lo)
    return blank(data[:cut], spans), cut


def byte_windows(df: DataFrame, ident: str, text: str, size: int = WINDOW) -> DataFrame:
    """``id, window, start_byte, end_byte, start_line, end_line, body, redacted`` of every window; texts with a private key give none."""

    def make():
        def row(i, t):
            data = t.encode()
            spans, out, line = secret_spans(t), [], 1
            for k, (a, b) in enumerate(windows(data, size)):
                raw = data[a:b]
                shown = blank(raw, spans, a)
                end = line + raw[:-1].count(b"\n")
                out.append((i, k, a, b, line, end, shown.decode("utf-8", "replace"), shown != raw))
                line += raw.count(b"\n")
            return out

        return row

    src = df.where(F.col(text).isNotNull() & ~F.col(text).contains("PRIVATE KEY-----")).select(F.col(ident).alias("id"), F.col(text).alias("t"))
    return map_rows(src, make, f"id {dict(src.dtypes)['id']}, window int, start_byte bigint, end_byte bigint, start_line int, end_line int, body string, redacted boolean")


def excerpts(df: DataFrame, ident: str, text: str, most: int) -> DataFrame:
    """``id, excerpt, taken_bytes, truncated``: redacted prefixes of at most ``most`` bytes."""

    def make():
        def row(i, t):
            data = t.encode()
            shown, cut = excerpt(data, secret_spans(t), most)
            return [(i, shown.decode(), cut, cut < len(data))]

        return row

    src = df.where(F.col(text).isNotNull()).select(F.col(ident).alias("id"), F.col(text).alias("t"))
    return map_rows(src, make, f"id {dict(src.dtypes)['id']}, excerpt string, taken_bytes bigint, truncated boolean")
