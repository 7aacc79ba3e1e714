"""Splitting oversized items at natural boundaries (problem 6).

Sizes are UTF-8 bytes.  Token offsets are the prefix sums of token lengths;
boundaries are sorted arrays of such offsets, one per level: before top-level
declarations or headings, after blank lines, after lines, between tokens.  For
each piece the last boundary under the limit is found by binary search, the
next piece steps back by the overlap, and where no boundary fits the cut is
hard, but never inside a character.

Defined results: null bodies and bodies within the limit give no pieces; every
piece is at most ``limit`` bytes; each but the first begins with the last
``overlap`` bytes of the one before, fewer if that would split a character;
the pieces without their overlaps concatenate to the body.
"""

from __future__ import annotations

import re
from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.rowmap import map_rows

LIMIT, OVERLAP = 8192, 256

_DECLARATION = re.compile(
    rb"(?m)^(?=(?:@\w|#{1,6} |\[|async |def |class |func |type |var |const |let |function\b|export |import |interface |enum |namespace |declare |abstract |module |describe\(|package |if __name__|[A-Z_]{2,} ?=))"
)
_BLANK = re.compile(rb"(?:\r?\n[ \t]*)+\r?\n")
_LINE = re.compile(rb"\n")
_TOKEN = re.compile(rb"\s+|\w+|[\x80-\xff]+|[^\w\s\x80-\xff]+")


def token_offsets(data: bytes, lo: int, hi: int) -> list[int]:
    """Offsets at which tokens of ``data[lo:hi]`` end: prefix sums of their lengths."""
    return [m.end() for m in _TOKEN.finditer(data, lo, hi)]


def char_start(data: bytes, at: int) -> int:
    """The first offset from ``at`` on that begins a character."""
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return at


def char_floor(data: bytes, at: int) -> int:
    while at > 0 and at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def cut(data: bytes, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Byte ranges of the pieces."""
    if overlap + 4 >= limit or overlap < 0:
        raise ValueError("the overlap must leave room for at least one character")
    n = len(data)
    if n <= limit:
        return [(0, n)]
    levels = [
        [m.start() for m in _DECLARATION.finditer(data)],
        [m.end() for m in _BLANK.finditer(data)],
        [m.end() for m in _LINE.finditer(data)],
    ]
    out, start, done = [], 0, 0  # done: bytes covered so far
    while n - start > limit:
        most = start + limit
        end = 0
        # a coarser boundary is preferred if it leaves the piece at least half full
        for array, least in ((levels[0], start + limit // 2), (levels[1], start + limit // 2), (levels[2], start + overlap)):
            k = bisect_right(array, most) - 1
            if k >= 0 and array[k] > max(least, done):
                end = array[k]
                break
        if not end:
            offsets = token_offsets(data, done, most)
            k = bisect_right(offsets, most) - 1
            if k >= 0 and offsets[k] == most and most < n and len(offsets) > 1:
                k -= 1  # the last token may go on behind the limit
            end = char_floor(data, offsets[k] if k >= 0 else most)
            if end <= max(done, start + overlap):
                end = char_floor(data, most)
        out.append((start, end))
        done = end
        start = char_start(data, max(end - overlap, 0))
    out.append((start, n))
    return out


def split_oversized(df: DataFrame, ident: str = "id", body: str = "body", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """``id, piece_no, start_byte, end_byte, overlap_bytes, piece`` of every body over the limit.  Other columns are ignored."""

    def make():
        def row(i, data):
            before, out = 0, []
            for k, (a, b) in enumerate(cut(data, limit, overlap)):
                out.append((i, k, a, b, before - a if k else 0, data[a:b].decode("utf-8")))
                before = b
            return out

        return row

    over = df.where(F.octet_length(F.col(body)) > limit).select(ident, F.col(body).cast("binary").alias("data"))
    return map_rows(over, make, f"`{ident}` bigint, piece_no int, start_byte bigint, end_byte bigint, overlap_bytes int, piece string")
