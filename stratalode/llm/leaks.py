"""Evaluation texts leaking into training text (problem 8).

Both sides are reduced to what a reader sees: compatibility forms are folded,
letters lower-cased, everything but letters and digits dropped.  Dropping the
spaces too makes line breaks, end-of-line hyphens, emphasis marks and invisible
characters vanish alike; where words begin is kept beside the stream.

Any run of ``words`` consecutive item words contains one of the item's aligned
blocks of ``words // 2``.  These blocks are the patterns of one Aho-Corasick
automaton, which scans each document's stream once; every hit is extended to
both sides against its item, and counts if the matched stretch, cut back to word
ends on both sides, still holds ``words`` words.  Every such stretch comes out,
those of one item that overlap in the document as the longest of them.  Stream
and offsets are built in one pass, so every passage has its place in the original.

Items are a fixed evaluation set: at most ``MOST_ITEM_CHARS`` characters of item
text are taken to the driver, more raise an error.  Defined results: null or
empty texts match nothing; items shorter than ``words`` words match nothing;
items with equal texts are reported each; repeated documents are reported each.
"""

from __future__ import annotations

import html
import unicodedata
from bisect import bisect_left, bisect_right

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.rowmap import map_rows

WORDS = 12
MOST_ITEM_CHARS = 20_000_000
_KEEP = regex.compile(r"[\p{L}\p{N}]+")
_SPACE = regex.compile(r"\s+")
#: Nothing composes with an ASCII character before it, so these stretches fold by themselves.
_SEGMENT = regex.compile(r"[\x00-\x7f]?[^\x00-\x7f]+|[\x00-\x7f]")
#: A character and what may compose with it: combining marks, and the letters of a Hangul syllable.
_CLUSTER = regex.compile(r"\p{L}?[\u1100-\u11FF]+|(?s:.)\p{M}*(?:[\u1160-\u11FF]+)?")
_ENTITY = regex.compile(r"&(?:#\d+|#x[0-9a-fA-F]+|[a-zA-Z]+);")


def fold(text: str) -> str:
    return text.lower() if text.isascii() else unicodedata.normalize("NFKC", text).casefold()


def shown(text: str) -> tuple[str, list[int] | None]:
    """The text with character references replaced, and for each character its place in the original (None: unchanged)."""
    if "&" not in text or not _ENTITY.search(text):
        return text, None
    parts, at, last = [], [], 0
    for m in _ENTITY.finditer(text):
        parts.append(text[last : m.start()])
        at.extend(range(last, m.start()))
        c = html.unescape(m.group())
        parts.append(c)
        at.extend([m.start()] * len(c))
        last = m.end()
    parts.append(text[last:])
    at.extend(range(last, len(text)))
    return "".join(parts), at


def stream(text: str) -> tuple[str, list[int], list[int]]:
    """Letters and digits without a gap, and where in it words (by white space) begin and end."""
    parts, starts, ends, n = [], [], [], 0
    for word in _SPACE.split(fold(shown(text)[0])):
        w = "".join(_KEEP.findall(word))
        if w:
            starts.append(n)
            parts.append(w)
            n += len(w)
            ends.append(n)
    return "".join(parts), starts, ends


def original_offsets(text: str) -> list[int]:
    """For every character of the stream, its place in ``text`` (code points).

    Folding is done cluster by cluster (a character with the marks that may
    compose with it), so folded and original characters stay together.
    """
    seen, at = shown(text)
    if seen.isascii():
        return [at[m] if at else m for m, c in enumerate(seen) if c.isalnum()]
    out = []
    for segment in _SEGMENT.finditer(seen):
        text, start = segment.group(), segment.start()
        one: list[int] = []
        for m in _CLUSTER.finditer(text):
            place = start + m.start()
            one += [at[place] if at else place] * sum(map(len, _KEEP.findall(fold(m.group()))))
        whole = sum(map(len, _KEEP.findall(fold(text))))
        out += one if len(one) == whole else [at[start] if at else start] * whole  # a composition across clusters: the run's place
    return out


class Scanner:
    def __init__(self, items: list[tuple[int, str]], words: int = WORDS):
        import ahocorasick

        self.words = words
        self.items = [(ident, *stream(text)) for ident, text in items if text]
        block = max(1, words // 2)
        patterns: dict[str, list[tuple[int, int]]] = {}
        for k, (_, s, starts, ends) in enumerate(self.items):
            if len(starts) < words:
                continue
            for b in range(0, len(starts) - block + 1, block):
                patterns.setdefault(s[starts[b] : ends[b + block - 1]], []).append((k, starts[b]))
        self.automaton = ahocorasick.Automaton()
        for p, where in patterns.items():
            self.automaton.add_word(p, (len(p), where))
        self.any = bool(patterns)
        if self.any:
            self.automaton.make_automaton()

    def scan(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """``item_id, start, end, words`` (stream offsets) of every stretch; of those of one item that overlap, the longest."""
        if not text or not self.any:
            return []
        s, starts, ends = stream(text)
        found: dict[int, set] = {}
        for last, (length, where) in self.automaton.iter(s):
            a, b = last + 1 - length, last + 1
            for k, at in where:
                ident, t, t_starts, t_ends = self.items[k]
                lo, hi = at, at + length
                x, y = a, b
                while x > 0 and lo > 0 and s[x - 1] == t[lo - 1]:
                    x, lo = x - 1, lo - 1
                while y < len(s) and hi < len(t) and s[y] == t[hi]:
                    y, hi = y + 1, hi + 1
                first, final = bisect_left(t_starts, lo), bisect_right(t_ends, hi) - 1
                shift = x - lo
                # the stretch must begin and end at word ends in the document as well
                while first <= final and not self._at(starts, t_starts[first] + shift):
                    first += 1
                while first <= final and not self._at(ends, t_ends[final] + shift):
                    final -= 1
                n = final - first + 1
                if n >= self.words:
                    found.setdefault(ident, set()).add((t_starts[first] + shift, t_ends[final] + shift, n))
        out = []
        for ident, spans in sorted(found.items()):
            kept: list[tuple] = []
            for span in sorted(spans, key=lambda v: (-v[2], v[0])):
                if all(span[1] <= a or b <= span[0] for a, b, _ in kept):
                    kept.append(span)
            out += [(ident, *v) for v in sorted(kept)]
        return out

    @staticmethod
    def _at(array: list[int], v: int) -> bool:
        i = bisect_left(array, v)
        return i < len(array) and array[i] == v


def leaks(documents: DataFrame, items: DataFrame, ident: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """``doc_id, item_id, start_char, end_char, words``: every shared passage of every leaking pair."""
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    if size > MOST_ITEM_CHARS:
        raise ValueError(f"the evaluation set has {size} characters; at most {MOST_ITEM_CHARS} fit one automaton, scan it in parts")
    known = [(r.item_id, r.text) for r in items.select("item_id", "text").where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).collect()]
    shared = documents.sparkSession.sparkContext.broadcast(known)

    def make():
        scanner = Scanner(shared.value, words)

        def row(i, body):
            found = scanner.scan(body)
            if not found:
                return ()
            at = original_offsets(body)
            return [(i, item, at[a], at[b - 1] + 1, n) for item, a, b, n in found]

        return row

    src = documents.where(F.col(text).isNotNull()).select(F.col(ident).alias("doc_id"), F.col(text).alias("text"))
    return map_rows(src, make, "doc_id bigint, item_id int, start_char int, end_char int, words int")
