"""Source files that do not parse (problem 1).

A body is cut at line ends into chunks.  Each chunk is summarised on its own as
a lexer-state map: for every state the chunk may be entered in, the state it is
left in, its token kinds and its bracket summary (unmatched closers, unmatched
openers).  Summaries form a monoid (``combine``), so a file's chunks are reduced in
any grouping, here pairwise as a tree.  A body is one value of one row, so its
chunks are in one task and no text leaves it; only verdicts are shuffled.  A file
whose start state maps to a resting state with an empty bracket summary is then
parsed statement by statement with the local grammar of its language.  Equal
statement shapes share one parse.  Python's statements are parsed by the
interpreter's own grammar, one top-level statement at a time; only where one is
refused does the whole file have the last word.

Defined results: a null body gives a null verdict; an empty body is valid
Python, JavaScript and TypeScript but not Go (a package clause is missing);
nesting beyond the parser's stack is not flagged if brackets and tokens are
sound.  Of rows repeated for a path the current one counts; rows without a path
or with another extension are left out.
"""

from __future__ import annotations

import re
import warnings

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.current import latest, stamp_ns
from ..operators.rowmap import map_rows
from . import goparse, jsparse

LANGUAGES = {"py": "python", "go": "go", "js": "javascript", "ts": "typescript"}
CHUNK_CHARS = 16_384
#: Statement shapes remembered by one Python worker.
MEMO = 100_000

_PY = re.compile(
    r"#[^\n]*|(?P<t>'''|\"\"\")|'(?:[^'\\\n]|\\(?:\r\n|[\s\S]))*'|\"(?:[^\"\\\n]|\\(?:\r\n|[\s\S]))*\"|(?P<b>[()\[\]{}])|(?P<x>['\"])"
)
_PY_TAIL = {q: re.compile(r"(?:[^\\%s]|\\[\s\S]|%s(?!%s))*(%s)?" % (q[0], q[0], q[1:], q)) for q in ("'''", '"""')}
PAIR = {"(": ")", "[": "]", "{": "}", "${": "}$", "`(": "`)"}
CLOSERS = frozenset(PAIR.values())


def lex_python(text: str, state: str = "code", first: bool = True) -> tuple[str | None, list[str]]:
    """Exit state and brackets of a chunk; states are ``code`` and the two triple quotes."""
    out, pos = [], 0
    while True:
        if state != "code":
            m = _PY_TAIL[state].match(text, pos)
            if not m[1]:
                return state, out
            pos, state = m.end(), "code"
        for m in _PY.finditer(text, pos):
            kind = m.lastgroup
            if kind == "b":
                out.append(m["b"])
            elif kind == "t":
                state, pos = m["t"], m.end()
                break
            elif kind == "x":
                return None, out
        else:
            return "code", out


_SLASH = re.compile(r"[)}]\s*/(?![/*])")

LEX = {
    "python": (lex_python, "code", ("code", "'''", '"""')),
    "go": (goparse.lex, goparse.START, goparse.ENTRY),
    "javascript": (jsparse.lex, jsparse.START, jsparse.ENTRY),
    "typescript": (jsparse.lex, jsparse.START, jsparse.ENTRY),
}


def chunks(text: str, size: int = CHUNK_CHARS) -> list[str]:
    """Pieces of at most about ``size`` characters that end after a line feed (a longer line stays whole)."""
    out, pos = [], 0
    while len(text) - pos > size:
        cut = text.rfind("\n", pos, pos + size) + 1
        if cut <= pos:
            cut = text.find("\n", pos + size) + 1
            if cut <= 0:
                break
        out.append(text[pos:cut])
        pos = cut
    out.append(text[pos:])
    return out


def brackets(kinds: list[str]) -> tuple[list[str], list[str]] | None:
    """Unmatched closers and openers; None if two brackets contradict each other."""
    closers, openers = [], []
    for k in kinds:
        if k in PAIR:
            openers.append(k)
        elif k in CLOSERS:
            if openers:
                if PAIR[openers.pop()] != k:
                    return None
            else:
                closers.append(k)
    return closers, openers


def join_brackets(a, b):
    if a is None or b is None:
        return None
    n = min(len(a[1]), len(b[0]))
    if any(PAIR[o] != c for o, c in zip(reversed(a[1][len(a[1]) - n :]), b[0][:n])):
        return None
    return a[0] + b[0][n:], a[1][: len(a[1]) - n] + b[1]


def summarise(language: str, text: str, first: bool) -> dict:
    """Entry state -> (exit state or None, token kinds, bracket summary).  The first chunk has one entry state."""
    lex, start, entry = LEX[language]
    out = {}
    for state in (start,) if first else entry:
        left, kinds = lex(text, state, first)
        out[state] = (left, kinds, brackets(kinds))
    return out


def combine(a: dict, b: dict) -> dict:
    """Associative: the summary of two adjoining stretches from theirs."""
    out = {}
    for state, (left, kinds, pairs) in a.items():
        if left is None:
            out[state] = (None, kinds, pairs)
        elif left in b:
            end, more, other = b[left]
            out[state] = (end, kinds + more, join_brackets(pairs, other))
        else:
            out[state] = ("unknown", kinds, pairs)
    return out


class Grammar:
    """Parses balanced statements; remembers the verdict per shape."""

    def __init__(self):
        self.memo: dict[int, bool] = {}

    def once(self, kinds: list[str], language: str) -> bool:
        key = xxhash.xxh3_128_intdigest(language[0] + "\x1f".join(kinds))
        known = self.memo.get(key)
        if known is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            known = goparse.declaration_parses(kinds) if language == "go" else jsparse.parses(kinds, language == "typescript")
            self.memo[key] = known
        return known

    def python(self, statement: str) -> bool:
        key = xxhash.xxh3_128_intdigest("p" + statement)
        known = self.memo.get(key)
        if known is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            known = self.memo[key] = python_parses(statement)
        return known

    def file(self, kinds: list[str], language: str) -> bool:
        if language == "go":
            parts, i = goparse.statements(kinds), 1
            if parts and parts[0] == ["package", "ID", ";"]:
                while i < len(parts) and parts[i][0] == "import":
                    i += 1
                head = [k for p in parts[:i] for k in p]
                if goparse.parses(head) and all(self.once(p, language) for p in parts[i:]):
                    return True
            return goparse.parses(kinds)
        return all(self.once(p, language) for p in jsparse.statements(kinds)) or jsparse.parses(kinds, language == "typescript")


_PY_LINE = re.compile(
    r"#[^\n]*|(?P<t>'''|\"\"\")|'(?:[^'\\\n]|\\(?:\r\n|[\s\S]))*'|\"(?:[^\"\\\n]|\\(?:\r\n|[\s\S]))*\"|(?P<o>[(\[{])|(?P<c>[)\]}])|\\\r?\n|(?P<n>\n)"
)
#: A line that begins a top-level statement: not indented, empty, a remark, or a further clause of the statement before.
_PY_TOP = re.compile(r"(?!(?:elif|else|except|finally)\b)[^\s#)\]}]")
_PY_NESTED = re.compile(r"(?i)\b(?:f|rf|fr|t|rt|tr)['\"]")


def python_statements(text: str) -> list[str]:
    """Top-level statements with their blocks; the remarks before one belong to the one before them, decorators to what they decorate."""
    cuts, depth, pos, decorated = [], 0, 0, text.startswith("@")
    while True:
        for m in _PY_LINE.finditer(text, pos):
            kind = m.lastgroup
            if kind == "n":
                at = m.end()
                if depth <= 0 and _PY_TOP.match(text, at):
                    if not decorated:
                        cuts.append(at)
                    decorated = text.startswith("@", at)
            elif kind == "o":
                depth += 1
            elif kind == "c":
                depth -= 1
            elif kind == "t":
                pos = _PY_TAIL[m["t"]].match(text, m.end()).end()
                break
        else:
            break
    bounds = [0, *cuts, len(text)]
    return [text[a:b] for a, b in zip(bounds, bounds[1:]) if a < b]


def python_parses(text: str) -> bool:
    """Whether the interpreter's grammar takes a text; raises on nesting beyond its stack."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            compile(text.encode("utf-8"), "body", "exec", dont_inherit=True, optimize=0, flags=0x400)
            return True
    except (SyntaxError, ValueError):
        return False


def verdict(language: str, summary: dict, text: str, grammar: Grammar) -> bool | None:
    """Whether a file with this summary is valid; None if its state map does not cover it."""
    left, kinds, pairs = summary[LEX[language][1]]
    if left == "unknown":
        return None
    rest = left == "code" if language == "python" else left is not None and left[0] == "code" and (language == "go" or not left[2])
    balanced = rest and pairs == ([], [])
    if language == "python":
        if not balanced and not _PY_NESTED.search(text):  # quotes inside formatted strings may hide brackets from the states
            return False
        try:
            return balanced and all(grammar.python(x) for x in python_statements(text)) or python_parses(text)
        except (RecursionError, MemoryError):
            return balanced
    if balanced and grammar.file(kinds, language):
        return True
    if language == "go" or not _SLASH.search(text):
        return False
    # the other reading of slashes after brackets
    left, kinds = jsparse.lex(text, other=True)
    return left is not None and left[0] == "code" and not left[2] and brackets(kinds) == ([], []) and grammar.file(kinds, language)


def reduced(summaries: list[dict]) -> dict:
    """All summaries combined, as a tree of neighbours."""
    while len(summaries) > 1:
        summaries = [combine(*summaries[i : i + 2]) if i + 1 < len(summaries) else summaries[i] for i in range(0, len(summaries), 2)]
    return summaries[0]


def is_valid(language: str, text: str, grammar: Grammar | None = None, size: int = CHUNK_CHARS) -> bool:
    """Cut, summarise, reduce, parse."""
    grammar = grammar or Grammar()
    total = reduced([summarise(language, p, k == 0) for k, p in enumerate(chunks(text, size))])
    got = verdict(language, total, text, grammar)
    # entered a chunk in a state outside the map (deeply nested templates): one piece
    return verdict(language, summarise(language, text, True), text, grammar) if got is None else got


def _scan():
    grammar = Grammar()
    return lambda path, stamp, ident, language, body: [(path, stamp, ident, None if body is None else is_valid(language, body, grammar))]


def parse_states(docs: DataFrame) -> DataFrame:
    """``path, language, valid`` of the current row of every path in the four languages."""
    ext = F.substring_index("path", ".", -1)
    src = docs.where(ext.isin(*LANGUAGES) & F.col("path").contains(".")).select(
        "path", stamp_ns("stamp").alias("stamp"), F.col("id").alias("ident"), F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[ext].alias("language"), "body"
    )
    folded = map_rows(src, _scan, "path string, stamp bigint, ident bigint, valid boolean")
    now = latest(folded, "path", ["stamp", "ident"], ["valid"])
    return now.select("path", F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[F.substring_index("path", ".", -1)].alias("language"), "valid")


def broken_paths(docs: DataFrame) -> DataFrame:
    return parse_states(docs).where(~F.col("valid")).select("path")


def broken_rates(docs: DataFrame, files: DataFrame) -> DataFrame:
    """Per repository and language: readable files, those that do not parse, their rate, and how many of them a recorded status calls parsed.

    Files are those listed in ``files``; of its rows the one whose sha256 equals
    the current content digest holds.  The language is that of the extension.
    """
    digest = latest(docs.select("path", stamp_ns("stamp").alias("stamp"), "content_digest"), "path", ["stamp"], ["content_digest"])
    listed = files.select("path", F.col("sha256").alias("content_digest"), "status").dropDuplicates(["path", "content_digest"])
    status = digest.join(listed, ["path", "content_digest"]).select("path", "status")
    states = parse_states(docs).where(F.col("valid").isNotNull()).join(status, "path")
    bad = (~F.col("valid")).cast("bigint")
    return states.groupBy(F.substring_index("path", "/", 1).alias("repository"), "language").agg(
        F.count("*").alias("files"),
        F.sum(bad).alias("broken"),
        (F.sum(bad) / F.count("*")).alias("rate"),
        F.sum((~F.col("valid") & (F.col("status") == "parsed")).cast("bigint")).alias("recorded_as_parsed"),
    )
