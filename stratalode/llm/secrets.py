"""Credentials embedded in source code (problem 4).

Each line is cut into lexical tokens (words of value characters, quotes,
punctuation, URL schemes, key markers) and labelled by a linear-chain
conditional random field with two labels, plain and secret, over shape features
of the token and context features of its surroundings (the name it is assigned
to, the call it is passed to, header words, URL position, comment, the line that
opened the block).  The Viterbi path decides which characters are redacted.

Only tokens that could be a literal may be secret.  ``triggers`` finds the lines
to score: those with a name that ``key_class`` calls
strong (and the line after, where such a line opens a value), a header word with
a literal, or a literal that stands out by itself.  Others are taken as plain.
A private key goes on over its base64 lines up to the end marker; it counts as
one credential, at its opening marker.

Defined results: null bodies give no rows; a repeated body gives rows for each
row; lines end at LF, a CR stays outside the redaction; a credential in pieces
counts on the line where it begins.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache
from importlib import resources

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.rowmap import map_rows
from .crf import LinearChain

MASK = "*"

_TOKEN = re.compile(
    r"(?P<pem>-----(?:BEGIN|END) [A-Z0-9 ]+-----)|(?P<scheme>[A-Za-z][A-Za-z0-9+.-]*://)|(?P<esc>\\[nrt])|"
    r"(?P<w>[\w+/](?:[\w+/~.!#%&*?^-]|\$(?!\{))*(?:={1,2}(?![\w=\"'`$<\[{(]|\s+\S))?(?<![.,])|[*x#]{4,})|(?P<p>[^\s\w])"
)
_PREFIX = re.compile(r"[A-Za-z]{2,6}(?:[_-](?:live|test|prod|pat|key))?[_-](?=[A-Za-z0-9_-]*$)(?=[A-Za-z0-9_-]{0,30}[0-9A-Z])[A-Za-z0-9_-]{12,}$")
_UUID = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$")
_PHRASE = re.compile(r"(?=.*[A-Za-z]{2})(?=.*\d)(?=.*[!#%&*?~^$@]).{6,}$")
_HOLE = re.compile(r"(?i)change[_-]?me|your[-_]|x{4,}$|\*{3,}|#{4,}$|\bexample\b|dummy|placeholder|redacted|masked|todo|fixme|^none$|^null$|^nil$|^test$|^secret$|^password$|^token$")
_SPLIT = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")

#: Fixed word lists of the key-name classes.
STRONG = frozenset("password passwd pwd passphrase secret token credential credentials pass apikey".split())
KEY_BEFORE = frozenset("api signing private access encryption master shared account secret client auth webhook service".split())
SOFT = frozenset("auth authorization header headers dsn url uri pool pem key login connect conn".split())
AGAINST = frozenset(
    "label hint field file pattern regex ref kind pub public cert certificate revision rev commit sha checksum integrity digest sum hash id uuid version fingerprint path name env var prefix length count limit type mode re skip list names suffix words".split()
)
FETCH = frozenset("getenv environ env getpass lookup compile match search test findall sub regexp require import startswith hasprefix contains".split())
COMMENT = ("#", "//", "/*", "*", "--", "<!--")

_KEY = r"passw|pwd|secret|token|api[_.-]?key|apikey|credential|passphrase|(?:signing|private|access|encryption|master|shared|account)[_.-]?key|smtp[_.-]?pass|\bpass\b|_pass\b|authorization|bearer|basic"
_LITERAL = r"[A-Za-z0-9+/=_.~!#%&*?$@^-]"
#: Superset of the names that ``key_class`` calls strong, as written in any case or camel case.
_STRONG_NAME = (
    rf"(?i:{'|'.join(sorted(STRONG - {'pass'}))}|(?:{'|'.join(sorted(KEY_BEFORE))})[^A-Za-z0-9\s]*key)|"
    r"(?<![a-z])pass(?![a-z])|P(?:ass|ASS)(?![a-z])"
)
#: A line is scored if it has a key marker, user information in a URL, a key word followed by a literal, a strong key name ...
_NAMED = re.compile(
    r"-----BEGIN |"
    r"://[^\s/@\"'`:]*:[^\s/@\"'`]+@|"
    rf"(?i:{_KEY})[^\n]*?(?:[\"'`=:]|\s)\s*[\"'`]?{_LITERAL}{{6}}|"
    rf"{_STRONG_NAME}"
)
#: ... each of which holds one of these, in small letters; or
_STEMS = ("-----begin ", "://", "pass", "pwd", "secret", "token", "key", "credential", "authorization", "bearer", "basic")
#: if it has a literal of known prefix or a long mixed literal.
_SHAPED = re.compile(
    r"(?<![A-Za-z0-9])(?=[A-Za-z0-9_-]{11})(?:[A-Z]{4}[A-Z0-9]{12,}|[A-Za-z]{2,5}[_-][A-Za-z0-9_]{16,}|eyJ[A-Za-z0-9_-]{8,})|"
    r"(?<![\w+/=.-])(?=[A-Za-z0-9+/_-]{20})(?=[A-Za-z+/]*[0-9])(?=[0-9a-z+/]*[A-Z])(?=[0-9A-Z+/]*[a-z])[A-Za-z0-9+/_-]{20,}"
)
_BLANK = re.compile(r"\s*")


def triggers(body: str) -> list[tuple[int, int]]:
    """Where something begins that may be or announce a credential, and how far it goes, in order.

    Names are looked for only in lines that hold one of their stems, which plain
    search finds faster than the patterns do.
    """
    out = [m.span() for m in _SHAPED.finditer(body)]
    low = body.lower()
    if len(low) != len(body):  # a letter that takes two characters when small: places would shift
        return sorted(out + [m.span() for m in _NAMED.finditer(body)])
    lines = set()
    for stem in _STEMS:
        at = low.find(stem)
        while at >= 0:
            lines.add(body.rfind("\n", 0, at) + 1)
            hi = body.find("\n", at)
            at = low.find(stem, hi) if hi >= 0 else -1
    for lo in lines:
        hi = body.find("\n", lo)
        hi = len(body) if hi < 0 else hi
        # what a name announces may stand on the next line that isn't blank
        end = body.find("\n", _BLANK.match(body, hi).end())
        out += [m.span() for m in _NAMED.finditer(body, lo, len(body) if end < 0 else end) if m.start() < hi]
    return sorted(out)


@lru_cache(maxsize=65536)
def words_of(name: str) -> tuple[str, ...]:
    return tuple(w.lower() for w in _SPLIT.findall(name))


@lru_cache(maxsize=65536)
def key_class(name: str) -> str:
    ws = words_of(name)
    if not ws:
        return "none"
    tail = ws[-3:]
    against = any(w in AGAINST for w in tail[-2:])
    strong = any(w in STRONG for w in ws) or any(b == "key" and a in KEY_BEFORE for a, b in zip(ws, ws[1:]))
    if strong:
        return "strong-against" if against else "strong"
    if against:
        return "against"
    if any(w in SOFT for w in ws):
        return "soft"
    return "other"


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values())


@lru_cache(maxsize=16384)
def shape(w: str) -> tuple[str, ...]:
    """Shape features of a word; the first is its class."""
    n = len(w)
    core = w.rstrip("=")
    d, lo, up = any(c.isdigit() for c in w), any(c.islower() for c in w), any(c.isupper() for c in w)
    hexa = all(c in "0123456789abcdef" for c in w.lower())
    turns = sum(a.isdigit() != b.isdigit() for a, b in zip(core, core[1:]))
    if _HOLE.search(w):
        kind = "hole"
    elif _UUID.match(w):
        kind = "uuid"
    elif hexa and d and n in (32, 40, 64):
        kind = f"hex{n}"
    elif hexa and d and n >= 8:
        kind = "hex"
    elif w.startswith("sha") and "-" in w[:8] and n > 30:
        kind = "sri"
    elif w.startswith("eyJ") and w.count(".") == 2:
        kind = "jwt"
    elif _PREFIX.match(w) and (turns >= 2 or (lo and up)) and not re.fullmatch(r"[a-z]+(?:[_-][a-z]+)*\d*", w):
        kind = "prefixed"
    elif re.fullmatch(r"A[KS]IA[A-Z0-9]{12,}", w) or d and re.fullmatch(r"[A-Z]{4}[A-Z0-9]{12,}", w):
        kind = "upperkey"
    elif re.fullmatch(r"\d[\d._]*", w):
        kind = "number"
    elif _FILE.match(w):
        kind = "path"
    elif not w.isascii() or re.fullmatch(r"[A-Za-z]+", w) and (w.islower() or w.isupper() or w[1:].islower()):
        kind = "word"
    elif re.fullmatch(r"[A-Za-z_.]+", w) or re.fullmatch(r"[a-zA-Z]+(?:[_.-][a-zA-Z]+)*(?:[_-]?\d{1,4})?", w):
        kind = "ident"
    elif "/" in w and re.fullmatch(r"[\w.\-]*(?:/[\w.\-]*)+", w) and not (d and lo and up and n >= 20 and "." not in w):
        kind = "path"
    elif _PHRASE.match(w) and re.search(r"[!#%&*?~^]", w):
        kind = "phrase"
    elif d and lo and up and n >= 16 and (turns >= 3 or entropy(core) > 3.5) and re.fullmatch(r"[A-Za-z0-9+/_-]+", core):
        kind = "random"
    elif lo and up and n >= 24 and entropy(core) > 3.9 and re.fullmatch(r"[A-Za-z0-9+/_-]+", core):
        kind = "random"
    elif d and (lo or up) and n >= 6:
        kind = "mixed"
    else:
        kind = "other"
    size = "s" if n < 6 else "m" if n < 12 else "l" if n < 20 else "x" if n < 44 else "v"
    e = entropy(w)
    return (kind, f"n={size}", f"c={'d' * d}{'l' * lo}{'u' * up}", f"e={min(5, int(e))}", "pad" if w.endswith("=") else "nopad")


#: The end of a line whose value stands on the lines after it.
_OPENS = re.compile(r"""(?:[:=]\s*(?:\w*\(|\[|\{|[|>][+-]?|[a-zA-Z]{0,2}\"{3}|'{3}|`)|=\s*\\?|^\s*[\w."'-]+:)$""")


_SHELL = re.compile(r"\s*(?:\$ )?(?:export\s+|set\s+)?[A-Z][A-Z0-9_]*=\S")
_FILE = re.compile(r"[\w.*-]+\.(?:py|js|ts|go|json|yaml|yml|toml|md|txt|db|env|pem|crt|key|sh|cfg|ini|lock|mod|proto)$")


def tokens(line: str) -> list[tuple[str, str, int, int]]:
    return [(m.lastgroup, m.group(), m.start(), m.end()) for m in _TOKEN.finditer(line)]


def features(toks: list[tuple[str, str, int, int]], line: str, opened: str = "none", config: bool = False, block: str = "", full: bool = False) -> tuple[list[list[str]], list[bool]]:
    """Features per token and which tokens may be secret; tokens that may not be have features only if ``full``.

    ``opened``: key class of a line before that opened a block value; ``block``:
    ``private`` or ``public`` inside a key block.
    """
    remark = line.lstrip().startswith(COMMENT)
    remark_end = line.find("*/") if line.lstrip().startswith("/*") and "*/" in line else len(line)
    shell = bool(_SHELL.match(line))
    out, allowed = [], []
    key, call, header, last_word, since = "none", "none", "none", "", 99
    n = len(toks)
    words = sum(x[0] == "w" for x in toks)
    has_assign = False
    piece_open = False  # a secret-shaped piece came before on this line
    for i, (kind, t, a, b) in enumerate(toks):
        before = toks[i - 1][1] if i else "^"
        after = toks[i + 1][1] if i + 1 < n else "$"
        if kind == "pem":
            private = "PRIVATE" in t
            out.append(["pem", f"pem={'private' if private else 'public'}", f"pem={'begin' if 'BEGIN' in t else 'end'}", f"pemq={'private' if private else 'public'}|{after[:2] if after in ('$', chr(34), chr(39), chr(96)) or after.startswith(chr(92)) else 'more'}"])
            allowed.append("BEGIN" in t and private)
            continue
        if kind != "w":
            out.append(["punct"])
            allowed.append(False)
            if t in "=:" :
                has_assign = True
            if kind == "scheme":
                key = "url" if key not in ("strong",) else key
            continue
        sh = shape(t)
        k = sh[0]
        comment = remark and a < remark_end
        quoted = before in "\"'`" and after in "\"'`" and before != "^" and after != "$"
        half = before in "\"'`" and before != "^"
        userinfo = before == ":" and after == "@" and i >= 3 and toks[i - 3][0] == "scheme"
        ref = before in ("$", "{", "<") or (before == "{" and i >= 2 and toks[i - 2][1] == "$") or (after == "(" and toks[i + 1][2] == b) or (before == "[" and after == "]")
        lone = words == 1
        assigned = before in ("=", ":") or (half and i >= 2 and toks[i - 2][1] in ("=", ":", "(", ",", "[", "+")) or header != "none"
        ctx = key if key != "none" else f"block-{opened}" if lone or not has_assign else "none"
        if block:
            ctx = f"in-{block}"
        flag = i >= 2 and toks[i - 1][0] == "w" and toks[i - 2][1] == "-" or before == "=" and i >= 3 and toks[i - 3][1] == "-"
        in_piece = piece_open and half
        first_piece = half and after in "\"'`" and i + 2 < n and toks[i + 2][1] in ("+", ",") and i + 3 < n and toks[i + 3][1] in "\"'`"
        piece_open = piece_open or first_piece
        # everyday words, names, paths and numbers only where a key name asks for a value
        everyday = k in ("word", "ident", "path", "number") and not userinfo and not (ctx == "strong" and (half or config or header != "none"))
        # in code an unquoted word is no literal, unless it has a credential's own shape
        literal = half or config or comment or userinfo or lone or shell or bool(block) or header != "none" or flag or k in ("prefixed", "upperkey", "jwt", "random")
        ok = len(t) >= 4 and not ref and not everyday and literal
        allowed.append(ok)
        f = []
        if ok or full:
            f = [
                "w", k, *sh[1:], f"ctx={ctx}", f"{k}|{ctx}", f"{k}|{sh[1]}|{ctx}", f"q={'q' if quoted else 'h' if half else 'n'}|{k}",
                f"as={assigned}|{ctx}|{k}", f"hdr={header}|{k}", f"call={call}|{ctx}", f"call={call}|{k}",
            ]
            if userinfo:
                f += ["userinfo", f"userinfo|{k}"]
            if ref:
                f += ["ref", f"ref|{k}"]
            if comment:
                f += ["comment", f"comment|{k}"]
            if flag:
                f += ["flag", f"flag|{ctx}|{k}"]
            if lone:
                f += ["lone", f"lone|{k}|{ctx}"]
            if config:
                f += [f"config|{k}|{ctx}"]
            if in_piece:
                f += ["piece", f"piece|{ctx}"]
            if first_piece:
                f += ["firstpiece", f"firstpiece|{ctx}|{k in ('random', 'mixed', 'prefixed', 'upperkey', 'word', 'ident', 'other')}"]
        out.append(f)
        lower = t.lower()
        if lower in ("bearer", "basic"):
            header = lower
        elif header != "none" and before not in ("bearer", "basic", "Bearer", "Basic"):
            header = "none"
        c = key_class(t)
        if words_of(t) and words_of(t)[-1] in FETCH or "getenv" in lower or "environ" in lower and after == "[":
            call = "fetch"
        elif lower.endswith(("setenv", "setdefault")):
            call = "set"
        if c in ("strong", "strong-against", "soft", "against") and k in ("word", "ident", "path", "hole", "other", "phrase", "mixed"):
            if not (key in ("strong", "strong-against") and c in ("soft", "against") and since <= 1 and not half):
                key, since = c, 0
        elif k in ("word", "ident") and after in (":", "=") and c == "other":
            key = "other"
        since += 1
        last_word = t
    return out, allowed


class Finder:
    def __init__(self, model: LinearChain | None = None):
        self.model = model or load_model()
        self.memo: dict[tuple, list] = {}

    def label(self, line: str, opened: str, config: bool, block: str) -> list[tuple[int, int]]:
        """Secret stretches of one line."""
        toks = tokens(line)
        feats, allowed = features(toks, line, opened, config, block)
        if not any(allowed):
            return []
        path = self.model.viterbi(feats, allowed)
        return [(toks[i][2], toks[i][3]) for i, y in enumerate(path) if y]

    def find(self, body: str, config: bool = False) -> list[tuple[int, int, int, int, bool]]:
        """``line_no, start, end, line_start, begins`` per secret token, offsets in code points of the body; begins: a case starts here."""
        out, done = [], -1
        for start, stop in triggers(body):
            if stop <= done:
                continue
            lo = body.rfind("\n", 0, start) + 1
            while lo >= 0 and lo <= stop:
                hi = body.find("\n", lo)
                hi = len(body) if hi < 0 else hi
                if lo >= done:
                    done = self._line(body, lo, hi, config, out)
                    if lo <= start and _OPENS.search(body[lo:hi].rstrip()):
                        stop = max(stop, min(hi + 1, len(body)))  # the value stands on the next line
                lo = hi + 1
                if hi >= stop:
                    break
        return [(body.count("\n", 0, s) + 1, s, e, ls, b) for s, e, ls, b in out]

    def _opened(self, body: str, lo: int) -> str:
        """Key class of the name whose block value the line at ``lo`` belongs to."""
        if lo <= 0:
            return "none"
        prev = body[body.rfind("\n", 0, lo - 1) + 1 : lo - 1].rstrip()
        if _OPENS.search(prev) and "def " not in prev and not prev.endswith("{"):
            names = re.findall(r"[A-Za-z_][\w.-]*", prev)
            best = "none"
            for x in names:
                c = key_class(x)
                if c.startswith("strong"):
                    return c
                if c != "other":
                    best = c
            return best
        return "none"

    def _line(self, body: str, lo: int, hi: int, config: bool, out: list) -> int:
        line = body[lo:hi].rstrip("\r")
        spans = self.label(line, self._opened(body, lo), config, "")
        last_end = None
        for s, e in spans:
            between = line[last_end:s] if last_end is not None else None
            joined = between is not None and re.fullmatch(r"[\s\"'`+,&.\\]*(?:\\n)?", between) and len(between) <= 8
            out.append((lo + s, lo + e, lo, not joined))
            last_end = e
        done = hi + 1
        for s, e in spans:
            if line[s:e].startswith("-----BEGIN"):
                end = body.find("-----END", lo + e)
                stop = body.find("\n", end) if end >= 0 else -1
                limit = (len(body) if stop < 0 else stop) if end >= 0 else hi
                self._key_block(body, lo + e, end if end >= 0 else hi, out, lo)
                done = max(done, limit + 1 if end >= 0 else done)
                break
        return done

    def _key_block(self, body: str, start: int, end: int, out: list, line_start: int) -> None:
        """Base64 of a private key up to its end marker, labelled line by line with the block as context."""
        for m in re.finditer(r"[^\n]+", body[start:end]):
            line = m.group().rstrip("\r")
            for s, e in self.label(line, "none", False, "private"):
                a = start + m.start() + s
                out.append((a, a + e - s, line_start, False))


def load_model() -> LinearChain:
    return LinearChain.load(resources.files(__package__).joinpath("secrets_model.json").read_text())


CONFIG = ("env", "properties", "toml", "yaml", "yml", "json", "ini", "cfg", "conf")


def redact(body: str, found: list[tuple[int, int, int, int, bool]]) -> str:
    """The body with each secret's characters masked one for one: lengths, quotes and line ends stay."""
    out, pos = [], 0
    for _, s, e, _, _ in sorted(found, key=lambda x: x[1]):
        if s < pos:
            continue
        out += [body[pos:s], MASK * (e - s)]
        pos = e
    return "".join(out) + body[pos:]


def _lines(found) -> list[int]:
    return sorted({line for line, *_, begins in found if begins})


def secret_lines(docs: DataFrame, ident: str = "id", path: str = "path", body: str = "body") -> DataFrame:
    """``id, line_no`` of every line on which a credential begins."""

    def make():
        finder = Finder()

        def row(i, p, text):
            return [(i, n) for n in _lines(finder.find(text, (p or "").rsplit(".", 1)[-1] in CONFIG))]

        return row

    return map_rows(docs.where(F.col(body).isNotNull()).select(ident, path, body), make, f"`{ident}` bigint, line_no int")


def redacted(docs: DataFrame, ident: str = "id", path: str = "path", body: str = "body") -> DataFrame:
    """``id, secrets, body``: every non-null body, its credentials masked and nothing else changed."""

    def make():
        finder = Finder()

        def row(i, p, text):
            found = finder.find(text, (p or "").rsplit(".", 1)[-1] in CONFIG)
            return [(i, len(_lines(found)), redact(text, found))]

        return row

    return map_rows(docs.where(F.col(body).isNotNull()).select(ident, path, body), make, f"`{ident}` bigint, secrets int, `{body}` string")
