"""Personal information inside free text (problem 10).

A semi-Markov conditional random field: candidate segments of bounded length (names
of at most ``MOST_WORDS`` words, numbers of one run of groups, addresses that end at
any word of their town) are scored as wholes by their shape, the directory of people, street vocabulary and surroundings, and so are
the short plain segments between two of them, by what they hold and the types
they part; other plain text scores 0.  Dynamic programming over the candidates chooses boundaries
and types jointly, so overlapping readings of the same characters compete.

Places without a candidate of any type are plain whatever the weights, so only
candidates are scored.  The directory is a small fixed table (at most
``MOST_PEOPLE`` rows, else an error); names outside it are found by shape and
context.  Defined results: null texts give no rows; empty texts nothing; repeated
documents are reported each; positions are code points of the given text.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from importlib import resources

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.rowmap import map_rows
from .crf import SemiMarkov

#: Words of a name; people of the directory.
MOST_WORDS, MOST_PEOPLE = 4, 100_000

_AT = r"(?:@|\s?[\[({]\s?at\s?[\])}]\s?)"
#: What is left of ``_AT`` without the white space it may begin or end with.
_AT_SIGN = re.compile(r"(?i)[\[({]\s?at\s?[\])}]")
_DOT = r"(?:\.|\s?[\[({]\s?dot\s?[\])}]\s?)"
_EMAIL = re.compile(rf"(?i)(?<![\w.+%-])[\w.+%-]*\w{_AT}[\w-]+(?:{_DOT}[\w-]+)+")
_GROUPS = re.compile(r"(?<![\w.,/:=#@-])(?:\+|\(|(?=[A-Za-z0-9]))(?:[A-Za-z]{1,2} ?)?\(?\d[\d().\s /-]{4,24}\d ?[A-Za-z]?(?![\w@])|(?<![\w.,/:=#@-])[A-Za-z]?\d{7,14}[A-Za-z]?(?![\w@])")
_WORD = r"[^\W\d_]+(?:['’`-][^\W\d_]+)*"
_PAIR = re.compile(rf"{_WORD}")
_SEP = re.compile(r"(?:[ \t   ​]+|[ \t]*\r?\n[ \t>*#-]{0,4}|,[ \t ]*\r?\n?[ \t]*|\.[ \t ]*\r?\n?[ \t]*)$")
PARTICLES = frozenset("de la del van von der di da dos du le al bin ibn".split())
#: Fixed vocabulary of street types, before or after the street's name.
_AFTER = r"(?:street|st|road|rd|avenue|ave|lane|ln|drive|dr|close|court|ct|way|place|pl|square|sq|boulevard|blvd|terrace|crescent|row|hill|gardens|grove|mews|parkway|pkwy|highway|hwy|alley|quay|wharf)\.?"
_BEFORE = r"(?:rue|avenue|av\.?|boulevard|bd\.?|place|chemin|all[ée]e|quai|impasse|calle|c/|plaza|paseo|avenida|carrera|camino|via|viale|piazza|corso|rua|travessa|largo)"
_GERMAN = r"[^\W\d_]*[^\W\d_-](?:straße|strasse|str\.|weg|platz|allee|gasse|ring|damm|ufer|steig|chaussee)"
_CAP = r"[^\W\d_a-zß-öø-ÿ][^\W\d_]*(?:['’-][^\W\d_]+)*"
_GAP = r"[ \t ]*(?:\r?\n)?[ \t ]*"
_CITY = rf"{_CAP}(?:[ \t ](?:on|upon|in|sur|de|del|la|am|an|der|of|le)\b)*(?:[ \t -]{_CAP})*(?:[ \t ](?:on|upon|sur|am|an)[ \t ]{_CAP})?"
_STREETS = (
    ("n-after", re.compile(rf"(?P<flat>(?i:flat|apt\.?|apartment|unit|suite|room)[ \t]\w{{1,5}},{_GAP})?(?<![\w.])(?P<no>\d{{1,5}}[A-Za-z]?),?[ \t ]{_GAP}(?:{_CAP}[ \t ]+){{1,3}}(?P<kind>(?i:{_AFTER}))(?![\w-])(?P<apt>,?{_GAP}(?i:apt\.?|apartment|unit|suite|flat|#)[ \t]?\w{{1,5}})?(?P<city>,{_GAP}{_CITY})?(?P<zip>,?[ \t ]+(?:[A-Z]{{2}}[ \t])?\d{{4,6}}(?:-\d{{4}})?|,?[ \t ]+[A-Z]{{1,2}}\d[A-Z\d]?[ \t]\d[A-Z]{{2}})?")),
    ("n-before", re.compile(rf"(?P<flat>(?!))?(?<![\w.])(?P<no>\d{{1,5}}(?:[ \t](?:bis|ter))?),?[ \t ]{_GAP}(?P<kind>(?i:{_BEFORE}))[ \t ]+(?:(?:de|du|des|la|le|del|los|las|da|das|do|dos)[ \t ]+|[ld]['’])*{_CAP}(?:[ \t ]+(?:(?:de|du|des|la|le|del)[ \t ]+)*{_CAP}){{0,3}}(?P<apt>(?!))?(?P<city>,{_GAP}\d{{4,5}}[ \t ]+{_CITY}|,{_GAP}{_CITY})?(?P<zip>(?!))?")),
    ("before-n", re.compile(rf"(?P<flat>(?!))?(?<![\w./])(?P<kind>(?i:{_BEFORE}))[ \t ]+(?:(?:de|du|des|la|le|del|los|las|da|das|do|dos|di|della)[ \t ]+|[ld]['’])*{_CAP}(?:[ \t ]+(?:(?:de|la|del)[ \t ]+)*{_CAP}){{0,3}},?[ \t ]+{_GAP}(?P<no>\d{{1,5}}[A-Za-z]?)(?P<apt>(?!))?(?P<city>,{_GAP}\d{{4,5}}[ \t ]+{_CITY}|,{_GAP}{_CITY})?(?P<zip>(?!))?")),
    ("german", re.compile(rf"(?P<flat>(?!))?(?<![\w./-])(?P<kind>(?:{_CAP}[ \t-])?(?i:{_GERMAN}))[ \t ]+{_GAP}(?P<no>\d{{1,4}}[ ]?[a-z]?\b)(?P<apt>(?!))?(?P<city>,?{_GAP}\d{{4,5}}[ \t ]+{_CITY}|,{_GAP}{_CITY})?(?P<zip>(?!))?")),
)

#: Fixed word lists that context features look at.
CALL = frozenset("phone tel telephone ring call fax mobile cell whatsapp handy móvil téléphone teléfono rufen week number reach dial text sms hotline extension".split())
ID = frozenset("id identity national ssn passport card no number nir dni nie nino insurance social tax personalausweis ausweis ticket licence license steuer".split())
THING = frozenset("build run bytes line page error commit doi port version revision issue pr row offset batch job code order invoice sku isbn release chapter figure table section step ms count from to after".split())
BEFORE_NAME = frozenset("with to by hi dear hello thanks owner author from signed reviewed reported cc contact ask mr mrs ms dr herr frau m mme sr sra assigned assignee spoke and attn for regards cheers said via von par".split())
AFTER_NAME = frozenset("since about for said wrote asked will is has was and reported confirmed from at joined on".split())
GENERIC = frozenset("team group desk board guild crew squad review guide map plan court road street layer service".split())
#: Words that often open a sentence, and days and months, which end no town's name.
SMALL = frozenset("the a an if see since unlike please call nobody we this that does it in on monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december le la el les der die das bitte nach después despues après apres appelez llame un una le decision".split())


def fold(word: str) -> str:
    w = word.lower()
    if w.isascii():
        return w
    w = w.replace("ø", "o").replace("ß", "ss").replace("æ", "ae").replace("ł", "l")
    return "".join(c for c in unicodedata.normalize("NFD", w) if not unicodedata.combining(c))


class People:
    """Given and family names, folded; families also by their parts."""

    def __init__(self, rows: list[tuple[str | None, str | None]]):
        self.given = {fold(g) for g, _ in rows if g}
        self.family = {fold(f).replace("’", "'") for _, f in rows if f}
        self.kind = _Known(self._kind).__getitem__
        self.leads, self.follows = _Known(self._leads).__getitem__, _Known(self._follows).__getitem__

    def _kind(self, word: str) -> str:
        """Given name, family name, both or neither."""
        w = fold(word).replace("’", "'")
        g, f = w in self.given, w in self.family
        return "b" if g and f else "g" if g else "f" if f else "-"

    def _leads(self, w: str) -> bool:
        """Whether a name may begin with the word."""
        return self._kind(w) != "-" or w[0].isupper() or (len(w) > 2 and w[1] in "'’" and w[2].isupper())

    def _follows(self, w: str) -> bool:
        """Whether a name may go on with the word."""
        return case_of(w) in "CUI" or self._kind(w) != "-" or w.lower() in PARTICLES


class _Known(dict):
    """Answers of a function of one word, kept."""

    def __init__(self, f, most: int = 200_000):
        self.f, self.most = f, most

    def __missing__(self, word):
        if len(self) > self.most:
            self.clear()
        v = self[word] = self.f(word)
        return v


def case_of(w: str) -> str:
    if len(w) == 1:
        return "I" if w.isupper() else "i"
    if w.isupper():
        return "U"
    if w[0].isupper() or (len(w) > 2 and w[1] in "'’" and w[2].isupper()):
        return "C"
    return "l"


@lru_cache(maxsize=8192)
def digit_shape(s: str) -> str:
    return re.sub(r"[A-Za-z]", "A", re.sub(r"\d", "0", re.sub(r"[\s ]+", " ", s)))


def _previous(text: str, at: int) -> list[str]:
    """Up to three words before a place, nearest first, on the same line or the one before."""
    return [w.lower() for w in re.findall(r"[^\W\d_]+|[^\w\s]", text[max(0, at - 40) : at])[::-1][:4]]


def _next(text: str, at: int) -> list[str]:
    return [w.lower() for w in re.findall(r"[^\W\d_]+|\d+|[^\w\s]", text[at : at + 30])[:2]]


def _contexts(text: str, a: int, b: int) -> list[str]:
    prev, nxt = _previous(text, a), _next(text, b)
    f = []
    words = [w for w in prev if w[0].isalpha()]
    near = words[0] if words else "^"
    for name, group in (("call", CALL), ("id", ID), ("thing", THING), ("before", BEFORE_NAME)):
        if near in group:
            f.append(f"near={name}")
        if any(w in group for w in words[:3]):
            f.append(f"any={name}")
    f.append(f"p={prev[0]}" if prev and not prev[0][0].isalpha() else "p=w" if prev else "p=^")
    f.append("n=" + (nxt[0] if nxt and not nxt[0][0].isalnum() else "d" if nxt and nxt[0][0].isdigit() else "after" if nxt and nxt[0] in AFTER_NAME else "w" if nxt else "$"))
    start = text.rfind("\n", 0, a) + 1
    if not text[start:a].strip(" \t>*-"):
        f.append("line-start")
    if text.startswith("#", start):
        f.append("heading")
    return f


def _emails(text: str) -> list[tuple]:
    out = []
    if "@" not in text and not _AT_SIGN.search(text):
        return out
    for m in _EMAIL.finditer(text):
        a, b = m.span()
        s = m.group()
        local, at, domain = re.split(rf"({_AT})", s, maxsplit=1, flags=re.I)[:3]
        tld = re.split(_DOT, domain, flags=re.I)[-1].lower()
        f = ["email", f"at={'@' if '@' in at else 'word'}", f"tld={'d' if any(c.isdigit() for c in tld) else 'w' if len(tld) > 1 else 's'}", f"local={'git' if local.lower() in ('git', 'hg', 'svn', 'ssh') else 'd' if local.isdigit() else 'w'}"]
        f.append(f"next={text[b : b + 1] if text[b : b + 1] in (':', '/', '(') else 'o'}{'/' if re.match(r':[\w.-]+/', text[b : b + 60]) else ''}")
        f += [f"email|{c}" for c in _contexts(text, a, b) if c.startswith(("p=", "near"))]
        if a and text[a - 1] in "/@":
            f.append("email|path")
        out.append((a, b, "email", f))
    return out


#: What every run of groups holds.
_RUN = re.compile(r"\d[\d().\s\u00a0/-]{4,24}\d")


def _numbers(text: str) -> list[tuple]:
    out = []
    if not _RUN.search(text):
        return out
    for m in _GROUPS.finditer(text):
        s = m.group().rstrip(" .(-/ \n\r\t")
        a = m.start()
        # whole run, and the run without its last groups (a run may swallow what follows it)
        cuts = [len(s)]
        for g in re.finditer(r"[  \n\r\t]+", s):
            if g.start() >= 7 and len(re.sub(r"\D", "", s[: g.start()])) >= 7:
                cuts.append(g.start())
        starts = [0]
        g = re.match(r"[A-Za-z]{1,2} (?=\d|\()|\d{1,4}[  ]\n?", s)
        if g:
            starts.append(g.end())
        for x in starts:
            for c in dict.fromkeys(cuts):
                v = s[x:c]
                digits = sum(map(str.isdigit, v))
                if not 6 <= digits <= 16 or "\n\n" in v:
                    continue
                shape = digit_shape(v)
                ctx = _contexts(text, a + x, a + c)
                extra = [f"digits={digits}", f"plus={v[0] == '+'}", f"letters={'A' if re.search('[A-Za-z]', v) else '-'}", f"whole={x == 0 and c == len(s)}", f"break={chr(10) in v}"]
                for kind in ("phone", "id_number"):
                    f = [kind, f"{kind}|{shape}", *[f"{kind}|{e}" for e in extra], *[f"{kind}|{e}" for e in ctx], *[f"{kind}|{shape}|{e}" for e in ctx if e.startswith(("near", "any"))]]
                    if re.fullmatch(r"\d{4}-\d\d-\d\d( \d\d)?", v):
                        f.append(f"{kind}|date")
                    if re.fullmatch(r"\d{1,3}(\.\d{1,3}){3}", v):
                        f.append(f"{kind}|ip")
                    out.append((a + x, a + c, kind, f))
    return out


#: What every match of a street pattern holds, looked for from its number where it has that first; the last two in small letters.
_HINTS = {
    "n-after": re.compile(rf"\d[A-Za-z]?,?[ \t\u00a0]{_GAP}(?:{_CAP}[ \t\u00a0]+){{1,3}}(?i:{_AFTER})(?![\w-])"),
    "n-before": re.compile(rf"\d(?:[ \t\u00a0](?:bis|ter))?,?[ \t\u00a0]{_GAP}(?i:{_BEFORE})[ \t\u00a0]"),
    "before-n": re.compile(rf"(?<!\w){_BEFORE}[ \t\u00a0]"),
    "german": re.compile(r"[a-zß.][ \t\u00a0\r\n]+\d"),
}
_ENDINGS = ("straße", "strasse", "str.", "weg", "platz", "allee", "gasse", "ring", "damm", "ufer", "steig", "chaussee")


def _may_hold(name: str, text: str, small: str) -> bool:
    if name == "german":
        return any(small.endswith(_ENDINGS, 0, m.start() + 1) for m in _HINTS[name].finditer(small))
    return bool(_HINTS[name].search(small if name == "before-n" else text))


def _addresses(text: str, lower: Small) -> list[tuple]:
    out = []
    small = text.lower()
    for name, rx in _STREETS:
        if not _may_hold(name, text, small):
            continue
        for m in rx.finditer(text):
            a, b = m.span()
            ends = [b]
            if m["city"]:
                ends.append(m.start("city"))
                # the name of a town may run into the next sentence: every word of it is a possible end
                ends += [m.start("city") + w.end() for w in re.finditer(r"[^\W\d_]{2,}(?:['’-][^\W\d_]+)*", m["city"])]
            for start in {a, m.start("no")} if m["flat"] else {a}:
                for end in dict.fromkeys(ends):
                    city = text[m.start("city") : end] if m["city"] and end > m.start("city") else ""
                    names = re.findall(r"[^\W\d_]+(?:['’-][^\W\d_]+)*", city)
                    last = names[-1] if names else ""
                    zipped = bool(m["zip"]) and end == b
                    f = ["address", f"street={name}", f"city={min(4, len(names))}", f"address|zip={zipped}|{bool(m['zip'])}", f"address|flat={bool(m['flat'])}|{start == a}", f"kind={fold(m['kind'])[-6:] if name != 'german' else 'german'}"]
                    f += [f"address|{c}" for c in _contexts(text, start, end)]
                    nxt = text[end : end + 24]
                    f += [f"address|last={'' if not last else 'low' if last.lower() in lower or last.lower() in SMALL else 'cap' if last[0].isupper() else 'small'}", f"address|full={end == b}"]
                    follow = re.match(r"[  \n]+([^\W\d_]+)", nxt)
                    word = follow[1] if follow else ""
                    f.append(f"address|follow={'-' if not word else 'on' if word.lower() in ('on', 'upon', 'sur', 'am') else 'low' if word.islower() or word.lower() in lower or word.lower() in SMALL else 'cap'}|{bool(names)}")
                    out.append((start, end, "address", f))
    return out


def _names(text: str, people: People, lower: Small) -> list[tuple]:
    out = []
    words_of = _PAIR.findall(text)
    leads, follows = people.leads, people.follows
    places = [i for i, (w, v) in enumerate(zip(words_of, words_of[1:])) if leads(w) and follows(v)]
    if not places:
        return out
    toks = [(m.group(), m.start(), m.end()) for m in _PAIR.finditer(text)]
    n, kind = len(toks), people.kind
    for i in places:
        w, a, e = toks[i]
        k0 = kind(w)
        if len(w) == 1 or (a and text[a - 1] in "_@/\\`.<&$" and text[a - 1 : a] != "<") or text[a - 1 : a].isdigit():
            continue
        commas = 0
        cases, seps, members = case_of(w), "", [k0]
        words = [w]
        for j in range(i + 1, min(n, i + MOST_WORDS)):
            gap = text[toks[j - 1][2] : toks[j][1]]
            if not gap or len(gap) > 6 or not _SEP.match(gap):
                break
            v, _, end = toks[j]
            cv, kv = case_of(v), kind(v)
            initial = len(v) == 1 and cv == "I"
            if "," in gap:
                commas += 1
                if commas > 1 or j != i + 1:
                    break
            if "." in gap and len(words[-1]) != 1:
                break
            if not (cv in "CU" or kv != "-" or initial or v.lower() in PARTICLES):
                break
            seps += "," if "," in gap else "n" if "\n" in gap else "." if "." in gap else "b" if " " in gap else "s"
            cases += cv
            members.append(kv if not initial else "i")
            words.append(v)
            if initial or v.lower() in PARTICLES:
                continue
            if text[end : end + 1] in ("_", "@", "\\") or text[end : end + 2] in ("()",):
                break
            if commas and j > i + 1:
                break
            full = [m for m in members if m != "i"]
            gaz = full[0] + full[-1]
            shape = f"{cases}|{','.join(seps) if commas else ''}"
            known = sum(m != "-" for m in full)
            low = sum(x.lower() in lower for x, m in zip(words, members) if m == "-" and len(x) > 1)
            ctx = _contexts(text, a, end)
            loud = cases.strip("I") and set(cases.replace("I", "")) == {"U"} and (i > 0 and case_of(toks[i - 1][0]) == "U" and a - toks[i - 1][2] < 3) + (j + 1 < n and case_of(toks[j + 1][0]) == "U" and toks[j + 1][1] - end < 3)
            mid = "mid" if a > 1 and text[a - 1] in "  " and text[a - 2 : a - 1] not in (".", "!", "?", ":", "\n", "#", "-") else "first"
            f = ["name", f"gaz={gaz}|{'c' if commas else ''}", f"cases={shape}", f"known={known}/{len(full)}", f"low={low}", f"low={low}|{gaz}", f"n={len(full)}", f"mid={mid}|{known}", f"initial={'i' in members}|{gaz}", f"nl={'n' in seps}", f"loud={int(loud)}", f"loud={int(loud)}|{known}"]
            last = text[end : end + 1] in ("", "\n", "\r")
            generic = any(x.lower() in GENERIC for x in words)
            f += [f"name|line-end={last}|{known}", f"name|label={'near=before' in ctx and 'p=:' in ctx}|{low}|{known}|{generic}", f"name|generic={generic}"]
            f += [f"name|{x}" for x in ctx] + [f"name|{x}|{known}" for x in ctx if x.startswith(("near", "n=", "heading"))]
            f.append(f"name|{mid}|{low}|{known}|{'near=before' in ctx}|{'n=after' in ctx or 'n=<' in ctx}|{'c' if commas else ''}")
            out.append((a, end, "name", f))
    return out


_LOWER = re.compile(r"(?<![^\W_])[a-zà-öø-ÿ][^\W\d_]*")


class Small:
    """The words that a text also writes small; looked for only if something asks."""

    def __init__(self, text: str):
        self.text, self.words = text, None

    def __contains__(self, word: str) -> bool:
        if self.words is None:
            self.words = set(_LOWER.findall(self.text))
        return word in self.words


def candidates(text: str, people: People) -> list[tuple]:
    lower = Small(text)
    return [*_emails(text), *_numbers(text), *_addresses(text, lower), *_names(text, people, lower)]


class Finder:
    def __init__(self, people: People, model: SemiMarkov | None = None):
        self.people, self.model = people, model or load_model()

    def find(self, text: str) -> list[tuple[int, int, str]]:
        """``start, end, kind`` of the items of a text, in order."""
        return [(a, b, k) for a, b, k, _ in self.model.decode(candidates(text, self.people), text)]


def load_model() -> SemiMarkov:
    return SemiMarkov.load(resources.files(__package__).joinpath("pii_model.json").read_text())


def replace(text: str, found: list[tuple[int, int, str]]) -> str:
    out, pos = [], 0
    for a, b, kind in found:
        out += [text[pos:a], f"[{kind.upper()}]"]
        pos = b
    return "".join(out) + text[pos:]


def _people(contributors: DataFrame) -> list[tuple[str | None, str | None]]:
    n = contributors.count()
    if n > MOST_PEOPLE:
        raise ValueError(f"the directory has {n} rows; at most {MOST_PEOPLE} are sent to every task")
    return [(r.given_name, r.family_name) for r in contributors.select("given_name", "family_name").collect()]


def items(documents: DataFrame, contributors: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, start_char, end_char, kind``."""
    shared = documents.sparkSession.sparkContext.broadcast(_people(contributors))

    def make():
        finder = Finder(People(shared.value))
        return lambda i, t: [(i, a, b, k) for a, b, k in finder.find(t)]

    src = documents.where(F.col(text).isNotNull()).select(F.col(ident).alias("doc_id"), F.col(text).alias("text"))
    return map_rows(src, make, "doc_id bigint, start_char int, end_char int, kind string")


def anonymised(documents: DataFrame, contributors: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, items, text`` with typed placeholders, of every non-null text."""
    shared = documents.sparkSession.sparkContext.broadcast(_people(contributors))

    def make():
        finder = Finder(People(shared.value))

        def row(i, t):
            found = finder.find(t)
            return [(i, len(found), replace(t, found))]

        return row

    src = documents.where(F.col(text).isNotNull()).select(F.col(ident).alias("doc_id"), F.col(text).alias("text"))
    return map_rows(src, make, "doc_id bigint, items int, text string")
