"""Generated, minified or vendored source files (problem 2).

Three kinds of knowledge, strongest first:

1. Attribute files (``.gitattributes``) among the documents.  Their
   ``linguist-generated`` and ``linguist-vendored`` lines are parsed per
   directory; the deepest directory wins, within a file the last matching line,
   and a negated attribute declares a file hand-written.
2. Evidence in the body: the tool's mark in the head comment, the mark of another
   project, imports of another project's inner modules, accessor boilerplate,
   squeezed lines, nothing but literal data, or the same text in another
   repository (equal after the head comment, line ends and blank lines aside).  Of
   repositories with the same text the one with the earliest file holds the
   original, unless 3 says that it, too, keeps it among copies.
3. Path patterns mined from 1 and 2 over all repositories: directory names, name
   prefixes and name suffixes whose files nearly all carry evidence.  They mark
   the rest of such files in repositories that declare nothing.

Marks count only in the head of a file, before its first statement, so code that
mentions or handles such files is no case.  Of rows repeated for a path the
current one counts.  Null bodies, null paths and other extensions give no rows;
an empty body is hand-written.
"""

from __future__ import annotations

import re

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import ancestors, dirname
from ..operators.current import latest, stamp_ns
from ..operators.rowmap import map_rows
from ..operators.skew import salted_join
from ..sources.shared import cut

EXTENSIONS = ("py", "go", "js", "ts")
#: A pattern is mined if at least so many files in so many repositories carry evidence, and such a share of all files it matches.
LEAST_FILES, LEAST_REPOSITORIES, LEAST_SHARE = 4, 2, 0.6
#: Bodies shorter than this after the head are not compared between repositories.
LEAST_COPY = 200

#: Phrases by which tools mark their output, in several languages.
_MADE = re.compile(
    r"(?i)@generated\b|<auto-?generated|\bauto-?generated (?:file|code|by|from|with)|(?:file|code|module|table|class|source)s? (?:is|was|has been|were) (?:auto(?:matically)?[- ]?)?(?:generated|produced|created|written) (?:by|from|with|using)"
    r"|\bcode generated\b.*|\bgenerated (?:by|from|with|using|automatically)\b|\bproduced by\b.*\b(?:lost|overwritten)|do not (?:edit|modify)|don't edit|changes (?:here |to this file )?will be (?:lost|overwritten)"
    r"|automatisch (?:erzeugt|generiert)|nicht bearbeiten|g[ée]n[ée]r[ée] automatiquement|ne pas (?:modifier|[ée]diter)|generado autom[áa]ticamente|no (?:editar|modificar)|gerado automaticamente|n[ãa]o editar"
    r"|自动生成|自動生成|请勿(?:编辑|修改)|автоматически"
)
_NOT_MADE = re.compile(r"(?i)used to be|once generated|no longer|by hand|not generated|was once|formerly|written elsewhere|hand-?written|hand-?maintained")
_TAKEN = re.compile(r"(?i)\bvendored (?:from|copy)|\bcop(?:ied|y) (?:from|of) the \w+|\bupstream\s*:|\btaken from the \w+ project|\bimported from the \w+ project|\bthird[- ]party (?:copy|code)|\boriginally from\b")
_BANNER = re.compile(r"(?:\S*\s*)([A-Za-z][\w.-]*) v?\d+\.\d+(?:\.\d+)*\s*[|(,]\s*(?:\(c\)|MIT|BSD|Apache|ISC|MPL|GPL)", re.I)
_COPYRIGHT = re.compile(r"(?i)copyright (?:\(c\) )?(?:\d{4}(?:-\d{4})? )?(?:the )?([\w.-]+) authors")
_PY_ROOT = re.compile(r"(?m)^(?:from|import) (\w+)\.[\w.]+")
_GO_ROOT = re.compile(r'(?m)^\s*(?:import )?(?:\w+ )?"([\w.-]+)/[\w./-]+"\s*$')
_ROW = re.compile(
    r"""^\s*(?:[\[({]\s*)*(?:(?:["'][^"'\\]*["']|[\w.-]+)\s*:\s*)?(?:[\[({]\s*)*(?:(?:-?[\d.]+(?:e-?\d+)?|0x[0-9a-fA-F]+|["'`][^"'`]*["'`]|true|false|null|None|True|False|nil)[\s,\])}:+]*)+;?\s*\\?$|^[A-Za-z0-9+/=]{40,}$|^[\s\[\](){},;]*$"""
)
_OPENER = re.compile(r"^\s*(?:(?:export\s+)?(?:default\s+)?(?:const|var|let)?\s*[\w.]+\s*(?::\s*[^=]+)?\s*:?=|module\.exports\s*=|export default|package \w+|var \w+ = )\s*")
_LITERAL_LINE = re.compile(r"""^\s*(?:export\s+)?(?:const|var|let)?\s*[\w.]+\s*(?::\s*[\w<>\[\]]+\s*)?=\s*(?:[\w.]*\()?\s*["'`][^"'`\s]{200,}["'`]\)?;?\s*$""")
_ACCESSOR = re.compile(
    r"""^\s*(?:(?:get|set)[A-Z]\w*\([^)]*\)\s*(?::\s*\w+\s*)?\{.*\}|def (?:get|set|has|clear)_\w+\(self.*\):|return self\._\w+\[\d+\]|self\._\w+\[\d+\] = \w+|func \(\w+ \*?\w+\) (?:Get|Set|Has|Clear)\w+\(.*|return \w+\.X\w+|\w+\.X\w+ = \w+|X[A-Z]\w* +\S+|\w+ = property\(lambda .*|DESCRIPTOR = .*|if \w+ != nil \{|return (?:0|""|nil|false))$"""
)


def head_of(body: str) -> tuple[str, str]:
    """Comment lines before the first statement, and the rest without blank lines and trailing white space."""
    lines = [line.rstrip() for line in body.split("\n")]
    k, block = 0, ""
    while k < len(lines):
        s = lines[k].strip()
        if block:
            if block in s:
                block = ""
        elif not s or s.startswith(("#", "//", "'use strict'", '"use strict"')):
            pass
        elif s.startswith("/*"):
            if "*/" not in s:
                block = "*/"
            elif not s.endswith("*/"):
                break
        else:
            break
        k += 1
    return "\n".join(lines[:k]), "\n".join(line for line in lines[k:] if line)


def docstring(rest: str) -> str:
    """A Python module's docstring counts as head for marks."""
    m = re.match(r"[rRuU]?(\"\"\"|''')([\s\S]*?)\1", rest)
    return m[2] if m else ""


def evidence(path: str, body: str) -> tuple[str | None, str | None]:
    """What the body alone shows (generated, vendored, minified, data, or None), and the key under which copies meet."""
    repository, ext = path.split("/", 1)[0], path.rsplit(".", 1)[-1]
    head, rest = head_of(body)
    key = xxhash.xxh3_128_hexdigest(rest) if len(rest) >= LEAST_COPY else None
    marks = head + ("\n" + docstring(rest) if ext == "py" else "")
    for line in marks.split("\n"):
        if _NOT_MADE.search(line):
            continue
        if _TAKEN.search(line):
            return "vendored", key
        if _MADE.search(line):
            return "generated", key
        m = _BANNER.match(line.strip())
        if m and m[1].lower() not in (repository.lower(),):
            return "vendored", key
        m = _COPYRIGHT.search(line)
        if m and m[1].lower() != repository.lower():
            return "vendored", key
    lines = [line for line in rest.split("\n") if line]
    size = sum(map(len, lines))
    if size >= LEAST_COPY:
        code = [line for line in lines if not line.startswith("//# sourceMappingURL")]
        long = sum(len(line) for line in code if len(line) > 300)
        if ext in ("js", "ts") and long >= 0.8 * size and sum(map(str.isspace, rest)) < 0.1 * len(rest) and not _LITERAL_LINE.match(code[0]):
            return "minified", key
        data = 0
        for line in code:
            if _ROW.match(line) or _LITERAL_LINE.match(line):
                data += len(line)
            else:
                tail = _OPENER.sub("", line, count=1)
                if tail != line and (not tail or _ROW.match(tail)):
                    data += len(line)
                elif re.match(r"\s*(?:package \w+|[\w.<>\[\]{}, :]*[\[({]|(?:export\s+)?(?:const|var|let)?\s*\w+[^=]*=\s*[\w\[\].<>]*\s*[\[({])\s*$", line):
                    data += len(line)
        if data >= 0.95 * size and size >= 400:
            return "data", key
        plain = [line for line in lines if line.strip() not in ("}", "{")]
        if len(plain) >= 8 and sum(bool(_ACCESSOR.match(line)) for line in plain) >= 0.6 * len(plain):
            return "generated", key
    own = repository.replace("-", "_") if ext == "py" else repository
    roots = set((_PY_ROOT if ext == "py" else _GO_ROOT).findall(rest)) if ext in ("py", "go") else set()
    roots -= {"os", "xml", "concurrent", "importlib", "email", "urllib", "collections", "logging", "encoding", "net", "io", "go", "text", "html", "path", "crypto", "container", "math", "unicode", "runtime", "database", "github.com", "golang.org", "google.golang.org", "gopkg.in"}
    if roots and own not in roots and len(roots) == 1:
        (root,) = roots
        if f"/{root}" in path or len(re.findall(rf"(?m)^\s*(?:from|import)?\s*\"?{re.escape(root)}[./]", rest)) >= 1:
            return "vendored", key
    return None, key


# attribute files


def glob_regex(pattern: str) -> str:
    """A path regex of a pattern in an attribute file, relative to its directory."""
    anchored = "/" in pattern.rstrip("/")
    p, out, i = pattern.strip("/"), "", 0
    while i < len(p):
        if p.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif p.startswith("**", i):
            out, i = out + ".*", i + 2
        elif p[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif p[i] == "?":
            out, i = out + "[^/]", i + 1
        elif p[i] == "[" and "]" in p[i + 2 :]:
            j = p.index("]", i + 2)
            out, i = out + "[" + ("^" + p[i + 2 : j] if p[i + 1] in "!^" else p[i + 1 : j]) + "]", j + 1
        else:
            out, i = out + re.escape(p[i]), i + 1
    return ("" if anchored else "(?:.*/)?") + out + ("/.*" if pattern.endswith("/") else "")


def attribute_rules(text: str) -> list[tuple[int, str, str, bool]]:
    """``line_no, regex, kind, value`` of the generated and vendored attributes of one file."""
    out = []
    for n, line in enumerate(text.splitlines(), 1):
        parts = line.strip().split()
        if len(parts) < 2 or parts[0].startswith("#") or parts[0].startswith("[attr]"):
            continue
        for a in parts[1:]:
            m = re.fullmatch(r"([-!]?)linguist-(generated|vendored)(?:=(\w+))?", a)
            if m:
                out.append((n, glob_regex(parts[0].strip('"')), m[2], not m[1] and (m[3] or "true").lower() in ("true", "1", "set")))
    return out


def declared(path: str, rules: list[tuple[str, int, str, str, bool]]) -> str | None:
    """What a repository's attribute files say of a path: a kind, ``handwritten``, or None.

    ``rules``: directory of the attribute file, line, regex, kind, value.
    """
    said: dict[str, tuple[tuple[int, int], bool]] = {}
    for directory, line, regex, kind, value in rules:
        if directory and not path.startswith(directory + "/"):
            continue
        if re.fullmatch(regex, path[len(directory) + 1 :] if directory else path):
            rank = (directory.count("/") + 1 if directory else 0, line)
            if kind not in said or rank >= said[kind][0]:
                said[kind] = (rank, value)
    for kind, (_, value) in said.items():
        if value:
            return kind
    return "handwritten" if said else None


def path_patterns(path: str) -> list[str]:
    """Directory names, name prefix and name suffixes of a path; numbers and hashes are folded."""
    *dirs, name = path.split("/")[1:]
    out = [f"dir:{d.lower()}" for d in dict.fromkeys(dirs)]
    name = re.sub(r"\.[0-9a-f]{6,}(?=\.)", ".<hash>", name)
    stem, _, ext = name.partition(".")
    out.append(f"ext:.{ext}") if "." in ext else None
    tail = re.search(r"(?:_[a-z0-9]+|-[a-z0-9]+)$", stem)
    if tail:
        out.append(f"end:{tail.group()}.{ext}")
        two = re.search(r"_[a-z0-9]+_[a-z0-9]+$", stem)
        if two:
            out.append(f"end:{two.group()}.{ext}")
    lead = re.match(r"[A-Za-z0-9]+(?=[_-])", stem)
    if lead:
        out.append(f"start:{lead.group()}")
    return out


def _scan():
    def row(path, stamp, ident, body):
        if body is None:
            return [(path, stamp, ident, None, None, False)]
        kind, key = evidence(path, body)
        return [(path, stamp, ident, kind, key, True)]

    return row


def _rules():
    def row(path, body):
        directory = path.rsplit("/", 1)[0] if "/" in path else ""
        repository, _, inner = directory.partition("/")
        return [(repository, inner, *r) for r in attribute_rules(body)]

    return row


def _matching():
    """The rules of one directory's attribute file that match a path."""

    def row(path, directory, rules):
        inner = path.split("/", 1)[-1]
        name, depth = (inner[len(directory) + 1 :], directory.count("/") + 1) if directory else (inner, 0)
        return [(path, r["kind"], depth, r["line"], r["value"]) for r in rules if re.fullmatch(r["regex"], name)]

    return row


def _patterns():
    return lambda path, stamp, kind, key: [(path, stamp, kind, key, path_patterns(path))]


def declarations(paths: DataFrame, attributes: DataFrame) -> DataFrame:
    """``path, said``: what the attribute files of its repository say of a path, where they say something.

    A path meets the attribute files of its own directories only (one row each,
    with the rules of that file); the deepest directory, then the last line, wins.
    """
    rules = map_rows(attributes, _rules, "repository string, directory string, line int, regex string, kind string, value boolean")
    rules = cut(rules.groupBy("repository", "directory").agg(F.collect_list(F.struct("line", "regex", "kind", "value")).alias("rules")))  # the lines of one file
    inner = F.when(F.col("path").contains("/"), F.expr("substring(path, instr(path, '/') + 1)")).otherwise(F.lit(""))
    held = paths.select("path", F.substring_index("path", "/", 1).alias("repository"), inner.alias("_inner"))
    held = salted_join(held, rules.select("repository").distinct(), ["repository"], F.col("path"), "left_semi")  # repositories without attribute files stop here
    up = held.select("path", "repository", F.explode(ancestors(dirname("_inner"))).alias("directory"))
    met = salted_join(up, rules, ["repository", "directory"], F.col("path")).select("path", "directory", "rules")
    hits = map_rows(met, _matching, "path string, kind string, depth int, line int, value boolean")
    per = hits.groupBy("path", "kind").agg(F.max_by("value", F.struct("depth", "line")).alias("value"))
    said = F.coalesce(F.min(F.when(F.col("value"), F.col("kind"))), F.lit("handwritten"))
    return per.groupBy("path").agg(said.alias("said"))


def classify(docs: DataFrame) -> DataFrame:
    """``path, reason`` of every current, readable source file; reason is null for hand-written ones.

    Reasons: declared-generated, declared-vendored, generated, vendored, minified, data, copy, pattern.
    """
    named = docs.where(F.col("path").isNotNull() & F.col("path").contains("."))
    source = named.where(F.substring_index("path", ".", -1).isin(*EXTENSIONS)).select("path", stamp_ns("stamp").alias("stamp"), F.col("id").alias("ident"), "body")
    scanned = map_rows(source, _scan, "path string, stamp bigint, ident bigint, kind string, key string, readable boolean")
    now = latest(scanned, "path", ["stamp", "ident"], ["stamp", "kind", "key", "readable"]).where("readable").drop("readable")
    # evidence is gathered once; the steps below read the narrow result back
    files = cut(map_rows(now.select("path", "stamp", "kind", "key"), _patterns, "path string, stamp bigint, kind string, key string, patterns array<string>"))

    attributes = named.where(F.substring_index("path", "/", -1) == ".gitattributes").select("path", stamp_ns("stamp").alias("stamp"), "body")
    attributes = latest(attributes, "path", ["stamp"], ["body"]).where(F.col("body").isNotNull())
    files = files.join(declarations(files.select("path"), attributes), "path", "left")

    # the same text in several repositories; one row per text and repository travels
    repository = F.substring_index("path", "/", 1)
    per = files.where(F.col("key").isNotNull()).groupBy("key", repository.alias("repository")).agg(F.min(F.coalesce("stamp", F.lit(2**62))).alias("first"))
    copies = per.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("first", "repository")).alias("origin")).where("n > 1").select("key", F.col("origin.repository").alias("origin"))
    files = salted_join(files, copies, ["key"], F.col("path"), "left")
    shown = F.when(F.col("said").isin("generated", "vendored"), F.concat(F.lit("declared-"), F.col("said"))).otherwise(F.coalesce("kind", F.when(F.col("origin") != repository, F.lit("copy"))))
    files = files.select("path", "said", "patterns", shown.alias("shown"))

    each = files.select("path", repository.alias("repository"), F.explode("patterns").alias("pattern"), F.col("shown").isNotNull().alias("hit"))
    per = each.groupBy("pattern", "repository").agg(F.count("*").alias("n"), F.sum(F.col("hit").cast("bigint")).alias("k"))
    mined = per.groupBy("pattern").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.sum((F.col("k") > 0).cast("bigint")).alias("repositories"))
    mined = mined.where((F.col("k") >= LEAST_FILES) & (F.col("repositories") >= LEAST_REPOSITORIES) & (F.col("k") >= LEAST_SHARE * F.col("n"))).select("pattern")
    rest = files.where(F.col("shown").isNull() & F.col("said").isNull()).select("path", F.explode("patterns").alias("pattern"))
    marked = salted_join(rest, mined, ["pattern"], F.col("path"), "left_semi").select("path").distinct().select("path", F.lit("pattern").alias("mined"))
    out = files.join(marked, "path", "left")
    return out.select("path", F.when(F.col("said") == "handwritten", F.lit(None).cast("string")).otherwise(F.coalesce("shown", "mined")).alias("reason"))


def not_handwritten(docs: DataFrame) -> DataFrame:
    return classify(docs).where(F.col("reason").isNotNull()).select("path")
