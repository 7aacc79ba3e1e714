"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import PROSE_EXTENSIONS, col, extension

# Words a query drops, and the patterns of secrets, licence lines and declarations.
STOPWORDS = tuple("a an the and or of to in on for with by from is are was were be been which that this these those how where what when why will can as it its us our".split())
SECRET = r"(?:gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9_-]{20,}|AKIA[A-Z0-9]{16})"
BOILERPLATE = r"(?i)copyright|spdx|licensed under|permission is hereby"
DECLARATION = r"""^(?://|#|/\*|\*|\"\"\"|'''|func |def |class |pub |fn |export |interface |type |resource |data )"""
PRIVATE_KEY = "PRIVATE KEY-----"
LINE_CHARS, SYNOPSIS_CHARS, MOST_TERMS = 180, 1400, 32


#: Where an identifier is split, and what parts words.
HUMP, BETWEEN = r"(?<=[a-z0-9])(?=[A-Z])", r"[^\p{L}\p{N}]+"


def words(text: Column | str) -> Column:
    """Identifiers split at case changes and underscores; runs of anything but letters, digits and ``_`` become one space."""
    t = F.regexp_replace(col(text), "([a-z0-9])([A-Z])", "$1 $2")
    return F.translate(F.regexp_replace(t, r"[^\p{L}\p{N}_]+", " "), "_", " ")


def terms(text: Column | str) -> Column:
    """Lower-case terms of a text, empty ones dropped."""
    return F.filter(F.split(F.lower(words(text)), " "), lambda t: t != "")


def query_terms(query: str) -> list[str]:
    """Terms of a query, split where ``terms`` splits: stop words dropped, the first 32 kept, each once."""
    import regex

    split = [t.lower() for part in regex.split(BETWEEN, query) for t in regex.split(HUMP, part) if t]
    return list(dict.fromkeys([t for t in split if t not in STOPWORDS][:MOST_TERMS]))


def redact(text: Column | str) -> Column:
    return F.regexp_replace(col(text), SECRET, "[redacted]")


def synopsis(path: Column | str, body: Column | str) -> Column:
    """Title and the first declaration or prose lines of a file, each with its line number.

    Stays in one row and one stage: lines are an array, and the running length is
    folded over it, so no text is shuffled.  The line that reaches the limit is kept.
    A file with a private key has the empty synopsis, a null body a null one.
    """
    p, b = col(path), col(body)
    lines = F.split(F.regexp_replace(b, r"\r\n?", "\n"), "\n")
    numbered = F.transform(lines, lambda x, i: F.struct((i + 1).alias("n"), F.trim(F.translate(x, "\t\f\x0b", "   ")).alias("s")))
    prose = extension(p).isin(*PROSE_EXTENSIONS)
    kept = F.filter(numbered, lambda x: (x["s"] != "") & ~x["s"].rlike(BOILERPLATE) & (prose | x["s"].rlike(DECLARATION)))
    shown = F.transform(kept, lambda x: F.concat(F.lit("L"), x["n"].cast("string"), F.lit(": "), redact(F.substring(x["s"], 1, LINE_CHARS))))
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("n"))
    cut = F.aggregate(
        shown,
        start,
        lambda acc, x: F.when(acc["n"] >= SYNOPSIS_CHARS, acc).otherwise(F.struct(F.concat(acc["text"], F.lit("\n"), x).alias("text"), (acc["n"] + F.length(x)).alias("n"))),
        lambda acc: acc["text"],
    )
    title = words(p)
    return F.when(b.contains(PRIVATE_KEY), F.lit("")).otherwise(F.concat(title, F.when(cut == "", F.lit("\n")).otherwise(cut)))


# What a spreadsheet reads as a formula, and what a flowchart label may hold.
FORMULA, NOT_LABEL = r"^[\s]*[=+\-@]", r"[^A-Za-z0-9_./ -]"


def csv_guard(value: Column | str) -> Column:
    """A cell that a spreadsheet would read as a formula gets a leading quote."""
    v = col(value)
    return F.when(v.rlike(FORMULA), F.concat(F.lit("'"), v)).otherwise(v)


def mermaid_label(value: Column | str) -> Column:
    return F.substring(F.regexp_replace(col(value), NOT_LABEL, "_"), 1, 60)


def clipped(value: Column | str, n: int = 256) -> tuple[Column, Column]:
    """The first ``n`` characters and whether any were cut."""
    v = col(value)
    return F.substring(v, 1, n), F.length(v) > n


def local_name(name: Column | str) -> Column:
    return F.substring_index(col(name), ".", -1)


def end_line(start_line: Column, text: Column) -> Column:
    """Last line of a half-open stretch; its trailing line feed belongs to its own line."""
    inner = F.when(text == "", text).otherwise(F.substring(text, F.lit(1), F.length(text) - 1))
    return start_line + F.length(inner) - F.length(F.replace(inner, F.lit("\n"), F.lit("")))
