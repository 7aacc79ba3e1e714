"""Versions, namespaced paths, literals and labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import col

# What a semantic version and a pseudo-version look like, and how much of a label is shown.
SEMVER = r"^v(0|[1-9]\d*)\.(0|[1-9]\d*)\.(0|[1-9]\d*)(-[0-9A-Za-z.-]+)?(\+[0-9A-Za-z.-]+)?$"
PSEUDO = r"^v\d+\.\d+\.\d+-(?:\d+\.|[0-9A-Za-z.-]+\.0\.)?\d{14}-[0-9a-f]{12}(\+incompatible)?$"
LABEL = 60


def snapshot_path(repository: Column | str, revision: Column | str, path: Column | str) -> Column:
    """A path below a name that only this repository and revision have; null if any part is."""
    return F.concat(F.lit("snapshots/"), F.sha2(F.concat(col(repository), F.lit("\n"), col(revision)), 256), F.lit("/"), col(path))


def physical_path(path: Column | str) -> Column:
    """The path of a namespaced one; others as they are."""
    return F.regexp_replace(col(path), r"^snapshots/[0-9a-f]{64}/", "")


def version(v: Column | str) -> Column:
    """``major, minor, patch, pre, pseudo, incompatible`` of a semantic version; null for anything else."""
    v = col(v)
    n = lambda i: F.regexp_extract(v, SEMVER, i).cast("bigint")
    parts = F.struct(n(1).alias("major"), n(2).alias("minor"), n(3).alias("patch"), F.regexp_extract(v, SEMVER, 4).alias("pre"), v.rlike(PSEUDO).alias("pseudo"), v.endswith("+incompatible").alias("incompatible"))
    return F.when(v.rlike(SEMVER), parts)


def major_agrees(module: Column | str, v: Column | str) -> Column:
    """Whether a module's name carries the major version it must: none for 0 and 1, /vN from 2 on unless incompatible."""
    m, p = col(module), version(v)
    suffix = F.regexp_extract(m, r"/v(\d+)$", 1)
    return F.when(p["major"] < 2, suffix == "").otherwise(((suffix != "") & (suffix.cast("bigint") == p["major"])) | ((suffix == "") & p["incompatible"]))


def string_literal(source: Column | str) -> Column:
    """The value of a plain quoted literal without prefix: escapes of quote, backslash, n, r, t and 0 replaced; null for anything else."""
    s = col(source)
    inner = F.expr(f"substring({source}, 2, length({source}) - 2)") if isinstance(source, str) else F.substring(s, F.lit(2), F.length(s) - 2)
    plain = s.rlike(r"""^"(?:[^"\\\n]|\\["'\\nrt0])*"$""") | s.rlike(r"""^'(?:[^'\\\n]|\\["'\\nrt0])*'$""")
    out = F.replace(inner, F.lit("\\\\"), F.lit("\x00"))
    for mark, value in (('\\"', '"'), ("\\'", "'"), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ("\\0", "\x01")):
        out = F.replace(out, F.lit(mark), F.lit(value))
    return F.when(plain, F.replace(F.replace(out, F.lit("\x00"), F.lit("\\")), F.lit("\x01"), F.lit("\u0000")))


def grouped(n: Column | str) -> Column:
    """A whole number with its thousands parted by commas."""
    return F.format_number(col(n), 0)


def label(text: Column | str) -> Column:
    """At most ``LABEL`` characters on one line, an ellipsis for what is cut."""
    t = F.trim(F.regexp_replace(col(text), r"\s+", " "))
    return F.when(F.length(t) > LABEL, F.concat(F.substring(t, 1, LABEL - 1), F.lit("…"))).otherwise(t)
