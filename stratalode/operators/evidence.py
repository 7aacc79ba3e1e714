"""Function evidence: windows of captured definitions, their search, and excerpts by exact handle."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bytes as B
from ..functions.text import PRIVATE_KEY, words
from ..sources import postings
from ..sources.generations import Store
from .answers import Budget, bounded
from .retrieval import depth_for, exact_names, fuse, top
from .rowmap import map_rows

#: Kinds of definitions that have evidence (fixed values).
KINDS = ("function", "method", "function_value", "constructor")
SCHEMA = "symbol_id string, path string, name string, kind string, language string, status string, file_sha256 string, window int, start_byte bigint, end_byte bigint, start_line int, end_line int, raw_digest string, body_digest string, body string, redacted boolean"


def function_chunks(symbols: DataFrame, files: DataFrame, size: int = B.WINDOW) -> DataFrame:
    """Redacted windows of every callable definition, with a key that changes when anything it shows does.

    ``symbols``: id, path, name, kind, callable, start_byte, start_line, text; ``files``:
    path, language, status, sha256.  Definitions that hold a private key give none.
    Windows are cut at characters; a secret across a cut is redacted on both sides.
    """

    def make():
        def row(ident, path, name, kind, language, status, sha, at, line, text):
            data, spans, out = text.encode(), B.secret_spans(text), []
            for k, (a, b) in enumerate(B.windows(data, size)):
                raw = data[a:b]
                shown = B.blank(raw, spans, a)
                end = line + raw[:-1].count(b"\n")
                out.append((ident, path, name, kind, language, status, sha, k, at + a, at + b, line, end, hashlib.sha256(raw).hexdigest(), hashlib.sha256(shown).hexdigest(), shown.decode("utf-8", "replace"), shown != raw))
                line += raw.count(b"\n")
            return out

        return row

    ok = F.col("callable") & F.col("kind").isin(*KINDS) & F.col("text").isNotNull() & ~F.col("text").contains(PRIVATE_KEY)
    src = symbols.where(ok).join(files.select("path", "language", "status", "sha256").dropDuplicates(["path"]), "path")
    rows = map_rows(src.select("id", "path", "name", "kind", "language", "status", "sha256", "start_byte", "start_line", "text"), make, SCHEMA)
    key = F.sha2(F.concat_ws("\x1f", "path", "file_sha256", "symbol_id", F.col("start_byte").cast("string"), F.col("end_byte").cast("string"), "body_digest"), 256)
    terms = F.concat_ws(" ", words(F.concat_ws(" ", "path", "name")), words("body"))
    return rows.withColumn("chunk_key", key).withColumn("terms", terms)


def projection_counters(symbols: DataFrame, files: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: symbols, partial_symbols, excluded_private_keys, excluded_kinds, chunks, body_bytes, redacted_chunks."""
    s = symbols.join(files.select("path", "status").dropDuplicates(["path"]), "path")
    ok = F.coalesce(F.col("callable") & F.col("kind").isin(*KINDS), F.lit(False))
    n = lambda c: F.count(F.when(c, 1))
    a = s.agg(n(ok).alias("symbols"), n(ok & (F.col("status") == "partial_parse")).alias("partial_symbols"), n(ok & F.col("text").contains(PRIVATE_KEY)).alias("excluded_private_keys"), n(~ok).alias("excluded_kinds"))
    c = chunks.agg(F.count("*").alias("chunks"), F.coalesce(F.sum(F.col("end_byte") - F.col("start_byte")), F.lit(0)).alias("body_bytes"), n(F.col("redacted")).alias("redacted_chunks"))
    return a.crossJoin(c)  # one row each


def broken_chunks(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """``chunk_key, reason`` of windows that no longer agree with themselves or their file: digest, range, redaction, source."""
    j = chunks.join(files.select("path", F.col("sha256").alias("_sha"), F.col("bytes").alias("_bytes")).dropDuplicates(["path"]), "path", "left")
    reason = (
        F.when(F.col("_sha").isNull(), "missing_source").when(F.col("_sha") != F.col("file_sha256"), "stale_source").when((F.col("start_byte") >= F.col("end_byte")) | (F.col("end_byte") > F.col("_bytes")), "range_outside_source")
        .when(F.sha2(F.col("body"), 256) != F.col("body_digest"), "body_differs").when(~F.col("redacted") & (F.col("raw_digest") != F.col("body_digest")), "redaction_differs").when(F.col("body").contains(PRIVATE_KEY), "private_key")
    )
    return j.select("chunk_key", reason.alias("reason")).where("reason is not null")


def index(chunks: DataFrame, store: Store) -> int:
    """Publishes windows with their keyword index."""
    expected = store.current()
    written = store.write({"chunks": chunks, "postings": postings.postings(chunks, "chunk_key", "terms"), "totals": postings.totals(chunks, "terms")})
    if not store.publish(written, expected):
        raise RuntimeError("another writer published first")
    return expected + 1


def function_search(store: Store, query: str, limit: int = 10, vectors: DataFrame | None = None, budget: Budget | None = None) -> DataFrame:
    """Merged passages of definitions: ``path, start_byte, end_byte, score, members, text, place, stop``.

    Three ranked lists (windows of definitions of exactly the asked name, keywords,
    and ``vectors``: id, score, if given) are fused; the windows of the best are merged
    where they overlap, a passage scoring as its best window; passages come in order
    of score, path and place until a budget is used up.
    """
    n = depth_for(limit)
    chunks = store.read("chunks")
    names = exact_names(chunks, query.strip()).orderBy("path", "start_byte", "end_byte", "chunk_key").limit(n)
    listed = names.select(F.col("chunk_key").alias("id"), "path", "start_byte", "end_byte")
    exact = _numbered(listed, ["path", "start_byte", "end_byte", "id"])
    lists = [exact, top(postings.bm25(store, query), n)] + ([top(vectors, n, True)] if vectors is not None else [])
    fused = fuse(*lists, limit=n).withColumnRenamed("id", "chunk_key")
    hits = chunks.join(F.broadcast(fused), "chunk_key")  # at most n rows
    from .retrieval import islands

    spans = hits.select("path", "file_sha256", "start_byte", "end_byte", "score", "chunk_key")
    merged = islands(spans, ["path", "file_sha256"], "start_byte", "end_byte", "score", "chunk_key").withColumnsRenamed({"start": "start_byte", "end": "end_byte"})
    inside = hits.select(F.col("path").alias("_p"), F.col("start_byte").alias("_a"), F.col("end_byte").alias("_b"), "body", "symbol_id")
    m = merged.join(inside, (F.col("path") == F.col("_p")) & (F.col("_a") >= F.col("start_byte")) & (F.col("_b") <= F.col("end_byte")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_a", "body"))), lambda x: x["body"]), "")
    rows = m.groupBy("path", "start_byte", "end_byte", "score").agg(text.alias("text"), F.array_sort(F.collect_set("symbol_id")).alias("members"))
    rows = rows.withColumn("_cost", -F.col("score")).withColumn("first_member", F.element_at("members", 1))
    out = bounded(rows.orderBy("_cost", "path", "start_byte", "end_byte").limit(limit), ["_cost", "path", "start_byte", "end_byte"], budget or Budget(work=None, edges=None), ["first_member"], "text")
    return out.drop("_cost", "first_member")


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    from pyspark.sql import Window

    return rows.select("id", F.row_number().over(Window.orderBy(*order)).alias("rank"))  # a list of at most n rows


def excerpt_at(symbols: DataFrame, files: DataFrame, handle: dict, most: int = 4096) -> DataFrame:
    """The redacted source of exactly one declaration: ``text, taken_bytes, truncated``; no row if the handle doesn't hold.

    ``handle``: id, path, start_byte, end_byte, sha256.  All of it must agree with the
    declaration and with the file as it is.
    """
    for f in ("id", "path", "start_byte", "end_byte", "sha256"):
        if f not in handle:
            raise ValueError(f"a handle names its {f}")
    s = symbols.where((F.col("id") == handle["id"]) & (F.col("path") == handle["path"]) & (F.col("start_byte") == handle["start_byte"]) & (F.col("end_byte") == handle["end_byte"]))
    s = s.join(files.where(F.col("sha256") == handle["sha256"]).select("path").distinct(), "path", "left_semi")
    return B.excerpts(s.withColumn("text", F.when(~F.col("text").contains(PRIVATE_KEY), F.col("text"))), "id", "text", most).select(F.col("id"), F.col("excerpt").alias("text"), "taken_bytes", "truncated")
