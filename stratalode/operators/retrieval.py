"""Keyword, vector and hybrid retrieval, and merging of overlapping passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot, norm
from ..sources.generations import Store
from ..sources.postings import bm25

RRF_K, SHORTLIST = 60, 32


def depth_for(limit: int) -> int:
    """Candidates that each list contributes to a fusion."""
    return max(50, 5 * limit)


def shortlist_for(limit: int) -> int:
    """How many hits another model is shown."""
    return max(limit, SHORTLIST)


def cosine_scores(docs: DataFrame, query: list[float], ident: str = "id", vector: str = "vector") -> DataFrame:
    """``id, score`` against a constant vector; null and zero vectors are left out."""
    q = F.array(*[F.lit(float(x)) for x in query])
    n = sum(float(x) ** 2 for x in query) ** 0.5 or 1.0
    s = F.when(norm(vector) > 0, dot(vector, q) / (norm(vector) * F.lit(n)))
    return docs.where(F.col(vector).isNotNull()).select(F.col(ident).alias("id"), F.round(s, 6).alias("score")).where("score is not null")


def top(scores: DataFrame, k: int, larger_id_wins: bool = False) -> DataFrame:
    """``id, score, rank`` of the best ``k``: per-task heaps, then one small merge."""
    tie = F.desc("id") if larger_id_wins else F.asc("id")
    best = scores.orderBy(F.desc("score"), tie).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), tie)))  # k rows


def fuse(*lists: DataFrame, limit: int) -> DataFrame:
    """``id, score``: reciprocal rank fusion of ranked lists, best first, ties by id."""
    both = None
    for one in lists:
        r = one.select("id", (F.lit(1.0) / (F.lit(RRF_K) + F.col("rank"))).alias("s"))
        both = r if both is None else both.union(r)
    return both.groupBy("id").agg(F.round(F.sum("s"), 6).alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def hybrid(docs: DataFrame, index: Store, query: str, vector: list[float], limit: int, ident: str = "id", column: str = "vector") -> DataFrame:
    """``id, score, similarity``: the keyword list of an index and the vector list of its documents, fused."""
    n = depth_for(limit)
    cos = top(cosine_scores(docs, vector, ident, column), n, True)
    fused = fuse(top(bm25(index, query), n), cos, limit=limit)
    return fused.join(cos.select("id", F.round("score", 4).alias("similarity")), "id", "left")


def exact_names(symbols: DataFrame, name: str) -> DataFrame:
    """Rows whose full or local name is the query, in physical order."""
    hit = (F.col("name") == name) | (F.substring_index("name", ".", -1) == name)
    return symbols.where(hit).orderBy("path", "start_byte", "end_byte")


def rerank(ranked: DataFrame, scores: DataFrame, shortlist: int = SHORTLIST) -> DataFrame:
    """The first ``shortlist`` rows in the order of another score (stable), then the rest as they were.

    ``ranked``: ``id, rank``; ``scores``: ``id, score``.  A missing score sorts last within the shortlist.
    """
    j = ranked.join(scores.select("id", F.col("score").alias("second")), "id", "left")
    late = F.col("rank") > shortlist
    order = Window.orderBy(late, F.when(~late, -F.coalesce("second", F.lit(-1e300))), "rank")  # a result list: at most a few hundred rows
    return j.withColumn("position", F.row_number().over(order))


def islands(spans: DataFrame, keys: list[str], start: str, end: str, score: str, tie: str) -> DataFrame:
    """Overlapping stretches of one key merged: ``keys, start, end, score, members``.

    Touching is no overlap.  The score of an island is its best; keys are files, so a
    window holds the stretches of one file.
    """
    w = Window.partitionBy(*keys).orderBy(F.col(start), F.desc(end), F.col(tie))
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    s = spans.withColumn("_new", F.coalesce((F.col(start) >= reach).cast("int"), F.lit(1)))
    s = s.withColumn("_island", F.sum("_new").over(w))
    return s.groupBy(*keys, "_island").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.max(score).alias("score"), F.count_distinct(tie).alias("members")).drop("_island")
