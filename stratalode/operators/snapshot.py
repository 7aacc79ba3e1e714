"""Differences between snapshots, dependency invalidation and lifecycle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changes(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """``key, status``: A added, D deleted, M modified; rows that are equal are left out."""
    a = old.select(key, F.col(digest).alias("_a"), F.lit(True).alias("_old"))
    b = new.select(key, F.col(digest).alias("_b"), F.lit(True).alias("_new"))
    j = a.join(b, key, "full_outer")
    status = F.when(F.col("_old").isNull(), "A").when(F.col("_new").isNull(), "D").when(~F.col("_a").eqNullSafe(F.col("_b")), "M")
    return j.select(key, status.alias("status")).where("status is not null")


def catalog(old: DataFrame, new: DataFrame, key: str, digest: str, keep: list[str]) -> DataFrame:
    """The next catalogue: ``key, digest, action`` and the derived columns ``keep`` of rows that did not change.

    reused rows keep what was derived from them (a synopsis, a vector); changed and
    new ones have nulls there, to be filled; deleted rows are not in it.
    """
    a = old.select(key, F.col(digest).alias("_a"), *[F.col(k).alias(f"_{k}") for k in keep], F.lit(True).alias("_old"))
    j = new.select(key, digest).join(a, key, "left")
    same = F.col("_old").isNotNull() & F.col("_a").eqNullSafe(F.col(digest))
    action = F.when(F.col("_old").isNull(), "new").when(same, "reused").otherwise("changed")
    return j.select(key, digest, action.alias("action"), *[F.when(same, F.col(f"_{k}")).alias(k) for k in keep])


def counters(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """``action, files``: how many files a refresh finds new, changed, reused and deleted."""
    a = old.select(key, F.col(digest).alias("_a"), F.lit(True).alias("_old"))
    b = new.select(key, F.col(digest).alias("_b"), F.lit(True).alias("_new"))
    j = a.join(b, key, "full_outer")
    action = F.when(F.col("_new").isNull(), "deleted").when(F.col("_old").isNull(), "new").when(F.col("_a").eqNullSafe(F.col("_b")), "reused").otherwise("changed")
    return j.groupBy(action.alias("action")).agg(F.count("*").alias("files"))


def dirty(records: DataFrame, dependencies: DataFrame, current: DataFrame) -> DataFrame:
    """``path, cause`` of what must be derived again.

    ``records``: path, changed; ``dependencies``: path, kind, key, fingerprint, present
    (also of lookups that found nothing); ``current``: kind, key, fingerprint.  A
    consumer is dirty if it changed, or if any key it looked up now has another
    fingerprint, appeared or disappeared.
    """
    own = records.where("changed").select("path", F.lit("changed").alias("cause"))
    now = current.select("kind", "key", F.col("fingerprint").alias("_now"))
    j = dependencies.join(now, ["kind", "key"], "left")
    gone, came = F.col("present") & F.col("_now").isNull(), ~F.col("present") & F.col("_now").isNotNull()
    moved = F.col("present") & F.col("_now").isNotNull() & ~F.col("_now").eqNullSafe(F.col("fingerprint"))
    dep = j.select("path", F.when(came, "appeared").when(gone, "disappeared").when(moved, "dependency").alias("cause")).where("cause is not null")
    return own.union(dep).distinct()


def index_state(docs: DataFrame, vector: str = "vector") -> DataFrame:
    """One row: documents, vectors and whether a vector index is ready, stale or not_indexed."""
    n, v = F.count("*"), F.count(vector)
    return docs.agg(n.alias("documents"), v.alias("vectors"), F.when(v == 0, "not_indexed").when(v == n, "ready").otherwise("stale").alias("state"))


def reusable(old: DataFrame, new: DataFrame, key: str, digest: str, analyzer: str) -> DataFrame:
    """Rows of ``old`` that stay as they are: same digest, and made by the same analyzer and limits; nothing stays when that changed.

    ``old`` has ``analyzer``, what its rows were made by.
    """
    same = new.select(key, F.col(digest).alias("_d"))
    return old.where(F.col("analyzer") == analyzer).join(same, key).where(F.col(digest).eqNullSafe(F.col("_d"))).drop("_d")


def open_consumers(sites: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Dependencies with one more per file that has a site of unknown closure: on the whole inventory, so any new file makes it dirty.

    ``sites``: path, reason; ``dependencies``: path, kind, key, fingerprint, present.
    """
    unknown = sites.where(F.col("reason").isin("unbound", "import_missing", "member_of_unknown")).select("path").distinct()
    whole = unknown.select("path", F.lit("inventory").alias("kind"), F.lit("*").alias("key"), F.lit(None).cast("string").alias("fingerprint"), F.lit(True).alias("present"))
    return dependencies.unionByName(whole)


def moved_since(read: DataFrame, now: DataFrame, key: str, digest: str) -> DataFrame:
    """``key, cause`` of sources that are no longer what a build read: changed or gone.  Before publishing, this must be empty."""
    j = read.select(key, F.col(digest).alias("_a")).join(now.select(key, F.col(digest).alias("_b"), F.lit(True).alias("_there")), key, "left")
    cause = F.when(F.col("_there").isNull(), "gone").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return j.select(key, cause.alias("cause")).where("cause is not null")
