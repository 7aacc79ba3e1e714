"""Measures of retrieval and extraction quality."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Value ranges that a group is cut into for ranks.
BLOCKS = 1024


def retrieval_quality(ranked: DataFrame) -> DataFrame:
    """One row: queries, hit@5 and MRR@10 of ``query, rank, relevant``; a query without a relevant row counts 0."""
    first = ranked.groupBy("query").agg(F.min(F.when(F.col("relevant"), F.col("rank"))).alias("r"))
    hit = F.avg(F.when(F.col("r") <= 5, 1.0).otherwise(0.0))
    mrr = F.avg(F.when(F.col("r") <= 10, 1.0 / F.col("r")).otherwise(0.0))
    return first.agg(F.count("*").alias("queries"), F.round(hit, 6).alias("hit_at_5"), F.round(mrr, 6).alias("mrr_at_10"))


def ranked_values(df: DataFrame, group: list[str], value: str, **ranks: Callable[[Column], Column]) -> DataFrame:
    """The values at given 0-based ranks of each group's sorted values, as a function of their number.

    Equal values are counted per task first; ranks are sums over the distinct values
    of a group, of which only one of ``BLOCKS`` value ranges at a time is ordered,
    so a group of any size is never gathered or sorted in one task.
    """
    v = df.where(F.col(value).isNotNull())
    per = v.groupBy(*group, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    span = per.groupBy(*group).agg(F.min("_v").cast("double").alias("_lo"), F.max("_v").cast("double").alias("_hi"), F.sum("_n").alias("_total"))
    at = F.when(F.col("_hi") > F.col("_lo"), F.floor((F.col("_v").cast("double") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * BLOCKS)).otherwise(F.lit(0))
    per = per.join(span, group).withColumn("_block", at)
    blocks = per.groupBy(*group, "_block").agg(F.sum("_n").alias("_m"))
    before = F.coalesce(F.sum("_m").over(Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # at most BLOCKS + 1 rows per group
    placed = per.join(blocks.select(*group, "_block", before.alias("_before")), [*group, "_block"])
    high = F.col("_before") + F.sum("_n").over(Window.partitionBy(*group, "_block").orderBy("_v"))
    placed = placed.withColumn("_high", high)
    pick = lambda r: F.max(F.when((F.col("_high") - F.col("_n") <= r) & (r < F.col("_high")), F.col("_v")))
    return placed.groupBy(*group).agg(*[pick(f(F.col("_total"))).alias(name) for name, f in ranks.items()])


def p95_floor(n: Column) -> Column:
    """The rank floor(.95 (n - 1)): the lower neighbour of the interpolated percentile."""
    return F.floor(0.95 * (n - 1))


def p95_ceil(n: Column) -> Column:
    """The rank ceil(.95 n) - 1."""
    return F.ceil(0.95 * n) - 1


def median_low(n: Column) -> Column:
    return F.floor((n - 1) / 2)


def grade(gold: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """``verdict, rows``: matched once, missing, unexpected, or repeated on either side."""
    g = gold.groupBy(*keys).agg(F.count("*").alias("g"))
    a = actual.groupBy(*keys).agg(F.count("*").alias("a"))
    j = g.join(a, keys, "full_outer")
    verdict = F.when(F.col("a").isNull(), "missing").when(F.col("g").isNull(), "unexpected").when((F.col("g") > 1) | (F.col("a") > 1), "repeated").otherwise("matched")
    return j.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("rows"))


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one side that the other lacks, with multiplicity; empty if both hold the same facts."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def allocation(spark: SparkSession, questions: int, slots: int) -> DataFrame:
    """``slot, position, question, condition``: rotated order, alternating condition, so each question meets both."""
    s, p = spark.range(slots).select(F.col("id").alias("slot")), spark.range(questions).select(F.col("id").alias("position"))
    q = (F.col("slot") + F.col("position")) % questions
    return s.crossJoin(F.broadcast(p)).select("slot", "position", q.alias("question"), F.when((F.col("slot") + F.col("position")) % 2 == 0, "a").otherwise("b").alias("condition"))  # the product is the design itself


def synthetic_vectors(spark: SparkSession, rows: int, width: int) -> DataFrame:
    """``id, vector``: unit vectors for scale tests, a function of the id alone."""
    raw = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: ((F.col("id") * 31 + j * 17) % 101 - 50).cast("double"))
    v = spark.range(rows).select("id", raw.alias("v"))
    n = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return v.select("id", F.when(n > 0, F.transform("v", lambda x: x / n)).alias("vector"))


def acceptance(groups: DataFrame, files: DataFrame, docs: DataFrame, quality: DataFrame, seconds: DataFrame, vector: str = "vector") -> DataFrame:
    """``check, passed``: groups hold all files, no more than twelve of them, every document embedded, hit@5 of at least three quarters, 95 % of answers within a second.

    ``groups``: files per group; ``quality``: of ``retrieval_quality``; ``seconds``: seconds of each answer.
    """
    g = groups.agg(F.coalesce(F.sum("files"), F.lit(0)).alias("held"), F.count("*").alias("groups"))
    n = files.agg(F.count("*").alias("files"))
    d = docs.agg((F.count(vector) == F.count("*")).alias("embedded"))
    p = ranked_values(seconds.withColumn("_all", F.lit(1)), ["_all"], "seconds", p95=p95_floor).select("p95")
    one = g.crossJoin(n).crossJoin(d).crossJoin(quality.select("hit_at_5")).crossJoin(p)  # one row each
    checks = [("all_files_in_system", F.col("held") == F.col("files")), ("system_node_cap", F.col("groups") <= 12), ("all_corpus_embedded", F.col("embedded")), ("hybrid_hit_at_5_at_least_75_percent", F.col("hit_at_5") >= 0.75), ("hybrid_warm_p95_under_one_second", F.col("p95") < 1)]
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("check"), v.alias("passed")) for k, v in checks])).alias("c")).select("c.check", "c.passed")


def compared(ranked: DataFrame, receipts: DataFrame, price: float = 0.042) -> DataFrame:
    """Per method: hit@5, MRR@10, median and 95 % seconds, tokens, their cost, calls and fallbacks.

    ``ranked``: method, query, rank, relevant; ``receipts``: method, query, seconds,
    input_tokens, status; ``price``: of a million tokens.  A query without a relevant row counts 0.
    """
    first = ranked.groupBy("method", "query").agg(F.min(F.when(F.col("relevant"), F.col("rank"))).alias("r"))
    q = first.groupBy("method").agg(F.count("*").alias("queries"), F.round(F.avg(F.when(F.col("r") <= 5, 1.0).otherwise(0.0)), 6).alias("hit_at_5"), F.round(F.avg(F.when(F.col("r") <= 10, 1.0 / F.col("r")).otherwise(0.0)), 6).alias("mrr_at_10"))
    t = receipts.groupBy("method").agg(F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.count(F.when(F.col("status") == "fallback", 1)).alias("fallbacks"), F.count("input_tokens").alias("calls"))
    s = ranked_values(receipts, ["method"], "seconds", p50=median_low, p95=p95_floor)
    return q.join(t, "method", "left").join(s, "method", "left").withColumn("cost", F.round(F.col("input_tokens") * price / 1e6, 8))


def candidate_hit_rate(candidates: DataFrame) -> DataFrame:
    """One row: the share of queries with a relevant candidate at all.  ``candidates``: query, relevant."""
    return candidates.groupBy("query").agg(F.max(F.col("relevant").cast("int")).alias("h")).agg(F.count("*").alias("queries"), F.round(F.avg("h"), 6).alias("candidate_hit_rate"))


def relevant_by_prefix(hits: DataFrame, judgments: DataFrame) -> DataFrame:
    """``hits`` (query, path, ...) with ``relevant``: whether the path begins with one of the query's judged prefixes.

    ``judgments``: query, prefix; a query's prefixes are few, and join as one row.
    """
    per = judgments.groupBy("query").agg(F.collect_set("prefix").alias("_prefixes"))
    j = hits.join(F.broadcast(per), "query", "left")  # one row per judged query
    return j.withColumn("relevant", F.coalesce(F.exists("_prefixes", lambda x: F.col("path").startswith(x)), F.lit(False))).drop("_prefixes")


def grade_certain(gold: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """``verdict, rows`` of targets by what was claimed of them.

    ``gold``: the keys and ``target`` (null: nothing may be claimed); ``actual``: the keys,
    ``certainty`` and ``targets``.  A resolved site must name exactly the target, a
    candidate must have it among its own, an unresolved one is a miss where there is a
    target and right where there is none.
    """
    j = gold.join(actual.select(*keys, "certainty", "targets", F.lit(True).alias("_there")), keys, "left")
    t, has = F.col("target"), F.array_contains("targets", F.col("target"))
    size = F.coalesce(F.size("targets"), F.lit(0))
    verdict = (
        F.when(F.col("_there").isNull(), "missing")
        .when(t.isNull(), F.when((F.col("certainty") == "unresolved") | (size == 0), "right_unresolved").otherwise("wrong_claim"))
        .when(F.col("certainty") == "resolved", F.when(has & (size == 1), "exact").otherwise("wrong"))
        .when(F.col("certainty") == "candidate", F.when(has, "candidate").otherwise("wrong")).otherwise("unresolved")
    )
    return j.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("rows"))


def candidate_recall(gold: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """One row: judged targets, those among the claimed ones, and their share; targets nobody claimed count as lost."""
    claimed = actual.select(*keys, F.explode("targets").alias("target")).distinct().withColumn("_c", F.lit(1))
    j = gold.where("target is not null").select(*keys, "target").distinct().join(claimed, [*keys, "target"], "left")
    return j.agg(F.count("*").alias("targets"), F.count("_c").alias("found")).withColumn("recall", F.when(F.col("targets") > 0, F.round(F.col("found") / F.col("targets"), 6)))
