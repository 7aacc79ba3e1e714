"""Rules that give a name its target, or a reason why it has none."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import ancestors, depth
from ..sources.shared import cut
from .skew import salted_join


#: Deeper than any parser nests; only a cycle of parents goes beyond.
MOST_NESTING = 1000


def unique_match(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``value`` of the only right row with the same keys, or ``reason``: missing or duplicate.

    The right side is reduced to one row per key before it is joined.
    """
    one = right.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(value).alias("_v"))
    out = left.join(one, keys, "left")
    return out.withColumn(value, F.when(F.col("_n") == 1, F.col("_v"))).withColumn("reason", F.when(F.col("_n").isNull(), "missing").when(F.col("_n") > 1, "duplicate")).drop("_n", "_v")


def nearest_binding(sites: DataFrame, scopes: DataFrame, bindings: DataFrame) -> DataFrame:
    """The binding of a site's name in the nearest enclosing scope that binds it, if that scope binds it once.

    ``sites``: site_id, path, scope, name; ``scopes``: path, ordinal, parent;
    ``bindings``: path, scope, name, value.  Adds ``value`` and ``reason`` (unbound,
    ambiguous).  One step per level of nesting, until no scope has a parent; scopes
    that name each other as parents end the walk with an error.
    """
    up = cut(sites.select("site_id", "path", "name", F.col("scope").alias("at"), F.lit(0).alias("distance")))
    chain, level = up, up
    parents = scopes.select("path", F.col("ordinal").alias("at"), F.col("parent").alias("_p"))
    for d in range(1, MOST_NESTING + 1):
        level = cut(level.join(parents, ["path", "at"]).where("_p is not null and _p >= 0").select("site_id", "path", "name", F.col("_p").alias("at"), F.lit(d).alias("distance")))
        if level.isEmpty():
            break
        chain = chain.union(level)
    else:
        raise ValueError(f"scopes nest more than {MOST_NESTING} deep")
    per = bindings.groupBy("path", F.col("scope").alias("at"), "name").agg(F.count("*").alias("n"), F.min("value").alias("value"))
    hits = chain.join(per, ["path", "at", "name"])
    best = hits.groupBy("site_id").agg(F.min_by(F.struct("n", "value"), "distance").alias("b"))
    out = sites.join(best, "site_id", "left")
    return out.withColumn("value", F.when(F.col("b.n") == 1, F.col("b.value"))).withColumn("reason", F.when(F.col("b").isNull(), "unbound").when(F.col("b.n") > 1, "ambiguous")).drop("b")


def follow_aliases(aliases: DataFrame, most: int = 64) -> DataFrame:
    """``name, final, hops, reason`` of chains name -> target; reason is cycle, too_long, or null.

    Pointer doubling: after k rounds a name points 2**k hops ahead, so a chain of
    length n takes log2(n) joins instead of n.
    """
    names = aliases.select("name", "target").where("name is not null and target is not null").dropDuplicates(["name"])
    step = cut(names.select("name", F.col("target").alias("at"), F.lit(1).alias("hops")))
    rounds = 0
    while (1 << rounds) < most:
        ahead = step.select(F.col("name").alias("at"), F.col("at").alias("_next"), F.col("hops").alias("_more"))
        step = cut(step.join(ahead, "at", "left").select("name", F.coalesce("_next", "at").alias("at"), (F.col("hops") + F.coalesce("_more", F.lit(0))).alias("hops")))
        rounds += 1
    loops = step.join(names.select(F.col("name").alias("at")), "at", "left_semi").select("name", F.lit(True).alias("_loop"))
    out = step.join(loops, "name", "left")
    return out.select("name", F.when(F.col("_loop").isNull(), F.col("at")).alias("final"), F.when(F.col("_loop").isNull(), F.col("hops")).alias("hops"), F.when(F.col("_loop"), "cycle").alias("reason"))


def longest_prefix_owner(items: DataFrame, path: str, owners: DataFrame, prefix: str, owner: str) -> DataFrame:
    """The owner with the longest directory prefix of a path, null where none.

    Ancestors are exploded and equi-joined: no nested loop over owners, and a hot
    prefix is spread by salt.
    """
    up = items.select(F.col(path).alias("_p")).where("_p is not null").distinct().select("_p", F.explode(ancestors("_p")).alias("_a"))
    best = salted_join(up, owners.select(F.col(prefix).alias("_a"), F.col(owner).alias("_o")), ["_a"], F.col("_p")).groupBy("_p").agg(F.max_by("_o", depth("_a")).alias(owner))
    return items.join(best.withColumnRenamed("_p", path), path, "left")


def single_probe(*typed: tuple[str, DataFrame]) -> DataFrame:
    """``key, kind`` of keys that exactly one of several typed tables holds exactly once."""
    both = None
    for kind, df in typed:
        one = df.select(F.col(df.columns[0]).cast("string").alias("key"), F.lit(kind).alias("kind"))
        both = one if both is None else both.unionByName(one)
    return both.groupBy("key").agg(F.count("*").alias("n"), F.min("kind").alias("kind")).where("n = 1").select("key", "kind")


def first_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
