"""Change impact over several kinds of links, with what is not known about it.

Nodes are files and symbols.  A selected area yields its files; a file yields the
callers of its symbols and the files that import it; a caller yields itself and
its own file.  Links without a target, candidates and links beyond the depth are
counted as boundaries, so a result says whether it is complete.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import selected
from ..sources.shared import cut

FILE, SYMBOL = "file:", "symbol:"


def links(calls: DataFrame, imports: DataFrame, symbols: DataFrame, contracts: DataFrame | None = None) -> DataFrame:
    """``relation, certainty, source, target, site_id``: who depends (source) on what (target).

    ``calls``: site_id, path, caller_id, target_id, certainty; ``imports``: site_id, path,
    target_path, certainty; ``symbols``: id, path; ``contracts``: site_id, path, caller_id,
    witness_path, certainty (a binding depends on every file its match rests on).
    A target '' or null stays null.
    """
    none = F.lit(None).cast("string")
    target = lambda c, kind: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(kind), F.col(c))).otherwise(none)
    own = F.coalesce(target("caller_id", SYMBOL), F.concat(F.lit(FILE), F.col("path")))
    a = calls.select(F.lit("call").alias("relation"), "certainty", own.alias("source"), target("target_id", SYMBOL).alias("target"), "site_id")
    b = imports.select(F.lit("import").alias("relation"), "certainty", F.concat(F.lit(FILE), F.col("path")).alias("source"), target("target_path", FILE).alias("target"), "site_id")
    # a symbol is part of its file, both ways: a changed file changes its symbols, a changed symbol its file
    s = symbols.select(F.concat(F.lit(SYMBOL), F.col("id")).alias("i"), F.concat(F.lit(FILE), F.col("path")).alias("p"))
    c = s.select(F.lit("member").alias("relation"), F.lit("resolved").alias("certainty"), F.col("i").alias("source"), F.col("p").alias("target"), none.alias("site_id"))
    d = s.select(F.lit("owner").alias("relation"), F.lit("resolved").alias("certainty"), F.col("p").alias("source"), F.col("i").alias("target"), none.alias("site_id"))
    out = a.unionByName(b).unionByName(c).unionByName(d)
    if contracts is None:
        return out
    return out.unionByName(contracts.select(F.lit("contract").alias("relation"), "certainty", own.alias("source"), target("witness_path", FILE).alias("target"), "site_id"))


def impact(edges: DataFrame, files: DataFrame, areas: list[str], depth: int, relations: tuple[str, ...] = ("call", "import"), certainties: tuple[str, ...] = ("resolved", "candidate"), changed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``level, relation, certainty, source, target, site_id`` reached within ``depth``, and ``reason, count`` of its boundaries.

    Membership costs no level.  An edge is reported once, at its smallest level.
    ``changed``: paths (``path``) that start the walk beside the areas, such as those of
    ``snapshot.changes``; deleted ones too, as others may still name them.
    """
    if not 1 <= depth <= 32:
        raise ValueError("depth must be 1 to 32")
    edges = cut(edges)
    pick: Column = F.lit(False)
    for area in areas:
        pick = pick | selected("path", area)
    start = files.where(pick).select("path")
    if changed is not None:
        start = start.union(changed.where("path is not null").select("path"))
    start = cut(start.select(F.concat(F.lit(FILE), F.col("path")).alias("node")).distinct())
    wanted = edges.where(F.col("relation").isin(*relations) & F.col("certainty").isin(*certainties) & F.col("target").isNotNull())
    member = edges.where("relation = 'member'").select(F.col("source").alias("i"), F.col("target").alias("p"))
    own = edges.where("relation = 'owner'").select(F.col("source").alias("p"), F.col("target").alias("i"))

    def whole(nodes: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
        """Files with their symbols, and (for callers) symbols with their files."""
        out = nodes.select("node")
        if "down" in kinds:
            out = out.union(nodes.join(own, nodes.node == own.p).select("i"))
        if "up" in kinds:
            out = out.union(nodes.join(member, nodes.node == member.i).select("p"))
        return out.distinct()

    seen = frontier = cut(whole(start, ("down",)))
    found = None
    for level in range(depth):
        hop = cut(wanted.join(frontier.withColumnRenamed("node", "target"), "target").withColumn("level", F.lit(level)))
        found = hop if found is None else found.unionByName(hop)
        frontier = cut(whole(hop.select(F.col("source").alias("node")).distinct(), ("up",)).join(seen, "node", "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    keys = ["relation", "site_id", "source", "target", "certainty"]
    rows = found.groupBy(*keys).agg(F.min("level").alias("level")).select("level", *keys)
    # what starts in the reached nodes but leads nowhere known, what the filters took out, what lies beyond the depth
    reached = seen.withColumnRenamed("node", "source")
    inside = edges.where(F.col("relation").isin("call", "import", "contract")).join(reached, "source", "left_semi")
    open_ends = inside.where("target is null").select(F.concat_ws("_", F.lit("unresolved"), "relation").alias("reason"))
    maybe = inside.where("certainty = 'candidate'").select(F.concat_ws("_", F.lit("candidate"), "relation").alias("reason"))
    into = edges.where("target is not null").join(seen.withColumnRenamed("node", "target"), "target", "left_semi")
    dropped = into.where(F.col("relation").isin("call", "import", "contract") & ~(F.col("relation").isin(*relations) & F.col("certainty").isin(*certainties))).select(F.lit("filtered").alias("reason"))
    beyond = wanted.join(frontier.withColumnRenamed("node", "target"), "target", "left_semi").select(F.lit("depth_limit").alias("reason"))
    missing = None
    for area in areas:
        if area == "." or area.endswith("/"):
            continue
        one = files.where(F.col("path") == area).agg(F.count("*").alias("n")).where("n = 0").select(F.lit("area_not_in_inventory").alias("reason"))
        missing = one if missing is None else missing.union(one)
    all_reasons = open_ends.union(maybe).union(dropped).union(beyond)
    if changed is not None:
        lost = changed.where("path is not null").select("path").distinct().join(files.select("path").distinct(), "path", "left_anti")
        all_reasons = all_reasons.union(lost.select(F.lit("changed_path_not_in_inventory").alias("reason")))
    if missing is not None:
        all_reasons = all_reasons.union(missing)
    return rows, all_reasons.groupBy("reason").agg(F.count("*").alias("count"))
