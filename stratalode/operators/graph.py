"""Occurrences and bounded graph queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut

MOST_DEPTH = 32
#: Physical order of occurrences; '' and -1 stand for an unresolved target and sort before any real one.
ORDER = ("path", "site_start", "site_end", "role", "target_path", "target_start", "target_end", "site_id", "target_id")


def occurrences(sites: DataFrame) -> DataFrame:
    """One row per site and target; a site without targets keeps one row with target ''.

    ``sites`` has ``targets array<string>``.
    """
    t = F.col("targets")
    return sites.withColumn("target_id", F.explode(F.when(t.isNull() | (F.size(t) == 0), F.array(F.lit(""))).otherwise(t))).drop("targets")


def physical_order(rel: DataFrame) -> DataFrame:
    return rel.orderBy(*[c for c in ORDER if c in rel.columns])


def outgoing(rel: DataFrame, seed: str) -> DataFrame:
    return rel.where(F.col("caller_id") == seed)


def incoming(rel: DataFrame, seed: str) -> DataFrame:
    return rel.where(F.col("target_id") == seed)


def after(rel: DataFrame, keys: list[str], values: list, limit: int) -> DataFrame:
    """Keyset page: the next ``limit`` rows behind a row of known keys; works at any depth without counting rows before it."""
    if len(keys) != len(values):
        raise ValueError("a value for every key")
    later = F.lit(False)
    for i in reversed(range(len(keys))):
        k, v = F.col(keys[i]), F.lit(values[i])
        later = (k > v) | ((k == v) & later)
    return rel.where(later).orderBy(*keys).limit(limit)


def within_budget(page: DataFrame, order: list[str], entities: list[str], most: int) -> DataFrame:
    """The rows of a page, in order, while the distinct entities they name stay within ``most``.

    ``page`` is a bounded page (keyset), so its running set fits one window.
    """
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    names = F.filter(F.array(*entities), lambda x: x.isNotNull() & (x != ""))
    seen = F.size(F.array_distinct(F.flatten(F.collect_list(names).over(w))))
    return page.withColumn("entities", seen).where(F.col("entities") <= most)


def walk(edges: DataFrame, seeds: DataFrame, depth: int, reverse: bool = False, follow: Column | None = None) -> DataFrame:
    """Breadth-first edges: ``level, from_id, to_id`` and the edge's other columns.

    A node of level L is expanded iff L < depth; every edge examined is emitted,
    also to visited nodes and to no target (''); a target joins the frontier if it
    was not visited.  ``edges`` has ``caller_id, target_id``; ``follow`` rejects edges
    that are neither emitted nor followed.

    Each level is one equi-join of the frontier with the edges and one anti-join
    with the visited nodes, both written to the shared folder, so lineage and a
    lost executor cost one level.  A level without new nodes ends the walk.
    """
    if not 1 <= depth <= MOST_DEPTH:
        raise ValueError(f"depth must be 1 to {MOST_DEPTH}")
    a, b = ("target_id", "caller_id") if reverse else ("caller_id", "target_id")
    e = cut(edges.where(follow) if follow is not None else edges)  # what the edges come from is computed once, not once a level
    frontier = visited = cut(seeds.select(F.col(seeds.columns[0]).alias("node")).where("node is not null and node <> ''").distinct())
    out = None
    for level in range(depth):
        hop = cut(e.join(frontier.withColumnRenamed("node", a), a).withColumn("level", F.lit(level)))
        out = hop if out is None else out.unionByName(hop)
        frontier = cut(hop.select(F.col(b).alias("node")).where("node is not null and node <> ''").distinct().join(visited, "node", "left_anti"))
        if frontier.isEmpty():
            break
        visited = visited.union(frontier)
    return out.withColumnRenamed(a, "from_id").withColumnRenamed(b, "to_id")


def reached(edges: DataFrame, seeds: DataFrame, depth: int, reverse: bool = False) -> DataFrame:
    """``node, level``: smallest level at which a node is reached; seeds are level 0."""
    w = walk(edges, seeds, depth, reverse)
    hits = w.where("to_id <> ''").select(F.col("to_id").alias("node"), (F.col("level") + 1).alias("level"))
    first = seeds.select(F.col(seeds.columns[0]).alias("node"), F.lit(0).alias("level"))
    return first.unionByName(hits).groupBy("node").agg(F.min("level").alias("level"))


def boundaries(rows: DataFrame, certainty: str = "certainty", relation: str = "relation") -> DataFrame:
    """``reason, count``: why a walk is not known to be complete."""
    reason = F.concat_ws("_", F.col(certainty), F.col(relation))
    return rows.where(F.col(certainty) != "resolved").groupBy(reason.alias("reason")).agg(F.count("*").alias("count"))


def closure_layers(edges: DataFrame, nodes: DataFrame, most: int = 12) -> DataFrame:
    """``node, component, layer`` of a small graph: cycles collapse, a component's layer is its longest path from a source.

    For at most ``most`` nodes (a drawn map); larger graphs raise an error.
    """
    names = [r[0] for r in nodes.select(nodes.columns[0]).distinct().limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"layers are defined for at most {most} nodes")
    pairs = {(r[0], r[1]) for r in edges.where(F.col("source").isin(names) & F.col("target").isin(names)).select("source", "target").distinct().collect()}
    reach = {n: {n} for n in names}
    changed = True
    while changed:
        changed = False
        for s, t in pairs:
            more = reach[t] - reach[s]
            if more:
                reach[s] |= more
                changed = True
    comp = {n: min(m for m in names if m in reach[n] and n in reach[m]) for n in names}
    links = {(comp[s], comp[t]) for s, t in pairs if comp[s] != comp[t]}
    layer = dict.fromkeys(set(comp.values()), 0)
    for _ in names:
        for s, t in links:
            layer[t] = max(layer[t], layer[s] + 1)
    return nodes.sparkSession.createDataFrame([(n, comp[n], layer[comp[n]]) for n in sorted(names)], "node string, component string, layer int")


def local_walk(edges: list[tuple[str, str]], seeds: list[str], depth: int, reverse: bool = False) -> list[tuple[int, str, str]]:
    """``level, from, to`` of the same walk over a list in memory: for small snapshots, and to check the other by."""
    if not 1 <= depth <= MOST_DEPTH:
        raise ValueError(f"depth must be 1 to {MOST_DEPTH}")
    out, seen = [], {s for s in seeds if s}
    frontier = set(seen)
    for level in range(depth):
        hops = [(level, b, a) if reverse else (level, a, b) for a, b in edges if (b if reverse else a) in frontier]
        out += hops
        frontier = {t for _, _, t in hops if t} - seen
        seen |= frontier
        if not frontier:
            break
    return out


def handles(rows: DataFrame, symbols: DataFrame, files: DataFrame, ident: str = "target_id") -> DataFrame:
    """Rows with ``handle``: id, path, range and digest of the declaration they name, and ``fault`` where it can't be shown as it was captured.

    ``symbols``: id, path, start_byte, end_byte; ``files``: path, sha256, bytes.
    """
    f = files.select("path", "sha256", F.col("bytes").alias("_n")).dropDuplicates(["path"])
    s = symbols.select("id", "path", "start_byte", "end_byte").dropDuplicates(["id"]).join(f, "path", "left")
    s = s.select(F.col("id").alias(ident), F.struct("id", "path", "start_byte", "end_byte", "sha256").alias("handle"), (F.col("sha256").isNull() | (F.col("start_byte") < 0) | (F.col("end_byte") <= F.col("start_byte")) | (F.col("end_byte") > F.col("_n"))).alias("_bad"))
    j = rows.join(s, ident, "left")
    fault = F.when(F.coalesce(F.col(ident), F.lit("")) == "", F.lit(None).cast("string")).when(F.col("handle").isNull(), "missing_declaration").when(F.col("_bad"), "range_outside_source")
    return j.withColumn("fault", fault).withColumn("handle", F.when(F.col("fault").isNull(), F.col("handle"))).drop("_bad")
