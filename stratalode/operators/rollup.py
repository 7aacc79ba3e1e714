"""Directory trees, import edges and their rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import ancestors, common_depth, depth, dirname, head

# Source directories that are opened up, their children's priorities, categories of directory names, layers of roles.
EXPANDED = ("src", "app", "apps", "packages", "internal", "pkg", "lib", "services", "server", "client")
PRIORITY = {"provider": 0, "api": 0, "core": 0, "service": 1, "services": 1, "framework": 2, "conns": 3, "server": 3, "client": 3, "storage": 3}
CATEGORY = {
    "docs": ("Documentation", "documentation"), "website": ("Documentation", "documentation"), "examples": ("Examples", "examples"),
    "tests": ("Tests", "tests"), "test": ("Tests", "tests"), "acctest": ("Tests", "tests"),
    "tools": ("Developer tools", "tooling"), "scripts": ("Developer tools", "tooling"), "generate": ("Developer tools", "tooling"), "generator": ("Developer tools", "tooling"),
    "infrastructure": ("Infrastructure", "infrastructure"), "deploy": ("Infrastructure", "infrastructure"),
}
LAYER = {"entry": 0, "runtime": 1, "application": 1, "library": 1, "tooling": 2, "infrastructure": 2, "tests": 2, "documentation": 3, "examples": 3}
MOST_GROUPS, TOP_CHILDREN, SAMPLE = 12, 4, 8


def inventory(files: DataFrame, path: str = "path") -> DataFrame:
    """Each path once; null paths name nothing and are dropped."""
    return files.where(F.col(path).isNotNull()).select(F.col(path).alias("path")).distinct()


def tree_counts(paths: DataFrame) -> DataFrame:
    """``directory, files``: files anywhere below each directory, the root being ''.

    Paths are first counted per directory, so what is multiplied by the depth of
    the tree is one row per directory, not one per file.
    """
    own = paths.groupBy(dirname("path").alias("d")).agg(F.count("*").alias("n"))
    return own.select(F.explode(ancestors("d")).alias("directory"), "n").groupBy("directory").agg(F.sum("n").alias("files"))


def child_directories(counts: DataFrame) -> DataFrame:
    """``directory, child`` of a tree's counts, one row per child: a root may have any number."""
    return counts.where("directory <> ''").select(dirname("directory").alias("directory"), F.col("directory").alias("child"))


def samples(paths: DataFrame) -> DataFrame:
    """``directory, sample``: the first eight files anywhere below each directory, in order of their paths.

    The first eight below a directory are among the first eight of each directory
    below it, so no more than those climb the tree; ranks are cut per task before
    rows are shuffled.
    """
    own = Window.partitionBy("_d").orderBy("path")
    first = paths.select(dirname("path").alias("_d"), "path").withColumn("_r", F.row_number().over(own)).where(F.col("_r") <= SAMPLE)
    up = first.select(F.explode(ancestors("_d")).alias("directory"), "path")
    best = up.withColumn("_r", F.row_number().over(Window.partitionBy("directory").orderBy("path"))).where(F.col("_r") <= SAMPLE)
    return best.groupBy("directory").agg(F.array_sort(F.collect_list("path")).alias("sample"))


def tree_nodes(paths: DataFrame) -> DataFrame:
    """``directory, files, direct, children, sample``: counts of files below and directly in it and of child directories, and the first eight files below."""
    direct = paths.groupBy(dirname("path").alias("directory")).agg(F.count("*").alias("direct"))
    counts = tree_counts(paths)
    children = child_directories(counts).groupBy("directory").agg(F.count("*").alias("children"))
    out = counts.join(direct, "directory", "left").join(children, "directory", "left").join(samples(paths), "directory", "left")
    return out.select("directory", "files", F.coalesce("direct", F.lit(0)).alias("direct"), F.coalesce("children", F.lit(0)).alias("children"), "sample")


def edge_counts(edges: DataFrame) -> DataFrame:
    """``source, target, count`` of directory edges; self edges and edges without a target are left out."""
    e = edges.where(F.col("source").isNotNull() & F.col("target").isNotNull() & (F.col("source") != F.col("target")))
    return e.groupBy("source", "target").agg(F.count("*").alias("count"))


def scope_edges(edges: DataFrame) -> DataFrame:
    """``scope, source, target, count``: every edge lifted to the children of the lowest directory that holds both ends.

    An end that is that directory itself is named ``scope:`` and the directory.
    """
    n = common_depth("source", "target")
    scope = head("source", n)

    def end(side):
        return F.when(depth(side) == n, F.concat(F.lit("scope:"), scope)).otherwise(head(side, n + 1))

    # other names first: an alias called like an input column would be picked up inside the lambda of common_depth
    lifted = edges.select(scope.alias("scope"), end("source").alias("_s"), end("target").alias("_t"), "count").withColumnsRenamed({"_s": "source", "_t": "target"})
    return lifted.where("source <> target").groupBy("scope", "source", "target").agg(F.sum("count").alias("count"))


def degrees(edges: DataFrame) -> DataFrame:
    """``node, incoming, outgoing``: weighted degrees."""
    zero = F.lit(0).cast("bigint")
    out = edges.select(F.col("source").alias("node"), zero.alias("incoming"), F.col("count").alias("outgoing"))
    into = edges.select(F.col("target").alias("node"), F.col("count").alias("incoming"), zero.alias("outgoing"))
    return out.unionByName(into).groupBy("node").agg(F.sum("incoming").alias("incoming"), F.sum("outgoing").alias("outgoing"))


def nearest_ancestor(items: DataFrame, directory: str, owners: DataFrame, owner_dir: str, value: str) -> DataFrame:
    """Left join of each item to the deepest of its ancestors (itself included) that ``owners`` lists; null where none is.

    Distinct directories are looked up once each, whatever the number of items.
    """
    dirs = items.where(F.col(directory).isNotNull()).select(F.col(directory).alias("_d")).distinct()
    own = owners.select(F.col(owner_dir).alias("_a"), F.col(value).alias("_v"))
    up = dirs.select("_d", F.explode(ancestors("_d")).alias("_a"))
    best = up.join(own, "_a").groupBy("_d").agg(F.max_by("_v", depth("_a")).alias(value))
    return items.join(best.withColumnRenamed("_d", directory), directory, "left")


def system_partition(paths: DataFrame, roles: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """At most twelve disjoint groups of all files, and the group of every listed directory.

    First result: ``name, role, layer, files, paths``; second: ``directory, name, role``
    (the most specific listed directory owns a file).  ``roles``: ``directory, role``
    of top-level directories that no category names.
    """
    counts = tree_counts(paths)
    direct = paths.groupBy(dirname("path").alias("directory")).agg(F.count("*").alias("direct"))
    parents = child_directories(counts).select("directory").distinct().withColumn("_parent", F.lit(True))
    nodes = counts.join(direct, "directory", "left").join(parents, "directory", "left").select("directory", "files", F.coalesce("direct", F.lit(0)).alias("direct"), F.coalesce("_parent", F.lit(False)).alias("parent"))
    base = F.lower(F.substring_index("directory", "/", -1))
    cat = F.create_map(*[F.lit(x) for k, v in CATEGORY.items() for x in (k, v[0])])
    cat_role = F.create_map(*[F.lit(x) for k, v in CATEGORY.items() for x in (k, v[1])])
    rank = F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])
    root = nodes.where("directory = ''").select(F.lit("Root files").alias("name"), F.lit("entry").alias("role"), F.lit("").alias("directory"), F.col("direct").alias("files"))
    top = nodes.where((F.col("directory") != "") & ~F.col("directory").contains("/"))
    opened = F.lower("directory").isin(*EXPANDED) & F.col("parent")
    plain = top.where(~opened)
    if roles is not None:
        plain = plain.join(roles.select("directory", F.col("role").alias("_given")), "directory", "left")
    else:
        plain = plain.withColumn("_given", F.lit(None).cast("string"))
    plain = plain.select(F.coalesce(cat[F.lower("directory")], F.col("directory")).alias("name"), F.coalesce(cat_role[F.lower("directory")], "_given", F.lit("other")).alias("role"), "directory", "files")
    src = top.where(opened)
    kids = child_directories(counts).withColumnsRenamed({"directory": "parent", "child": "directory"}).join(F.broadcast(src.select(F.col("directory").alias("parent"))), "parent").join(counts, "directory")  # at most ten opened directories
    known = kids.where(cat[base].isNotNull()).select(cat[base].alias("name"), cat_role[base].alias("role"), "directory", "files")
    order = Window.partitionBy("parent").orderBy(F.coalesce(rank[base], F.lit(4)), F.desc("files"), "directory")
    ranked = kids.where(cat[base].isNull()).withColumn("r", F.row_number().over(order))
    first = ranked.where(F.col("r") <= TOP_CHILDREN).select(F.col("directory").alias("name"), F.lit("runtime").alias("role"), "directory", "files")
    shared = F.concat(F.lit("Shared "), F.col("parent"), F.lit(" components"))
    rest = ranked.where(F.col("r") > TOP_CHILDREN).select(shared.alias("name"), F.lit("runtime").alias("role"), "directory", "files")
    loose = src.where("direct > 0").select(F.concat(F.lit("Shared "), F.col("directory"), F.lit(" components")).alias("name"), F.lit("runtime").alias("role"), "directory", F.col("direct").alias("files"))
    listed = root.unionByName(plain).unionByName(known).unionByName(first).unionByName(rest).unionByName(loose).where("files > 0")
    groups = listed.groupBy("name", "role").agg(F.sum("files").alias("files"), F.array_sort(F.collect_set("directory")).alias("paths"))
    rows = Window.orderBy(~F.col("role").isin("entry", "runtime", "application"), F.desc("files"), "name")
    # one row per group: top-level directories only, never files
    placed = groups.withColumn("r", F.row_number().over(rows)).withColumn("n", F.count("*").over(Window.partitionBy(F.lit(0))))
    other = (F.col("n") > MOST_GROUPS) & (F.col("r") >= MOST_GROUPS)
    placed = placed.select(
        F.col("name").alias("_name"), F.col("role").alias("_role"), "files", "paths",
        F.when(other, "Other components").otherwise(F.col("name")).alias("name"), F.when(other, "other").otherwise(F.col("role")).alias("role"),
    )
    layer = F.coalesce(F.create_map(*[F.lit(x) for kv in LAYER.items() for x in kv])[F.col("role")], F.lit(2))
    final = placed.groupBy("name", "role").agg(F.sum("files").alias("files"), F.array_sort(F.flatten(F.collect_list("paths"))).alias("paths"))
    owners = listed.join(placed.select(F.col("_name").alias("name"), F.col("_role").alias("role"), F.col("name").alias("_n"), F.col("role").alias("_r")), ["name", "role"]).select("directory", F.col("_n").alias("name"), F.col("_r").alias("role"))
    return final.withColumn("layer", layer).select("name", "role", "layer", "files", "paths"), owners


def system_edges(edges: DataFrame, owners: DataFrame) -> DataFrame:
    """``source, target, count`` between groups; edges inside a group or without an owner are dropped."""
    own = owners.select("directory", F.col("name").alias("owner"))
    a = nearest_ancestor(edges.withColumnRenamed("source", "_s"), "_s", own, "directory", "owner").withColumnRenamed("owner", "source")
    b = nearest_ancestor(a.withColumnRenamed("target", "_t"), "_t", own, "directory", "owner").withColumnRenamed("owner", "target")
    return b.where("source is not null and target is not null and source <> target").groupBy("source", "target").agg(F.sum("count").alias("count"))
