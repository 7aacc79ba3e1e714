"""Package-wide rules of Go: one package per directory, bindings shared by its files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import dirname, go_filename_class
from .resolution import longest_prefix_owner


def packages(files: DataFrame) -> DataFrame:
    """``directory, package, reason`` of ``path, package, reason`` of Go files (their package clause, and why a file is not qualified, or null).

    A directory is qualified if all its neutral files name one package and none is
    disqualified; test, platform and ignored files take no part.  Aggregated in one
    pass with partial results per task.
    """
    f = files.where(go_filename_class("path") == "neutral")
    per = f.groupBy(dirname("path").alias("directory")).agg(
        F.count_distinct("package").alias("n"), F.min("package").alias("package"), F.min_by("reason", F.when(F.col("reason").isNotNull(), F.col("path"))).alias("why"),
        F.count(F.when(F.col("package").isNull(), 1)).alias("unnamed"),
    )
    reason = F.when(F.col("why").isNotNull(), F.col("why")).when(F.col("unnamed") > 0, "package_unknown").when(F.col("n") > 1, "packages_differ")
    return per.select("directory", F.when(reason.isNull(), F.col("package")).alias("package"), reason.alias("reason"))


def package_bindings(bindings: DataFrame) -> DataFrame:
    """``directory, name, count, path, value``: package-level names over all files of a directory, imports left out; path and value of the first."""
    b = bindings.where("kind <> 'import'").select(dirname("path").alias("directory"), "name", "path", "value")
    return b.groupBy("directory", "name").agg(F.count("*").alias("count"), F.min(F.struct("path", "value")).alias("v")).select("directory", "name", "count", F.col("v.path").alias("path"), F.col("v.value").alias("value"))


def resolve_in_package(sites: DataFrame, bindings: DataFrame, qualified: DataFrame) -> DataFrame:
    """Sites that their own file leaves unbound, looked up in their package: ``value`` if it binds the name once, else ``reason``."""
    s = sites.withColumn("directory", dirname("path"))
    j = s.join(qualified.select("directory", F.col("reason").alias("_q")), "directory", "left").join(package_bindings(bindings).select("directory", "name", "count", "value"), ["directory", "name"], "left")
    reason = F.when(F.col("_q").isNotNull(), F.col("_q")).when(F.col("count").isNull(), "unbound").when(F.col("count") > 1, "ambiguous")
    return j.withColumn("value", F.when(reason.isNull(), F.col("value"))).withColumn("reason", reason).drop("_q", "count", "directory")


def module_of(paths: DataFrame, modules: DataFrame) -> DataFrame:
    """The go.mod that governs each path: ``module`` of the deepest directory above it that has one.  ``modules``: path (of go.mod), module."""
    owners = modules.select(dirname("path").alias("_dir"), "module").dropDuplicates(["_dir"])
    return longest_prefix_owner(paths, "path", owners, "_dir", "module")


def import_directory(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """``target_dir`` of Go imports below a module of the collection; the longest module name that is a prefix wins.  Null for others."""
    roots = modules.select(F.col("module").alias("_m"), dirname("path").alias("_root")).dropDuplicates(["_m"])
    owned = longest_prefix_owner(imports, "module", roots.withColumn("_v", F.concat_ws("\x1f", "_m", "_root")), "_m", "_v")
    m, root = F.substring_index("_v", "\x1f", 1), F.substring_index("_v", "\x1f", -1)
    rest = F.regexp_replace(F.substring(F.col("module"), F.length(m) + 1, F.length("module")), "^/", "")
    return owned.withColumn("target_dir", F.when(F.col("_v").isNotNull(), F.concat_ws("/", F.nullif(root, F.lit("")), F.nullif(rest, F.lit(""))))).drop("_v")
