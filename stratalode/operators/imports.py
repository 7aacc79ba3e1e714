"""Import statements and the local files or directories they name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import CODE_EXTENSIONS, basename, dirname, extension
from .rollup import inventory

# How import statements are recognised.
JS_IMPORT = r"""(?:\bfrom\s*|\bimport\s*\(|\brequire\s*\()\s*['"]([^'"]+)['"]"""
PY_IMPORT = r"^\s*(?:from\s+([.\w]+)\s+import|import\s+([\w.]+))"


QUOTED = '"([^"\n]+)"'


def _go(body: Column) -> Column:
    """Quoted paths of single imports and import blocks; the state inside a block is folded over the lines."""
    lines = F.transform(F.split(body, "\n"), lambda x: F.trim(F.translate(x, "\t\r", "  ")))
    start = F.struct(F.lit(False).alias("block"), F.array().cast("array<string>").alias("found"))

    def step(acc, s):
        opens = s.startswith("import (")
        closes = acc["block"] & (s == ")")
        takes = ~opens & ~closes & (acc["block"] | s.startswith("import "))
        q = F.regexp_extract(F.substring_index(s, "//", 1), QUOTED, 1)
        found = F.when(takes & (q != ""), F.concat(acc["found"], F.array(q))).otherwise(acc["found"])
        return F.struct(F.when(opens, F.lit(True)).when(closes, F.lit(False)).otherwise(acc["block"]).alias("block"), found.alias("found"))

    return F.aggregate(lines, start, step, lambda acc: acc["found"])


def _python(body: Column) -> Column:
    lines = F.split(body, "\n")
    got = F.transform(lines, lambda x: F.coalesce(F.nullif(F.regexp_extract(x, PY_IMPORT, 1), F.lit("")), F.regexp_extract(x, PY_IMPORT, 2)))
    return F.filter(got, lambda x: x != "")


def statements(files: DataFrame, path: str = "path", body: str = "body") -> DataFrame:
    """``path, ordinal, module`` of the import statements of Go, Python and JavaScript/TypeScript bodies.

    One narrow stage; null bodies and other languages give no rows.
    """
    ext, b = extension(path), F.col(body)
    found = F.when(ext == "go", _go(b)).when(ext == "py", _python(b)).when(ext.isin("js", "jsx", "ts", "tsx"), F.regexp_extract_all(b, F.lit(JS_IMPORT), F.lit(1)))
    src = files.where(b.isNotNull() & ext.isin(*CODE_EXTENSIONS)).select(F.col(path).alias("path"), found.alias("m"))
    return src.select("path", F.posexplode("m").alias("ordinal", "module"))


def normal_path(p: Column) -> Column:
    """A relative path with ``.`` and ``..`` resolved; null where it climbs out of the root."""
    parts = F.filter(F.split(p, "/"), lambda s: ~s.isin("", "."))
    start = F.array().cast("array<string>")
    out = F.aggregate(parts, F.struct(start.alias("a"), F.lit(True).alias("ok")), lambda acc, s: F.when(s == "..", F.struct(F.slice(acc["a"], F.lit(1), F.greatest(F.size(acc["a"]) - 1, F.lit(0))).alias("a"), (acc["ok"] & (F.size(acc["a"]) > 0)).alias("ok"))).otherwise(F.struct(F.concat(acc["a"], F.array(s)).alias("a"), acc["ok"].alias("ok"))))
    return F.when(out["ok"], F.array_join(out["a"], "/"))


def target_path(path: Column, module: Column, go_module: Column) -> Column:
    """The local path that an import names, before anything is known to exist there.

    Go: below the module's own name.  Python: leading dots climb, other names are
    taken from the root.  JavaScript and TypeScript: relative names only.
    """
    ext, parent = extension(path), dirname(path)
    dots = F.length(F.regexp_extract(module, r"^(\.*)", 1))
    rest = F.translate(F.substring(module, dots + 1, F.length(module)), ".", "/")
    up = F.array_join(F.array_repeat(F.lit(".."), F.greatest(dots - 1, F.lit(0)).cast("int")), "/")
    relative = normal_path(F.concat_ws("/", parent, F.when(dots > 1, up), rest))
    return (
        F.when((ext == "go") & module.startswith(F.concat(go_module, F.lit("/"))), F.substring(module, F.length(go_module) + 2, F.length(module)))
        .when((ext == "py") & (dots > 0), relative)
        .when(ext == "py", F.translate(module, ".", "/"))
        .when(ext.isin("js", "jsx", "ts", "tsx") & module.startswith("."), normal_path(F.concat_ws("/", F.nullif(parent, F.lit("")), module)))
    )


def resolve(imports: DataFrame, files: DataFrame, target: str = "target") -> DataFrame:
    """``target_dir`` beside each import: its target if that is a directory, its parent if target (with a code extension or without) is a file there.

    Two equi-joins on distinct targets; imports that share a target, such as a
    module that a tenth of all files import, are looked up once.
    """
    paths = inventory(files)
    dirs = paths.select(F.explode(_ancestors_of("path")).alias("d")).distinct()
    wanted = imports.where(F.col(target).isNotNull()).select(F.col(target).alias("t")).distinct()
    as_dir = wanted.join(dirs.withColumnRenamed("d", "t"), "t").select("t", F.col("t").alias("a"))
    tries = wanted.select("t", F.explode(F.array(F.col("t"), *[F.concat("t", F.lit(f".{e}")) for e in CODE_EXTENSIONS])).alias("path"))
    as_file = tries.join(paths, "path").select("t", dirname("t").alias("b")).distinct()
    known = wanted.join(as_dir, "t", "left").join(as_file, "t", "left").select(F.col("t").alias(target), F.coalesce("a", "b").alias("target_dir"))
    return imports.join(known, target, "left")


def _ancestors_of(path: str) -> Column:
    from ..functions.paths import ancestors

    return ancestors(dirname(path))


def certainty(targets: Column, partial: Column, language: Column) -> Column:
    """unresolved without a target; resolved with exactly one in a whole file that is not Go; else candidate."""
    n = F.size(targets)
    return F.when(n <= 0, "unresolved").when((n == 1) & ~partial & (language != "go"), "resolved").otherwise("candidate")


def module_candidates(imports: DataFrame, files: DataFrame, name: str = "name") -> DataFrame:
    """``target_path`` where exactly one file is called like the import, else why not (``missing`` or ``ambiguous``).

    Candidates are counted per name before the join, so a name that many files
    share costs one row.
    """
    stem = F.regexp_replace(basename("path"), r"\.[^.]*$", "")
    by = inventory(files).groupBy(stem.alias(name)).agg(F.count("*").alias("n"), F.min("path").alias("p"))
    out = imports.join(by, name, "left")
    return out.withColumn("target_path", F.when(F.col("n") == 1, F.col("p"))).withColumn("reason", F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "ambiguous")).drop("n", "p")


def go_requirements(mods: DataFrame, path: str = "path", body: str = "body") -> DataFrame:
    """``path, module, directive, name, version`` of go.mod files: require and replace lines, single or in blocks.

    A file with any other directive than module, require, replace, godebug, go and
    toolchain is not qualified and gives no rows.
    """
    lines = mods.where(F.col(body).isNotNull()).select(F.col(path).alias("path"), F.posexplode(F.split(F.regexp_replace(body, "\r", ""), "\n")).alias("no", "raw"))
    s = F.trim(F.substring_index(F.translate("raw", "\t", " "), "//", 1))
    lines = lines.select("path", "no", s.alias("s")).where("s <> ''")
    word = F.substring_index("s", " ", 1)
    opens = F.col("s").rlike(r"^\w+ *\($")
    # a block's word holds until its closing bracket; go.mod files are small, so one window per file is bounded
    w = Window.partitionBy("path").orderBy("no")
    marked = lines.withColumn("mark", F.when(opens, F.regexp_extract("s", r"^(\w+)", 1)).when(F.col("s") == ")", F.lit("")))
    marked = marked.withColumn("block", F.last("mark", True).over(w))
    body_lines = marked.where(F.col("mark").isNull()).withColumn("in", F.coalesce("block", F.lit("")) != "")
    rows = body_lines.select("path", "no", F.when(F.col("in"), F.col("block")).otherwise(word).alias("directive"), F.when(F.col("in"), F.col("s")).otherwise(F.trim(F.regexp_replace("s", r"^\S+\s*", ""))).alias("rest"))
    bad = rows.where(~F.col("directive").isin("module", "require", "replace", "godebug", "go", "toolchain")).select("path").distinct()
    rows = rows.join(bad, "path", "left_anti")
    module = rows.where("directive = 'module'").groupBy("path").agg(F.min_by(F.regexp_replace("rest", '"', ""), "no").alias("module"))
    need = rows.where(F.col("directive").isin("require", "replace")).select("path", "directive", F.regexp_extract("rest", r"^(\S+)", 1).alias("name"), F.regexp_extract("rest", r"^\S+\s+(?:=>\s+)?(\S+)", 1).alias("version"))
    return module.join(need, "path", "left")
