"""POSIX paths as column expressions; all of them run inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Directories that an inventory skips, and the extensions of code and text files.
SKIP_DIRS = (".git", ".venv", "node_modules", "dist", "build", "vendor", "target")
CODE_EXTENSIONS = ("go", "py", "js", "jsx", "ts", "tsx")
TEXT_EXTENSIONS = ("md", "markdown", "mdx", "rst", "txt", "go", "py", "js", "jsx", "ts", "tsx", "rs", "java", "kt", "c", "h", "cpp", "hpp", "cs", "rb", "sh", "tf", "sql", "vue", "svelte")
PROSE_EXTENSIONS = ("md", "markdown", "mdx", "rst", "txt")
GO_OS = ("aix", "android", "darwin", "dragonfly", "freebsd", "hurd", "illumos", "ios", "js", "linux", "nacl", "netbsd", "openbsd", "plan9", "solaris", "wasip1", "windows", "zos")
GO_ARCH = ("386", "amd64", "amd64p32", "arm", "armbe", "arm64", "arm64be", "loong64", "mips", "mipsle", "mips64", "mips64le", "mips64p32", "mips64p32le", "ppc", "ppc64", "ppc64le", "riscv", "riscv64", "s390", "s390x", "sparc", "sparc64", "wasm")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dirname(p: Column | str) -> Column:
    """'' for a path without a slash."""
    p = col(p)
    return F.when(p.contains("/"), F.regexp_replace(p, "/[^/]*$", "")).when(p.isNotNull(), F.lit(""))


def basename(p: Column | str) -> Column:
    return F.substring_index(col(p), "/", -1)


def extension(p: Column | str) -> Column:
    """Lower-case extension without its dot; '' where the name has none or only begins with a dot."""
    return F.lower(F.regexp_extract(basename(p), r"[^.]\.([^.]+)$", 1))


def ancestors(directory: Column | str) -> Column:
    """'' and every prefix of a directory, itself included."""
    d = col(directory)
    parts = F.filter(F.split(d, "/"), lambda x: x != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def depth(directory: Column | str) -> Column:
    d = col(directory)
    return F.when(d == "", F.lit(0)).otherwise(F.size(F.split(d, "/")))


def head(directory: Column | str, n: Column) -> Column:
    """The first ``n`` segments."""
    return F.call_function("substring_index", col(directory), F.lit("/"), n.cast("int"))


def common_depth(a: Column | str, b: Column | str) -> Column:
    """Number of leading segments that two directories share."""
    x, y = col(a), col(b)
    n = F.least(depth(x), depth(y))
    same = F.transform(F.sequence(F.lit(0), n), lambda i: F.when(head(x, i) == head(y, i), i).otherwise(F.lit(0)))
    return F.array_max(same)


def visible(p: Column | str) -> Column:
    """No hidden segment and no skipped directory on the path."""
    return ~F.exists(F.split(col(p), "/"), lambda s: s.startswith(".") | s.isin(*SKIP_DIRS))


def under(p: Column | str, prefix: str) -> Column:
    """Directory-boundary prefix as a range, so that sorted files can be skipped by their minimum and maximum."""
    q = prefix.strip("/")
    p = col(p)
    return F.lit(True) if not q else (p == q) | ((p >= q + "/") & (p < q + "0"))


def selected(p: Column | str, selector: str) -> Column:
    """A path ending in ``/`` selects a subtree, ``.`` everything, any other exactly itself."""
    p = col(p)
    return F.lit(True) if selector == "." else p.startswith(selector) if selector.endswith("/") else p == selector


def go_filename_class(p: Column | str) -> Column:
    """ignored_filename, not_go_source, test_file, platform_variant or neutral."""
    name = basename(p)
    stem = F.substring_index(name, ".", 1)
    last = F.when(stem.contains("_"), F.substring_index(stem, "_", -1))
    return (
        F.when(name.startswith("_") | name.startswith("."), "ignored_filename")
        .when(~name.endswith(".go"), "not_go_source")
        .when(name.endswith("_test.go"), "test_file")
        .when(last.isin(*GO_OS, *GO_ARCH), "platform_variant")
        .otherwise("neutral")
    )
