"""Registered queries of the core, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import bytes as B
from ..functions import ids
from ..functions import paths as P
from ..functions import text as X
from ..functions import vectors as V
from ..operators import coverage, evaluation, facts, graph, imports, incremental, resolution, retrieval, rollup, snapshot
from ..operators.current import latest, stamp_ns
from ..sources import postings
from ..sources.shared import cut
from ..sources.tables import table
from ..streaming import refresh

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(
    """WITH l AS (
  SELECT path, action, lower(regexp_replace(trim(digest), '^(?i)sha-?256[:=\\s]+', '')) AS digest,
         row_number() OVER (PARTITION BY path ORDER BY run_no DESC, log_id DESC) AS rn
  FROM catalog_log WHERE run_no IN (SELECT run_no FROM catalog_runs WHERE state = 'ready')),
c AS (
  SELECT path, lower(regexp_replace(trim(digest), '^(?i)sha-?256[:=\\s]+', '')) AS digest,
         row_number() OVER (PARTITION BY path ORDER BY CAST(split_part(stamp, ':', 1) AS BIGINT) DESC, id DESC) AS rn
  FROM docs)
SELECT c.path FROM c LEFT JOIN (SELECT * FROM l WHERE rn = 1) l USING (path)
WHERE c.rn = 1 AND (l.path IS NULL OR l.action = 'deleted' OR l.digest IS DISTINCT FROM c.digest)"""
)
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return incremental.changed_paths(table(spark, d, "docs"), table(spark, d, "catalog_log"), table(spark, d, "catalog_runs"))


# Shared pieces of SQL

_UP = "list_transform(range(0, len(string_split({d}, '/')) + 1), lambda n: array_to_string(string_split({d}, '/')[1:n], '/'))"
_DIR = "CASE WHEN path LIKE '%/%' THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END"
_FILES = f"files AS (SELECT DISTINCT path, {_DIR} AS d FROM structural_files WHERE path IS NOT NULL)"
_TREE = f"{_FILES}, up AS (SELECT path, unnest({_UP.format(d='d')}) AS directory FROM files), tree AS (SELECT directory, count(DISTINCT path) AS files FROM up GROUP BY directory)"
_IMPORTS = "imp AS (SELECT DISTINCT path, ordinal, name, module, symbol, start_byte, end_byte FROM imports)"
_EDGES = f"""{_TREE}, {_IMPORTS},
named AS (SELECT path, ordinal, {_DIR} AS source, CASE
    WHEN path LIKE '%.py' THEN replace(split_part(module, '.', 1), '_', '-') || substr(replace(module, '.', '/'), length(split_part(module, '.', 1)) + 1)
    WHEN path LIKE '%.go' THEN module WHEN module LIKE './%' THEN split_part(path, '/', 1) || substr(module, 2) END AS t FROM imp),
climb AS (SELECT t, unnest({_UP.format(d='t')}) AS a FROM (SELECT DISTINCT t FROM named WHERE t IS NOT NULL)),
owned AS (SELECT t, arg_max(a, len(string_split(a, '/'))) AS target FROM climb JOIN tree ON a = directory WHERE a <> '' GROUP BY t),
linked AS (SELECT path, ordinal, source, target FROM named LEFT JOIN owned USING (t)),
edges AS (SELECT source, target, count(*) AS count FROM linked WHERE target IS NOT NULL AND source <> target GROUP BY source, target)"""
_CURRENT = "cur AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY CAST(split_part(stamp, ':', 1) AS BIGINT) DESC, id DESC) AS rn FROM docs WHERE path IS NOT NULL) WHERE rn = 1)"
_WORDS = "regexp_replace(regexp_replace({t}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')"


def _paths(spark, d) -> DataFrame:
    return rollup.inventory(table(spark, d, "structural_files"))


def _statements(spark, d) -> DataFrame:
    """Import statements without their repeated rows."""
    return table(spark, d, "imports").select("path", "ordinal", "name", "module", "symbol", "start_byte", "end_byte").distinct()


def _linked(spark, d) -> DataFrame:
    """``path, ordinal, source, target``: each import with the deepest directory of the inventory on its module's path.

    The names of these tables begin at the repository: Python's with its root
    package, Go's with its module, ``./`` of JavaScript and TypeScript at its root.
    """
    ext = P.extension("path")
    first = F.substring_index("module", ".", 1)
    slashed = F.concat(F.translate(first, "_", "-"), F.substring(F.translate("module", ".", "/"), F.length(first) + 1, F.length("module")))
    rooted = F.concat(F.substring_index("path", "/", 1), F.expr("substring(module, 2)"))
    named = _statements(spark, d).select("path", "ordinal", P.dirname("path").alias("source"), F.when(ext == "py", slashed).when(ext == "go", F.col("module")).when(F.col("module").startswith("./"), rooted).alias("t"))
    dirs = rollup.tree_counts(_paths(spark, d)).where("directory <> ''").select("directory", F.col("directory").alias("target"))
    return rollup.nearest_ancestor(named, "t", dirs, "directory", "target").select("path", "ordinal", "source", "target")


def _edges(spark, d) -> DataFrame:
    return rollup.edge_counts(_linked(spark, d))


# Maps and rollups


@query(f"WITH {_TREE} SELECT directory, files FROM tree")
def rollup_tree(spark, d):
    return rollup.tree_counts(_paths(spark, d))


@query(f"""WITH {_TREE},
kids AS (SELECT {_DIR.replace('path', 'directory')} AS parent, count(*) AS children FROM tree WHERE directory <> '' GROUP BY 1),
sampled AS (SELECT directory AS d, string_agg(path, ',' ORDER BY path) AS sample FROM (SELECT directory, path, row_number() OVER (PARTITION BY directory ORDER BY path) AS r FROM up) WHERE r <= 8 GROUP BY 1),
own AS (SELECT d, count(*) AS n FROM files GROUP BY d)
SELECT t.directory, t.files, coalesce(n, 0) AS direct, coalesce(children, 0) AS children, sample
FROM tree t LEFT JOIN kids ON parent = t.directory LEFT JOIN sampled s ON s.d = t.directory LEFT JOIN own o ON o.d = t.directory""")
def rollup_children_sample(spark, d):
    return rollup.tree_nodes(_paths(spark, d)).withColumn("sample", F.array_join("sample", ","))


@query(f"WITH {_TREE} SELECT {_DIR.replace('path', 'directory')} AS directory, directory AS child FROM tree WHERE directory <> ''")
def child_directories(spark, d):
    return rollup.child_directories(rollup.tree_counts(_paths(spark, d)))


# imports whose names are written out of real files, by language: relative with dots, from the root, below a Go module
_WRITTEN = f"""{_TREE}, ranked AS (SELECT path, d, row_number() OVER (PARTITION BY split_part(path, '/', 1), list_last(string_split(path, '.')) ORDER BY path) - 1 AS r, count(*) OVER (PARTITION BY split_part(path, '/', 1), list_last(string_split(path, '.'))) AS n FROM files WHERE regexp_matches(path, '\\.(py|go|js|ts)$')),
pairs AS (SELECT a.path, a.d, a.r, b.path AS goal, b.d AS goal_dir, regexp_replace(b.path, '\\.[^.]*$', '') AS stem FROM ranked a JOIN ranked b ON split_part(a.path, '/', 1) = split_part(b.path, '/', 1) AND list_last(string_split(a.path, '.')) = list_last(string_split(b.path, '.')) AND b.r = (a.r + 7) % a.n),
written AS (SELECT path, d, goal, goal_dir, CASE WHEN path LIKE '%.go' THEN CASE r % 3 WHEN 0 THEN 'example.test/all/' || goal_dir WHEN 1 THEN 'example.test/other/' || goal_dir ELSE 'fmt' END
  WHEN path LIKE '%.py' THEN CASE r % 4 WHEN 0 THEN replace(stem, '/', '.') WHEN 1 THEN repeat('.', len(string_split(d, '/')) + 1) || replace(stem, '/', '.') WHEN 2 THEN replace(goal_dir, '/', '.') ELSE 'os.path' END
  ELSE CASE r % 4 WHEN 0 THEN './' || repeat('../', len(string_split(d, '/'))) || stem WHEN 1 THEN '.' || repeat('/..', len(string_split(d, '/'))) || '/' || goal WHEN 2 THEN './../' || list_last(string_split(d, '/')) || '/nowhere' ELSE 'react' END END AS imported, r FROM pairs)"""


def _written(spark, d) -> DataFrame:
    files = _paths(spark, d)
    ext = P.extension("path")
    w = Window.partitionBy(F.substring_index("path", "/", 1), ext)
    ranked = files.where(ext.isin("py", "go", "js", "ts")).select("path", F.substring_index("path", "/", 1).alias("repo"), ext.alias("ext"), (F.row_number().over(w.orderBy("path")) - 1).alias("r"), F.count("*").over(w).alias("n"))
    goals = ranked.select("repo", "ext", F.col("r").alias("g"), F.col("path").alias("goal"))
    p = ranked.withColumn("g", (F.col("r") + 7) % F.col("n")).join(goals, ["repo", "ext", "g"])
    stem, own, goal_dir = F.regexp_replace("goal", r"\.[^.]*$", ""), P.dirname("path"), P.dirname("goal")
    up, at = F.size(F.split(own, "/")), lambda n, *v: F.element_at(F.array(*v), (F.col("r") % n + 1).cast("int"))
    go = at(3, F.concat(F.lit("example.test/all/"), goal_dir), F.concat(F.lit("example.test/other/"), goal_dir), F.lit("fmt"))
    py = at(4, F.translate(stem, "/", "."), F.concat(F.repeat(F.lit("."), up + 1), F.translate(stem, "/", ".")), F.translate(goal_dir, "/", "."), F.lit("os.path"))
    js = at(4, F.concat(F.lit("./"), F.repeat(F.lit("../"), up), stem), F.concat(F.lit("."), F.repeat(F.lit("/.."), up), F.lit("/"), "goal"), F.concat(F.lit("./../"), P.basename(own), F.lit("/nowhere")), F.lit("react"))
    return p.select("path", F.when(F.col("ext") == "go", go).when(F.col("ext") == "py", py).otherwise(js).alias("imported"))


@query(f"""WITH {_WRITTEN},
aimed AS (SELECT path, imported, d, CASE WHEN path LIKE '%.go' THEN CASE WHEN starts_with(imported, 'example.test/all/') THEN substr(imported, 18) END
  WHEN path LIKE '%.py' THEN CASE WHEN starts_with(imported, '.') THEN replace(ltrim(imported, '.'), '.', '/') ELSE replace(imported, '.', '/') END
  WHEN starts_with(imported, '.') THEN CASE r % 4 WHEN 2 THEN d || '/nowhere' ELSE regexp_replace(imported, '^[./]*', '') END END AS t FROM written),
by_dir AS (SELECT a.*, tr.directory AS whole FROM aimed a LEFT JOIN tree tr ON tr.directory = a.t),
tries AS (SELECT DISTINCT t, t || e AS f FROM aimed, (SELECT unnest(['', '.go', '.py', '.js', '.jsx', '.ts', '.tsx']) AS e) WHERE t IS NOT NULL),
by_file AS (SELECT DISTINCT t, regexp_replace(f, '/[^/]*$', '') AS part FROM tries JOIN files ON files.path = f)
SELECT path, imported, coalesce(whole, part) AS target_dir FROM by_dir LEFT JOIN by_file USING (t)""")
def local_targets(spark, d):
    """The directory that each import names: itself, or that of the file it names with or without an extension; null where neither exists."""
    w = _written(spark, d)
    w = w.withColumn("target", F.nullif(imports.target_path(F.col("path"), F.col("imported"), F.lit("example.test/all")), F.lit("")))
    return imports.resolve(w, table(spark, d, "structural_files")).select("path", "imported", "target_dir")


@query(f"""WITH {_FILES} SELECT path, lower(regexp_extract(path, '[^./]\\.([^./]+)$', 1)) AS extension,
  lower(regexp_extract(path, '[^./]\\.([^./]+)$', 1)) IN ({', '.join(repr(e) for e in P.CODE_EXTENSIONS)}) AS code,
  lower(regexp_extract(path, '[^./]\\.([^./]+)$', 1)) IN ({', '.join(repr(e) for e in P.TEXT_EXTENSIONS)}) AS text
FROM files WHERE NOT list_bool_or(list_transform(string_split(path, '/'), lambda s: starts_with(s, '.') OR s IN ({', '.join(repr(e) for e in P.SKIP_DIRS)})))""")
def inventory_filter(spark, d):
    ext = P.extension("path")
    return _paths(spark, d).where(P.visible("path")).select("path", ext.alias("extension"), ext.isin(*P.CODE_EXTENSIONS).alias("code"), ext.isin(*P.TEXT_EXTENSIONS).alias("text"))


@query(f"""WITH {_FILES} SELECT count(*) FILTER (path = 'lantern-loom/api' OR (path >= 'lantern-loom/api/' AND path < 'lantern-loom/api0')) AS boundary,
count(*) FILTER (starts_with(path, 'lantern-loom/a')) AS raw, count(*) FILTER (path = 'lantern-loom' OR starts_with(path, 'lantern-loom/')) AS subtree FROM files""")
def prefix_boundary(spark, d):
    hit = lambda c: F.count(F.when(c, 1))
    return _paths(spark, d).agg(hit(P.under("path", "lantern-loom/api")).alias("boundary"), hit(F.col("path").startswith("lantern-loom/a")).alias("raw"), hit(P.selected("path", "lantern-loom/")).alias("subtree"))


@query(f"WITH {_EDGES} SELECT source, target, count FROM edges")
def edges_count(spark, d):
    return _edges(spark, d)


_SCOPED = f"""{_EDGES},
common AS (SELECT source, target, count, string_split(source, '/') AS a, string_split(target, '/') AS b,
  (SELECT count(*) FROM range(1, least(len(string_split(source, '/')), len(string_split(target, '/'))) + 1) r(i)
   WHERE string_split(source, '/')[1:r.i] = string_split(target, '/')[1:r.i]) AS n FROM edges),
lifted AS (SELECT array_to_string(a[1:n], '/') AS scope,
  CASE WHEN len(a) = n THEN 'scope:' || array_to_string(a[1:n], '/') ELSE array_to_string(a[1:n + 1], '/') END AS source,
  CASE WHEN len(b) = n THEN 'scope:' || array_to_string(a[1:n], '/') ELSE array_to_string(b[1:n + 1], '/') END AS target, count FROM common),
scoped AS (SELECT scope, source, target, CAST(sum(count) AS BIGINT) AS count FROM lifted WHERE source <> target GROUP BY scope, source, target)"""


@query(f"WITH {_SCOPED} SELECT scope, source, target, count FROM scoped")
def scope_edges(spark, d):
    return rollup.scope_edges(_edges(spark, d))


@query(f"""WITH {_EDGES} SELECT node, CAST(sum(i) AS BIGINT) AS incoming, CAST(sum(o) AS BIGINT) AS outgoing
FROM (SELECT source AS node, 0 AS i, count AS o FROM edges UNION ALL SELECT target, count, 0 FROM edges) GROUP BY node""")
def degree_metrics(spark, d):
    return rollup.degrees(_edges(spark, d))


_CAT = "CASE lower(dir) " + " ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in rollup.CATEGORY.items()) + " ELSE dir END"
_CAT_ROLE = "CASE lower(dir) " + " ".join(f"WHEN '{k}' THEN '{v[1]}'" for k, v in rollup.CATEGORY.items()) + " ELSE 'other' END"
# the largest repository as a tree of its own; none of its directories is one that would be opened up
_SYSTEM = f"""{_EDGES}, big AS (SELECT split_part(path, '/', 1) AS repo FROM files GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
inner_dirs AS (SELECT split_part(path, '/', 2) AS dir, count(*) AS n FROM files, big WHERE starts_with(path, repo || '/') AND len(string_split(path, '/')) > 2 GROUP BY 1),
grouped AS (SELECT {_CAT} AS name, {_CAT_ROLE} AS role, CAST(sum(n) AS BIGINT) AS files, list(dir) AS dirs FROM inner_dirs GROUP BY 1, 2),
numbered AS (SELECT *, row_number() OVER (ORDER BY files DESC, name) AS r, count(*) OVER () AS n FROM grouped),
placed AS (SELECT CASE WHEN n > 12 AND r >= 12 THEN 'Other components' ELSE name END AS name, CASE WHEN n > 12 AND r >= 12 THEN 'other' ELSE role END AS role, files, dirs FROM numbered),
final AS (SELECT name, role, CAST(sum(files) AS BIGINT) AS files, list_sort(flatten(list(dirs))) AS dirs FROM placed GROUP BY name, role)"""


def _largest(spark, d) -> str:
    return _paths(spark, d).groupBy(F.substring_index("path", "/", 1).alias("repo")).count().orderBy(F.desc("count"), "repo").first().repo


def _within(df, column, repo):
    """The column relative to a repository, rows outside dropped."""
    return df.where(F.col(column).startswith(repo + "/")).withColumn(column, F.expr(f"substring({column}, {len(repo) + 2})"))


_PRIORITY = "CASE lower(list_last(string_split(dir, '/'))) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in rollup.PRIORITY.items()) + " ELSE 4 END"


@query(f"""WITH {_TREE}, kids AS (SELECT split_part(path, '/', 1) AS repo, len(string_split(path, '/')) AS n FROM files),
inner_dirs AS (SELECT 'src/' || repo AS dir, count(*) AS n FROM kids WHERE n > 1 GROUP BY 1),
ranked AS (SELECT dir, n, row_number() OVER (ORDER BY {_PRIORITY}, n DESC, dir) AS r FROM inner_dirs),
groups AS (SELECT CASE WHEN r <= 4 THEN dir ELSE 'Shared src components' END AS name, n, dir FROM ranked
  UNION ALL SELECT 'Shared src components', count(*), 'src' FROM kids WHERE n = 1 HAVING count(*) > 0)
SELECT name, 'runtime' AS role, 1 AS layer, CAST(sum(n) AS BIGINT) AS files, string_agg(dir, ',' ORDER BY dir) AS paths FROM groups GROUP BY name""")
def system_opened(spark, d):
    """All repositories below one source directory: its first four children stand alone, the rest share a group."""
    groups, _ = rollup.system_partition(_paths(spark, d).select(F.concat(F.lit("src/"), "path").alias("path")))
    return groups.withColumn("paths", F.array_join("paths", ","))


@query(f"WITH {_SYSTEM} SELECT name, role, CASE role WHEN 'documentation' THEN 3 WHEN 'examples' THEN 3 ELSE 2 END AS layer, files, array_to_string(dirs, ',') AS paths FROM final")
def system_partition(spark, d):
    groups, _ = rollup.system_partition(_within(_paths(spark, d), "path", _largest(spark, d)))
    return groups.withColumn("paths", F.array_join("paths", ","))


@query(f"""WITH {_SYSTEM}, own AS (SELECT unnest(dirs) AS dir, name FROM final),
inside AS (SELECT split_part(source, '/', 2) AS s, split_part(target, '/', 2) AS t, count FROM edges, big WHERE starts_with(source, repo || '/') AND starts_with(target, repo || '/'))
SELECT a.name AS source, b.name AS target, CAST(sum(count) AS BIGINT) AS count FROM inside JOIN own a ON a.dir = s JOIN own b ON b.dir = t WHERE a.name <> b.name GROUP BY 1, 2""")
def system_edges(spark, d):
    repo = _largest(spark, d)
    _, owners = rollup.system_partition(_within(_paths(spark, d), "path", repo))
    return rollup.system_edges(_within(_within(_edges(spark, d), "source", repo), "target", repo), owners)


@query(f"""WITH {_EDGES}, top AS (SELECT directory, files FROM tree WHERE directory <> '' AND directory NOT LIKE '%/%' ORDER BY files DESC, directory LIMIT 23)
SELECT row_number() OVER (ORDER BY files DESC, directory) AS node, substr(regexp_replace(directory, '[^A-Za-z0-9_./ -]', '_', 'g'), 1, 60) AS label, files FROM top""")
def mermaid_nodes(spark, d):
    top = rollup.tree_counts(_paths(spark, d)).where("directory <> '' and not directory like '%/%'").orderBy(F.desc("files"), "directory").limit(23)
    return top.select(F.row_number().over(Window.orderBy(F.desc("files"), "directory")).cast("bigint").alias("node"), X.mermaid_label("directory").alias("label"), "files")


@query("""SELECT s_suppkey, CASE WHEN regexp_matches(cell, '^[\\s]*[=+\\-@]') THEN '''' || cell ELSE cell END AS cell
FROM (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN '=' WHEN 1 THEN '-' WHEN 2 THEN '@' ELSE '' END || s_name AS cell FROM supplier)""")
def csv_guard(spark, d):
    sign = F.element_at(F.array(F.lit("="), F.lit("-"), F.lit("@"), F.lit("")), (F.col("s_suppkey") % 4 + 1).cast("int"))
    return table(spark, d, "supplier").select("s_suppkey", X.csv_guard(F.concat(sign, "s_name")).alias("cell"))


# Text


@query("""WITH t AS (SELECT unnest(list_filter(string_split(lower(replace(%s, '_', ' ')), ' '), lambda x: x <> '')) AS term FROM documents WHERE text IS NOT NULL)
SELECT term, count(*) AS n FROM t GROUP BY term""" % _WORDS.format(t="text"))
def words_tokens(spark, d):
    t = table(spark, d, "documents").where("text is not null").select(F.explode(X.terms("text")).alias("term"))
    return t.groupBy("term").agg(F.count("*").alias("n"))


@query("""WITH b AS (SELECT id, path, body, string_split(regexp_replace(body, '\\r\\n?', chr(10), 'g'), chr(10)) AS ls,
  lower(regexp_extract(path, '[^./]\\.([^./]+)$', 1)) IN ('md', 'markdown', 'mdx', 'rst', 'txt') AS prose FROM docs),
k AS (SELECT id, i, 'L' || i || ': ' || regexp_replace(substr(s, 1, 180), '%s', '[redacted]', 'g') AS line FROM
  (SELECT id, prose, i, trim(translate(ls[i], chr(9) || chr(12) || chr(11), '   ')) AS s FROM (SELECT id, prose, ls, unnest(range(1, len(ls) + 1)) AS i FROM b WHERE body IS NOT NULL AND NOT contains(body, 'PRIVATE KEY-----')))
  WHERE s <> '' AND NOT regexp_matches(s, '(?i)copyright|spdx|licensed under|permission is hereby')
    AND (prose OR regexp_matches(s, '%s'))),
c AS (SELECT id, i, line, coalesce(sum(length(line)) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM k),
g AS (SELECT id, string_agg(line, chr(10) ORDER BY i) AS ls FROM c WHERE n < 1400 GROUP BY id)
SELECT b.id, CASE WHEN body IS NULL THEN NULL WHEN contains(body, 'PRIVATE KEY-----') THEN '' ELSE replace(%s, '_', ' ') || chr(10) || coalesce(g.ls, '') END AS synopsis
FROM b LEFT JOIN g USING (id)""" % (X.SECRET, X.DECLARATION.replace("'", "''"), _WORDS.format(t="path")))
def synopsis(spark, d):
    return table(spark, d, "docs").select("id", X.synopsis("path", "body").alias("synopsis"))


@query(f"""SELECT id, contains(body, 'PRIVATE KEY-----') AS private_key, len(regexp_extract_all(body, '{X.SECRET}')) AS secrets, sha256(regexp_replace(body, '{X.SECRET}', '[redacted]', 'g')) AS redacted
FROM docs WHERE body IS NOT NULL AND regexp_matches(body, '{X.SECRET}|PRIVATE KEY-----')""")
def redact(spark, d):
    docs = table(spark, d, "docs").where(F.col("body").rlike(f"{X.SECRET}|PRIVATE KEY-----"))
    n = F.size(F.regexp_extract_all("body", F.lit(X.SECRET), F.lit(0))).cast("bigint")
    return docs.select("id", F.col("body").contains(X.PRIVATE_KEY).alias("private_key"), n.alias("secrets"), F.sha2(X.redact("body"), 256).alias("redacted"))


@query("SELECT doc_id, substr(text, 1, 256) AS excerpt, length(text) > 256 AS truncated FROM documents WHERE text IS NOT NULL")
def source_excerpt(spark, d):
    cut, more = X.clipped("text")
    return table(spark, d, "documents").where("text is not null").select("doc_id", cut.alias("excerpt"), more.alias("truncated"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


_GO_LAST = "CASE WHEN contains(stem, '_') THEN list_last(string_split(stem, '_')) END"


@query(f"""WITH {_FILES}, n AS (SELECT path, list_last(string_split(path, '/')) AS name, split_part(list_last(string_split(path, '/')), '.', 1) AS stem FROM files)
SELECT path, CASE WHEN starts_with(name, '_') OR starts_with(name, '.') THEN 'ignored_filename' WHEN NOT ends_with(name, '.go') THEN 'not_go_source'
WHEN ends_with(name, '_test.go') THEN 'test_file' WHEN {_GO_LAST} IN ({', '.join(repr(x) for x in (*P.GO_OS, *P.GO_ARCH))}) THEN 'platform_variant' ELSE 'neutral' END AS class FROM n""")
def go_filename_class(spark, d):
    return _paths(spark, d).select("path", P.go_filename_class("path").alias("class"))


@query("""WITH ls AS (SELECT id, path, string_split(body, chr(10)) AS l FROM docs WHERE body IS NOT NULL),
py AS (SELECT id, i, regexp_extract(l[i], '^\\s*(?:from\\s+([.\\w]+)\\s+import|import\\s+([\\w.]+))', 1) AS a, regexp_extract(l[i], '^\\s*(?:from\\s+([.\\w]+)\\s+import|import\\s+([\\w.]+))', 2) AS b
  FROM (SELECT id, l, unnest(range(1, len(l) + 1)) AS i FROM ls WHERE path LIKE '%.py')),
pys AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS ordinal, CASE WHEN a <> '' THEN a ELSE b END AS module FROM py WHERE a <> '' OR b <> ''),
jsl AS (SELECT id, regexp_extract_all(body, '(?:\\bfrom\\s*|\\bimport\\s*\\(|\\brequire\\s*\\()\\s*[''"]([^''"]+)[''"]', 1) AS m FROM docs WHERE body IS NOT NULL AND regexp_matches(path, '\\.(js|ts)$')),
js AS (SELECT id, i - 1 AS ordinal, m[i] AS module FROM (SELECT id, m, unnest(range(1, len(m) + 1)) AS i FROM jsl)),
gl AS (SELECT id, i, trim(translate(l[i], chr(9) || chr(13), '  ')) AS s FROM (SELECT id, l, unnest(range(1, len(l) + 1)) AS i FROM ls WHERE path LIKE '%.go')),
gm AS (SELECT id, i, s, CASE WHEN starts_with(s, 'import (') THEN 1 WHEN s = ')' THEN 0 END AS mark FROM gl),
gb AS (SELECT id, i, s, mark, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS blk FROM gm),
gq AS (SELECT id, i, regexp_extract(split_part(s, '//', 1), '"([^"\\n]+)"', 1) AS q FROM gb WHERE NOT starts_with(s, 'import (') AND NOT (blk = 1 AND s = ')') AND (blk = 1 OR starts_with(s, 'import '))),
go AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS ordinal, q AS module FROM gq WHERE q <> '')
SELECT id, ordinal, module FROM pys UNION ALL SELECT id, ordinal, module FROM js UNION ALL SELECT id, ordinal, module FROM go""")
def import_statements(spark, d):
    docs = table(spark, d, "docs")
    tagged = docs.select("path", F.concat_ws(":", F.col("id").cast("string"), "path").alias("key"), "body")
    got = imports.statements(tagged, "key")
    return got.select(F.substring_index("path", ":", 1).cast("bigint").alias("id"), F.col("ordinal").cast("bigint").alias("ordinal"), "module")


# Retrieval

_QUESTION = "Which routine decides how the pending cursor repairs a frozen ledger batch"
_ASKED = X.query_terms(_QUESTION)


def _bm25_sql(source: str, ident: str, text: str, where: str) -> str:
    return f"""tok AS (SELECT {ident} AS id, list_filter(string_split(lower(replace({_WORDS.format(t=text)}, '_', ' ')), ' '), lambda x: x <> '') AS t FROM {source} WHERE {where}),
st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tok),
hit AS (SELECT id, len(t) AS dl, q AS term, len(list_filter(t, lambda x: x = q)) AS tf FROM tok, (SELECT unnest({_ASKED!r}) AS q)),
dfs AS (SELECT term, count(*) FILTER (tf > 0) AS df FROM hit GROUP BY term),
score AS (SELECT id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM hit JOIN dfs USING (term), st WHERE tf > 0 GROUP BY id)"""


@query(f"WITH {_bm25_sql('documents', 'doc_id', 'text', 'text IS NOT NULL')} SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM score ORDER BY score DESC, id LIMIT 50")
def bm25_topk(spark, d):
    return retrieval.top(postings.bm25(postings.index_of(spark, d, "documents", "doc_id", "text"), _QUESTION), 50).withColumn("rank", F.col("rank").cast("bigint"))


_PROBE = [((7 * i) % 13 - 6) / 10.0 for i in range(64)]
_PROBE_SQL = f"list_transform({_PROBE!r}, lambda x: x::DOUBLE)"
_COS = f"round(list_inner_product(vector::DOUBLE[], {_PROBE_SQL}) / (sqrt(list_inner_product(vector::DOUBLE[], vector::DOUBLE[])) * sqrt(list_inner_product({_PROBE_SQL}, {_PROBE_SQL}))), 6)"


@query(f"SELECT id, {_COS} AS score, row_number() OVER (ORDER BY {_COS} DESC, id DESC) AS rank FROM docs WHERE vector IS NOT NULL ORDER BY score DESC, id DESC LIMIT 50")
def cosine_topk(spark, d):
    return retrieval.top(retrieval.cosine_scores(table(spark, d, "docs"), _PROBE), 50, True).withColumn("rank", F.col("rank").cast("bigint"))


@query(f"""WITH {_bm25_sql('docs', 'id', 'terms', 'terms IS NOT NULL')},
kw AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM score ORDER BY score DESC, id LIMIT 100),
vec AS (SELECT id, {_COS} AS c, row_number() OVER (ORDER BY {_COS} DESC, id DESC) AS rank FROM docs WHERE vector IS NOT NULL ORDER BY c DESC, id DESC LIMIT 100),
fused AS (SELECT id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM (SELECT id, rank FROM kw UNION ALL SELECT id, rank FROM vec) GROUP BY id ORDER BY score DESC, id LIMIT 20)
SELECT fused.id, fused.score, round(vec.c, 4) AS similarity FROM fused LEFT JOIN vec USING (id)""")
def hybrid_rrf(spark, d):
    return retrieval.hybrid(table(spark, d, "docs"), postings.index_of(spark, d, "docs", "id", "terms"), _QUESTION, _PROBE, 20)


@query(f"""WITH {_bm25_sql('docs', 'id', 'terms', 'terms IS NOT NULL')},
kw AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM score ORDER BY score DESC, id LIMIT 60),
j AS (SELECT kw.id, rank, c FROM kw LEFT JOIN (SELECT id, {_COS} AS c FROM docs WHERE vector IS NOT NULL) USING (id))
SELECT id, rank, row_number() OVER (ORDER BY rank > 32, CASE WHEN rank <= 32 THEN -coalesce(c, -1e300) END, rank) AS position FROM j""")
def rerank_merge(spark, d):
    docs = table(spark, d, "docs")
    ranked = retrieval.top(postings.bm25(postings.index_of(spark, d, "docs", "id", "terms"), _QUESTION), 60)
    out = retrieval.rerank(ranked, retrieval.cosine_scores(docs, _PROBE))
    return out.select("id", F.col("rank").cast("bigint").alias("rank"), F.col("position").cast("bigint").alias("position"))


@query(f"""WITH {_IMPORTS}, s AS (SELECT path, start_byte AS a, end_byte + 24 AS b, ordinal FROM imp WHERE start_byte IS NOT NULL AND end_byte IS NOT NULL),
m AS (SELECT *, max(b) OVER (PARTITION BY path ORDER BY a, b DESC, ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
i AS (SELECT *, sum(CASE WHEN a >= reach OR reach IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY a, b DESC, ordinal) AS island FROM m)
SELECT path, min(a) AS start, max(b) AS "end", max(b - a) AS score, count(DISTINCT ordinal) AS members FROM i GROUP BY path, island""")
def window_islands(spark, d):
    s = _statements(spark, d).where("start_byte is not null and end_byte is not null").select("path", F.col("start_byte").alias("a"), (F.col("end_byte") + 24).alias("b"), "ordinal")
    return retrieval.islands(s.withColumn("width", F.col("b") - F.col("a")), ["path"], "a", "b", "width", "ordinal")


@query(f"WITH {_IMPORTS} SELECT path, ordinal, name, start_byte FROM imp WHERE name = 'corekit' OR list_last(string_split(name, '.')) = 'corekit'")
def exact_name_list(spark, d):
    return retrieval.exact_names(_statements(spark, d), "corekit").select("path", "ordinal", "name", "start_byte")


# Occurrences and graph

_OCC = f"""{_EDGES}, occ AS (SELECT l.path, i.start_byte AS site_start, i.end_byte AS site_end, 'reference' AS role, l.source AS caller_id, coalesce(l.target, '') AS target_id,
  l.path || ':' || l.ordinal AS site_id FROM linked l JOIN imp i USING (path, ordinal))"""


def _occurrences(spark, d) -> DataFrame:
    spans = _statements(spark, d).select("path", "ordinal", "start_byte", "end_byte")
    sites = _linked(spark, d).join(spans, ["path", "ordinal"]).select(
        "path", F.col("start_byte").alias("site_start"), F.col("end_byte").alias("site_end"), F.lit("reference").alias("role"), F.col("source").alias("caller_id"),
        F.concat_ws(":", "path", F.col("ordinal").cast("string")).alias("site_id"), F.when(F.col("target").isNotNull(), F.array("target")).alias("targets"),
    )
    return graph.occurrences(sites)


@query(f"WITH {_OCC} SELECT path, site_start, site_end, role, caller_id, target_id, site_id FROM occ")
def occurrences(spark, d):
    return _occurrences(spark, d).select("path", "site_start", "site_end", "role", "caller_id", "target_id", "site_id")


_SEED = "lantern-loom/api"


@query(f"WITH {_OCC}, most AS (SELECT caller_id FROM occ GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) SELECT site_id, caller_id, target_id FROM occ JOIN most USING (caller_id)")
def callees(spark, d):
    """All that the directory with the most imports names."""
    occ = cut(_occurrences(spark, d))
    seed = occ.groupBy("caller_id").count().orderBy(F.desc("count"), "caller_id").first().caller_id
    return graph.outgoing(occ, seed).select("site_id", "caller_id", "target_id")


@query(f"WITH {_OCC} SELECT site_id, caller_id FROM occ WHERE target_id = '{_SEED}'")
def callers(spark, d):
    return graph.incoming(_occurrences(spark, d), _SEED).select("site_id", "caller_id")


# directories cut to repository and area, so that walks take several steps
_AREA = "array_to_string(string_split({c}, '/')[1:2], '/')"
_LINKS = f"{_EDGES}, links AS (SELECT DISTINCT {_AREA.format(c='source')} AS caller_id, {_AREA.format(c='target')} AS target_id FROM edges)"


def _links(spark, d) -> DataFrame:
    two = lambda c: P.head(c, F.lit(2))
    return _edges(spark, d).select(two("source").alias("caller_id"), two("target").alias("target_id")).distinct()


def _walk_sql(a: str, b: str, steps: int) -> str:
    return f"""WITH RECURSIVE {_LINKS}, walk(node, level) AS (SELECT '{_SEED}', 0 UNION SELECT {b}, level + 1 FROM walk JOIN links ON {a} = node WHERE level < {steps}),
first AS (SELECT node, min(level) AS level FROM walk GROUP BY node)"""


@query(_walk_sql("caller_id", "target_id", 4) + " SELECT level, caller_id AS from_id, target_id AS to_id FROM links JOIN first ON caller_id = node WHERE level < 4")
def reachable(spark, d):
    return graph.walk(_links(spark, d), spark.createDataFrame([(_SEED,)], "node string"), 4).select("level", "from_id", "to_id")


@query(_walk_sql("target_id", "caller_id", 3) + " SELECT level, target_id AS from_id, caller_id AS to_id FROM links JOIN first ON target_id = node WHERE level < 3")
def impact(spark, d):
    return graph.walk(_links(spark, d), spark.createDataFrame([(_SEED,)], "node string"), 3, reverse=True).select("level", "from_id", "to_id")


@query(f"""WITH RECURSIVE {_LINKS}, area AS (SELECT DISTINCT {_AREA.format(c='directory')} AS node FROM tree WHERE starts_with(directory, 'tidewater-index/')),
walk(node, level) AS (SELECT node, 0 FROM area UNION SELECT caller_id, level + 1 FROM walk JOIN links ON target_id = node WHERE level < 2)
SELECT node, min(level) AS level FROM walk GROUP BY node""")
def impact_area(spark, d):
    area = rollup.tree_counts(_paths(spark, d)).where(P.selected("directory", "tidewater-index/")).select(P.head("directory", F.lit(2)).alias("node")).distinct()
    return graph.reached(_links(spark, d), area, 2, reverse=True)


@query(f"""WITH {_IMPORTS} SELECT path, ordinal, module FROM imp WHERE path > 'lantern-' OR (path = 'lantern-' AND ordinal > 0) ORDER BY path, ordinal LIMIT 25""")
def keyset_page(spark, d):
    return graph.after(_statements(spark, d).select("path", "ordinal", "module"), ["path", "ordinal"], ["lantern-", 0], 25)


@query(f"""WITH {_IMPORTS}, page AS (SELECT path, ordinal, module FROM imp WHERE path > 'lantern-' ORDER BY path, ordinal LIMIT 200),
seen AS (SELECT *, len(list_distinct(flatten(list([path, module]) OVER (ORDER BY path, ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)))) AS entities FROM page)
SELECT path, ordinal, entities FROM seen WHERE entities <= 50""")
def budget_page(spark, d):
    page = graph.after(_statements(spark, d).select("path", "ordinal", "module"), ["path", "ordinal"], ["lantern-", 2**31 - 1], 200)
    return graph.within_budget(page, ["path", "ordinal"], ["path", "module"], 50).select("path", "ordinal", F.col("entities").cast("bigint").alias("entities"))


@query(f"""WITH {_EDGES}, one AS (SELECT source, target FROM (SELECT {_AREA.format(c='source')} AS source, {_AREA.format(c='target')} AS target, CAST(sum(count) AS BIGINT) AS n FROM edges GROUP BY ALL) WHERE source <> target ORDER BY n DESC, source, target LIMIT 6)
SELECT source, target FROM one""")
def strongest_links(spark, d):
    two = lambda c: P.head(c, F.lit(2))
    e = _edges(spark, d).select(two("source").alias("source"), two("target").alias("target"), "count").where("source <> target").groupBy("source", "target").agg(F.sum("count").alias("n"))
    return e.orderBy(F.desc("n"), "source", "target").limit(6).select("source", "target")


@query(f"""WITH RECURSIVE {_EDGES}, e AS (SELECT source, target FROM (SELECT {_AREA.format(c='source')} AS source, {_AREA.format(c='target')} AS target, CAST(sum(count) AS BIGINT) AS n FROM edges GROUP BY ALL) WHERE source <> target ORDER BY n DESC, source, target LIMIT 6),
nodes AS (SELECT source AS node FROM e UNION SELECT target FROM e),
reach(a, b) AS (SELECT node, node FROM nodes UNION SELECT a, target FROM reach JOIN e ON b = source),
comp AS (SELECT x.a AS node, min(x.b) AS component FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY x.a),
links AS (SELECT DISTINCT s.component AS s, t.component AS t FROM e JOIN comp s ON s.node = source JOIN comp t ON t.node = target WHERE s.component <> t.component),
steps(component, layer) AS (SELECT DISTINCT component, 0 FROM comp UNION SELECT t, layer + 1 FROM steps JOIN links ON component = s),
depth AS (SELECT component, max(layer) AS layer FROM steps GROUP BY component)
SELECT node, component, layer FROM comp JOIN depth USING (component)""")
def cycle_layers(spark, d):
    e = strongest_links(spark, d)
    nodes = e.select(F.col("source").alias("node")).union(e.select("target")).distinct()
    return graph.closure_layers(e, nodes)


# Resolution


@query(f"""WITH {_TREE}, {_IMPORTS}, stem AS (SELECT regexp_replace(list_last(string_split(path, '/')), '\\.[^.]*$', '') AS name, count(*) AS n, min(path) AS p FROM files GROUP BY 1)
SELECT i.path, i.ordinal, CASE WHEN n = 1 THEN p END AS target_path, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' END AS reason FROM imp i LEFT JOIN stem USING (name)""")
def unique_match(spark, d):
    return imports.module_candidates(_statements(spark, d), table(spark, d, "structural_files")).select("path", "ordinal", "target_path", "reason")


@query(f"""WITH {_EDGES} SELECT certainty, count(*) AS n FROM (SELECT CASE WHEN target IS NULL THEN 'unresolved' WHEN path LIKE '%.go' THEN 'candidate' ELSE 'resolved' END AS certainty FROM linked) GROUP BY certainty""")
def import_certainty(spark, d):
    t = F.when(F.col("target").isNotNull(), F.array("target")).otherwise(F.array().cast("array<string>"))
    c = imports.certainty(t, F.lit(False), P.extension("path"))
    return _linked(spark, d).groupBy(c.alias("certainty")).agg(F.count("*").alias("n"))


@query(f"""WITH {_TREE}, owners AS (SELECT directory, 'team-' || length(directory) AS owner FROM tree WHERE len(string_split(directory, '/')) <= 2 AND directory <> '' AND files >= 5),
w AS (SELECT path, arg_max(owner, len(string_split(o.directory, '/'))) AS owner FROM up JOIN owners o USING (directory) GROUP BY path)
SELECT files.path, owner FROM files LEFT JOIN w USING (path)""")
def longest_prefix_owner(spark, d):
    paths = _paths(spark, d)
    owners = rollup.tree_counts(paths).where((P.depth("directory") <= 2) & (F.col("directory") != "") & (F.col("files") >= 5)).select("directory", F.concat(F.lit("team-"), F.length("directory").cast("string")).alias("owner"))
    return resolution.longest_prefix_owner(paths, "path", owners, "directory", "owner")


@query("""WITH RECURSIVE n AS (SELECT s_suppkey AS name, s_nationkey::BIGINT AS target FROM supplier),
w(name, pos, hops) AS (SELECT name, target, 1 FROM n UNION ALL SELECT w.name, n.target, hops + 1 FROM w JOIN n ON n.name = w.pos WHERE hops < 64),
e AS (SELECT name, arg_max(pos, hops) AS final, max(hops) AS hops FROM w GROUP BY name)
SELECT name, CASE WHEN hops < 64 THEN final END AS final, CASE WHEN hops < 64 THEN hops END AS hops, CASE WHEN hops >= 64 THEN 'cycle' END AS reason FROM e""")
def alias_chain(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("name"), F.col("s_nationkey").cast("bigint").alias("target"))
    return resolution.follow_aliases(s)


@query("""SELECT key, min(kind) AS kind FROM (SELECT CAST(c_custkey AS VARCHAR) AS key, 'customer' AS kind FROM customer UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 'supplier' FROM supplier UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'part' FROM part)
GROUP BY key HAVING count(*) = 1""")
def typed_probe_union(spark, d):
    return resolution.single_probe(("customer", table(spark, d, "customer").select("c_custkey")), ("supplier", table(spark, d, "supplier").select("s_suppkey")), ("part", table(spark, d, "part").select("p_partkey")))


# Snapshots


def _now(spark, d) -> DataFrame:
    return latest(table(spark, d, "docs").select("path", "id", "content_digest", stamp_ns("stamp").alias("stamp")), "path", ["stamp", "id"], ["content_digest"])


def _now_digest(spark, d) -> DataFrame:
    """``path, digest`` of the current rows."""
    docs = table(spark, d, "docs").select("path", "id", "digest", stamp_ns("stamp").alias("stamp"))
    return latest(docs, "path", ["stamp", "id"], ["digest"])


def _before(spark, d) -> DataFrame:
    """What all ready runs but the last knew of each path."""
    ready = table(spark, d, "catalog_runs").where("state = 'ready'").select("run_no").distinct()
    old = ready.join(ready.agg(F.max("run_no").alias("last")), F.col("run_no") < F.col("last")).select("run_no")  # one row per run
    log = table(spark, d, "catalog_log").join(F.broadcast(old), "run_no").select("path", "run_no", "log_id", "digest")
    return latest(log, "path", ["run_no", "log_id"], ["digest"]).select("path", incremental.plain_digest(F.col("digest")).alias("digest"))


_BEFORE = f"""{_CURRENT}, old AS (SELECT path, lower(regexp_replace(trim(arg_max(digest, run_no::BIGINT * 1000000000 + log_id)), '^(?i)sha-?256[:=\\s]+', '')) AS digest FROM catalog_log WHERE run_no IN (SELECT run_no FROM catalog_runs WHERE state = 'ready' AND run_no < (SELECT max(run_no) FROM catalog_runs WHERE state = 'ready')) AND path IS NOT NULL GROUP BY path),
new AS (SELECT path, digest FROM cur)"""


@query(f"""WITH {_BEFORE} SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'A' WHEN n.path IS NULL THEN 'D' ELSE 'M' END AS status
FROM old o FULL JOIN new n ON o.path = n.path WHERE o.path IS NULL OR n.path IS NULL OR o.digest IS DISTINCT FROM n.digest""")
def git_changes(spark, d):
    now = latest(table(spark, d, "docs").select("path", "id", "digest", stamp_ns("stamp").alias("stamp")), "path", ["stamp", "id"], ["digest"])
    return snapshot.changes(_before(spark, d), now, "path", "digest")


@query(f"""WITH {_BEFORE} SELECT n.path, n.digest, CASE WHEN o.path IS NULL THEN 'new' WHEN o.digest IS NOT DISTINCT FROM n.digest THEN 'reused' ELSE 'changed' END AS action,
CASE WHEN o.path IS NOT NULL AND o.digest IS NOT DISTINCT FROM n.digest THEN 'v' || length(n.path) END AS vector FROM new n LEFT JOIN old o USING (path)""")
def catalog_diff(spark, d):
    """The next catalogue: what was derived of a file stays where its digest does."""
    now = latest(table(spark, d, "docs").select("path", "id", "digest", stamp_ns("stamp").alias("stamp")), "path", ["stamp", "id"], ["digest"])
    old = _before(spark, d).withColumn("vector", F.concat(F.lit("v"), F.length("path").cast("string")))
    return snapshot.catalog(old, now, "path", "digest", ["vector"]).select("path", "digest", "action", "vector")


@query(f"""WITH {_BEFORE}, a AS (SELECT CASE WHEN n.path IS NULL THEN 'deleted' WHEN o.path IS NULL THEN 'new' WHEN o.digest IS NOT DISTINCT FROM n.digest THEN 'reused' ELSE 'changed' END AS action FROM new n FULL JOIN old o ON o.path = n.path)
SELECT action, count(*) AS files FROM a GROUP BY action""")
def catalog_counters(spark, d):
    now = latest(table(spark, d, "docs").select("path", "id", "digest", stamp_ns("stamp").alias("stamp")), "path", ["stamp", "id"], ["digest"])
    return snapshot.counters(_before(spark, d), now, "path", "digest")


@query(f"""WITH {_EDGES}, {_BEFORE},
had AS (SELECT DISTINCT {_AREA.format(c=_DIR)} AS key FROM old), has AS (SELECT DISTINCT {_AREA.format(c=_DIR)} AS key FROM new),
dep AS (SELECT DISTINCT path, {_AREA.format(c='module')} AS key FROM imp WHERE path LIKE '%.go')
SELECT path, CASE WHEN had.key IS NULL THEN 'appeared' ELSE 'disappeared' END AS cause FROM dep LEFT JOIN had USING (key) LEFT JOIN has USING (key)
WHERE (had.key IS NULL) <> (has.key IS NULL) GROUP BY ALL""")
def negative_lookup_dirty(spark, d):
    """Importers whose looked-up area was absent before and is present now, or the reverse."""
    area = lambda p: P.head(P.dirname(p), F.lit(2))
    had = _before(spark, d).select(area("path").alias("key")).distinct().select("key", F.lit(True).alias("present"))
    has = _now(spark, d).select(area("path").alias("key")).distinct().select(F.lit("area").alias("kind"), "key", F.lit("here").alias("fingerprint"))
    dep = _statements(spark, d).where(P.extension("path") == "go").select("path", P.head("module", F.lit(2)).alias("key")).distinct()
    dep = dep.join(had, "key", "left").select("path", F.lit("area").alias("kind"), "key", F.lit("here").alias("fingerprint"), F.coalesce("present", F.lit(False)).alias("present"))
    none = dep.select("path", F.lit(False).alias("changed")).limit(0)
    return snapshot.dirty(none, dep, has)


@query(f"""WITH {_FILES}, s AS (SELECT DISTINCT path, coalesce(sha256, '') AS h FROM structural_files WHERE path IS NOT NULL)
SELECT {_DIR} AS directory, sha256(string_agg(path || ' ' || h, chr(10) ORDER BY path, h)) AS fingerprint, count(*) AS items FROM s GROUP BY 1""")
def identity_hash(spark, d):
    s = table(spark, d, "structural_files").where("path is not null").select("path", F.coalesce("sha256", F.lit("")).alias("h")).distinct()
    f = ids.fingerprint(s.withColumn("directory", P.dirname("path")), ["directory"], F.concat_ws(" ", "path", "h"), F.struct("path", "h"))
    return f.select("directory", "fingerprint", F.col("items").cast("bigint").alias("items"))


@query("SELECT 'file:' || sha256(path) AS id, count(*) AS n FROM docs WHERE path IS NOT NULL GROUP BY path")
def file_ids(spark, d):
    return table(spark, d, "docs").where("path is not null").groupBy("path").agg(F.count("*").alias("n")).select(ids.typed_id("file", F.col("path")).alias("id"), "n")


# Coverage and evaluation


@query("SELECT coalesce(language, '(unknown)') AS language, coalesce(status, '(none)') AS status, count(*) AS files FROM structural_files GROUP BY 1, 2")
def coverage_by_language(spark, d):
    return coverage.by_language(table(spark, d, "structural_files"))


@query("""WITH n AS (SELECT count(DISTINCT path) AS n, count(*) AS rows FROM structural_files)
SELECT rule, n AS expected, actual FROM n, (SELECT 'languages' AS rule, rows AS actual FROM n UNION ALL SELECT 'kinds', rows FROM n UNION ALL SELECT 'paths', n FROM n) WHERE n <> actual""")
def coverage_violations(spark, d):
    """Rows counted by language and by kind against the number of paths: repeated and stale rows make them differ, distinct paths don't."""
    files = table(spark, d, "structural_files")
    paths = _paths(spark, d).agg(F.count("*").alias("k"))
    return coverage.violations(files.agg(F.count_distinct("path").alias("n")), ("languages", coverage.by_language(files), "files"), ("kinds", coverage.cross_counts(files, "kind", "status"), "count"), ("paths", paths, "k")).select("rule", "expected", "actual")


@query("SELECT kind, status, count(*) AS count FROM structural_files GROUP BY kind, status")
def kind_by_status(spark, d):
    return coverage.cross_counts(table(spark, d, "structural_files"), "kind", "status")


@query("SELECT count(*) AS documents, count(vector) AS vectors, CASE WHEN count(vector) = 0 THEN 'not_indexed' WHEN count(vector) = count(*) THEN 'ready' ELSE 'stale' END AS state FROM docs")
def index_state(spark, d):
    return snapshot.index_state(table(spark, d, "docs"))


@query("""WITH s AS (SELECT l_returnflag, list_sort(list(l_extendedprice)) AS xs, count(l_extendedprice) AS n, percentile_disc(0.95) WITHIN GROUP (ORDER BY l_extendedprice) AS b FROM lineitem GROUP BY 1)
SELECT l_returnflag, xs[CAST(floor(0.95 * (n - 1)) AS INT) + 1] AS p95_floor, b AS p95_ceil FROM s""")
def percentiles(spark, d):
    return evaluation.ranked_values(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", p95_floor=evaluation.p95_floor, p95_ceil=evaluation.p95_ceil)


@query(f"""WITH {_IMPORTS}, {_CURRENT}, gold AS (SELECT path, module, count(*) AS g FROM imp WHERE path LIKE '%.py' GROUP BY ALL),
ls AS (SELECT path, unnest(string_split(body, chr(10))) AS l FROM cur WHERE body IS NOT NULL AND path LIKE '%.py'),
a AS (SELECT path, module, count(*) AS a FROM (SELECT path, CASE WHEN regexp_extract(l, '^\\s*(?:from\\s+([.\\w]+)\\s+import|import\\s+([\\w.]+))', 1) <> '' THEN regexp_extract(l, '^\\s*(?:from\\s+([.\\w]+)\\s+import|import\\s+([\\w.]+))', 1) ELSE regexp_extract(l, '^\\s*(?:from\\s+([.\\w]+)\\s+import|import\\s+([\\w.]+))', 2) END AS module FROM ls) WHERE module <> '' GROUP BY ALL)
SELECT CASE WHEN a IS NULL THEN 'missing' WHEN g IS NULL THEN 'unexpected' WHEN g > 1 OR a > 1 THEN 'repeated' ELSE 'matched' END AS verdict, count(*) AS rows FROM gold FULL JOIN a USING (path, module) GROUP BY 1""")
def exact_grade(spark, d):
    """Extracted Python imports of current bodies against the recorded ones."""
    docs = table(spark, d, "docs").where(P.extension("path") == "py")
    found = imports.statements(docs.select(F.concat_ws(":", F.col("id").cast("string"), "path").alias("key"), "body"), "key").select(F.substring_index("path", ":", 1).cast("bigint").alias("id"), "module")
    now = latest(docs.select("path", "id", stamp_ns("stamp").alias("stamp"), F.col("id").alias("keep")), "path", ["stamp", "id"], ["keep"]).select("path", F.col("keep").alias("id"))
    actual = found.join(now, "id").select("path", "module")
    gold = _statements(spark, d).where(P.extension("path") == "py").select("path", "module")
    return evaluation.grade(gold, actual, ["path", "module"])


_TERMS = "list_filter(string_split(lower(replace(%s, '_', ' ')), ' '), lambda x: x <> '')"
_FIVE = "list_distinct(list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i + 4], ' ')))"


def _five(column: str):
    """Runs of five words, each once."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(column) - 4, F.lit(0))), lambda i: F.when(i > 0, F.array_join(F.slice(column, i, F.lit(5)), " "))))


@query(f"""WITH qt AS (SELECT item_id, {_TERMS % _WORDS.format(t='text')} AS t FROM eval_items), dt AS (SELECT doc_id, {_TERMS % _WORDS.format(t='text')} AS t FROM documents WHERE text IS NOT NULL),
pw AS (SELECT item_id, unnest({_FIVE}) AS w FROM qt), dw AS (SELECT doc_id, unnest({_FIVE}) AS w FROM dt),
s AS (SELECT item_id, doc_id, count(*) AS score FROM pw JOIN dw USING (w) GROUP BY ALL),
r AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 10),
j AS (SELECT r.item_id, rank, contains(d.text, substr(e.text, 1, 40)) AS relevant FROM r JOIN documents d USING (doc_id) JOIN eval_items e USING (item_id)),
f AS (SELECT item_id, min(rank) FILTER (relevant) AS m FROM j GROUP BY 1)
SELECT count(*) AS queries, round(avg(CASE WHEN m <= 5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit_at_5, round(avg(CASE WHEN m <= 10 THEN 1.0::DOUBLE / m ELSE 0 END), 6) AS mrr_at_10 FROM f""")
def hit_mrr(spark, d):
    """Ten documents with the most shared runs of five words per evaluation item; relevant is a document that holds the item's opening."""
    items = table(spark, d, "eval_items")
    docs = table(spark, d, "documents").where("text is not null")
    pw = F.broadcast(items.select("item_id", X.terms("text").alias("t")).select("item_id", F.explode(_five("t")).alias("w")).where("w is not null"))  # fixed evaluation set
    dw = docs.select("doc_id", X.terms("text").alias("t")).select("doc_id", F.explode(_five("t")).alias("w")).where("w is not null")
    s = dw.join(pw, "w").groupBy("item_id", "doc_id").agg(F.count("*").alias("score"))
    r = s.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))).where("rank <= 10")
    heads = F.broadcast(items.select("item_id", F.substring("text", 1, 40).alias("opening")))
    j = docs.select("doc_id", "text").join(F.broadcast(r), "doc_id").join(heads, "item_id").select(F.col("item_id").alias("query"), "rank", F.col("text").contains(F.col("opening")).alias("relevant"))  # ten rows per item
    return evaluation.retrieval_quality(j)


@query("SELECT s AS slot, p AS position, (s + p) % 7 AS question, CASE WHEN (s + p) % 2 = 0 THEN 'a' ELSE 'b' END AS condition FROM range(12) t(s), range(7) u(p)")
def allocation(spark, d):
    return evaluation.allocation(spark, 7, 12)


@query("""WITH g AS (SELECT i, list_transform(range(0, 16), lambda j: ((i * 31 + j * 17) % 101 - 50)::DOUBLE) AS v FROM range(2000) t(i)), u AS (SELECT i, unnest(range(1, 17)) AS p, v FROM g)
SELECT i AS id, p - 1 AS place, round(v[p] / sqrt(list_inner_product(v, v)), 6) AS value FROM u WHERE list_inner_product(v, v) > 0""")
def synthetic_scale(spark, d):
    v = evaluation.synthetic_vectors(spark, 2000, 16)
    return v.select("id", F.posexplode("vector").alias("place", "value")).select("id", F.col("place").cast("bigint").alias("place"), F.round("value", 6).alias("value"))


# Code facts, bytes, streams


def _current_files(spark, d) -> DataFrame:
    """Current, readable rows; stale rows are found on narrow columns and taken out by an anti-join, so no text is aggregated."""
    docs = table(spark, d, "docs")
    narrow = docs.where("path is not null").select("path", "id", stamp_ns("stamp").alias("stamp"))
    keep = latest(narrow.withColumn("keep", F.col("id")), "path", ["stamp", "id"], ["keep"]).select(F.col("keep").alias("id"))
    stale = narrow.select("id").join(keep, "id", "left_anti")
    return docs.select("id", "path", "body").join(stale, "id", "left_anti").where("path is not null and body is not null").select("path", "body")


@query()
def fact_symbols(spark, d):
    s = facts.symbols(facts.collect(_current_files(spark, d)))
    return s.groupBy(P.extension("path").alias("extension"), "kind", "callable").agg(F.count("*").alias("n"))


@query()
def fact_sites(spark, d):
    r = facts.resolve(facts.collect(_current_files(spark, d)))
    return r.groupBy(P.extension("path").alias("extension"), "role", "certainty", "reason").agg(F.count("*").alias("n"))


@query()
def byte_windows(spark, d):
    return B.byte_windows(table(spark, d, "docs"), "id", "body")


@query()
def byte_excerpts(spark, d):
    return B.excerpts(table(spark, d, "documents"), "doc_id", "text", 900)


@query(f"WITH {_CURRENT} SELECT path, digest FROM cur")
def stream_latest_state(spark, d):
    return refresh.latest_state(spark, d).select("path", "digest")
