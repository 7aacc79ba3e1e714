"""Registered queries of the operators that work on declared facts, and their SQL.

The inputs are made in the query from whole driver tables, so every rule is met
by many rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import bytes as B
from ..functions import ids
from ..functions import names as N
from ..functions import paths as P
from ..functions import text as X
from ..operators import answers, contracts, coverage, evaluation, evidence, facts, golang, graph, imports, resolution, rollup, snapshot
from ..operators import impact as impacts
from ..sources import generations, sinks, xmlconfig
from ..sources.pointers import fresh
from ..sources.shared import shared_folder
from ..sources.tables import table
from .queries import _BEFORE, _CURRENT, _DIR, _EDGES, _FILES, _IMPORTS, _TREE, _UP, _before, _edges, _largest, _linked, _now_digest, _paths, _statements, _within

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Names and texts


@query("""SELECT path, 'snapshots/' || sha256(split_part(path, '/', 1) || chr(10) || coalesce(sha256, '')) || '/' || path AS snapshot, path AS physical
FROM (SELECT DISTINCT path, sha256 FROM structural_files WHERE path IS NOT NULL)""")
def snapshot_paths(spark, d):
    f = table(spark, d, "structural_files").where("path is not null").select("path", "sha256").distinct()
    s = f.select("path", N.snapshot_path(F.substring_index("path", "/", 1), F.coalesce("sha256", F.lit("")), "path").alias("snapshot"))
    return s.select("path", "snapshot", N.physical_path("snapshot").alias("physical"))


_VERSION = "'v' || (p_partkey % 4) || '.' || (p_partkey % 12) || '.' || (p_partkey % 7) || CASE p_partkey % 5 WHEN 0 THEN '-rc.' || (p_partkey % 3) WHEN 1 THEN '-0.20240101120000-0123456789ab' WHEN 2 THEN '+incompatible' WHEN 3 THEN '.9' ELSE '' END"


@query(f"""WITH v AS (SELECT p_partkey, {_VERSION} AS version, 'example.test/m' || CASE WHEN p_partkey % 6 < 3 THEN '/v' || (p_partkey % 4) ELSE '' END AS module FROM part)
SELECT p_partkey, CASE WHEN version NOT LIKE '%.9' THEN (p_partkey % 4) END AS major, CASE WHEN version NOT LIKE '%.9' THEN p_partkey % 5 = 1 END AS pseudo,
CASE WHEN version NOT LIKE '%.9' THEN CASE WHEN p_partkey % 4 < 2 THEN p_partkey % 6 >= 3 ELSE p_partkey % 6 < 3 OR p_partkey % 5 = 2 END END AS agrees FROM v""")
def module_versions(spark, d):
    p = table(spark, d, "part").withColumn("version", F.expr(_VERSION)).withColumn("module", F.expr("'example.test/m' || CASE WHEN p_partkey % 6 < 3 THEN '/v' || (p_partkey % 4) ELSE '' END"))
    return p.select("p_partkey", N.version("version")["major"].alias("major"), N.version("version")["pseudo"].alias("pseudo"), N.major_agrees("module", "version").alias("agrees"))


@query("""SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN s_name || chr(10) || 'x"' WHEN 1 THEN s_name || '\\' END AS value FROM supplier""")
def string_literals(spark, d):
    source = F.expr(r"""CASE s_suppkey % 4 WHEN 0 THEN concat('"', s_name, '\\nx\\""') WHEN 1 THEN concat("'", s_name, "\\\\'") WHEN 2 THEN concat('f"', s_name, '"') ELSE concat('"', s_name) END""")
    return table(spark, d, "supplier").withColumn("source", source).select("s_suppkey", N.string_literal("source").alias("value"))


@query("""SELECT doc_id, CASE WHEN length(t) > 60 THEN substr(t, 1, 59) || '…' ELSE t END AS label, format('{:,}', n_chars) AS n FROM (SELECT doc_id, n_chars, trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS t FROM documents)""")
def labels(spark, d):
    return table(spark, d, "documents").select("doc_id", N.label("text").alias("label"), N.grouped("n_chars").alias("n"))


@query("""SELECT id, CASE WHEN ends_with(body, chr(10)) THEN 3 + len(string_split(body, chr(10))) - 2 ELSE 3 + len(string_split(body, chr(10))) - 1 END AS end_line FROM docs WHERE body IS NOT NULL AND body <> ''""")
def end_lines(spark, d):
    """The last line of a stretch that begins on line 3 and holds the whole body."""
    return table(spark, d, "docs").where("body is not null and body <> ''").select("id", X.end_line(F.lit(3), F.col("body")).cast("bigint").alias("end_line"))


@query("""SELECT n_nationkey, sha256('{"key":' || n_nationkey || ',"name":"' || n_name || '","none":null}') AS id FROM nation""")
def canonical_ids(spark, d):
    c = ids.canonical(name=F.col("n_name"), key=F.col("n_nationkey"), none=F.lit(None).cast("string"))
    return table(spark, d, "nation").select("n_nationkey", F.sha2(c, 256).alias("id"))


# Go packages, modules, scopes


_GO_PACKAGES = f"""{_FILES}, g AS (SELECT path, d, list_last(string_split(path, '/')) AS name, CASE length(path) % 11 WHEN 0 THEN NULL WHEN 1 THEN 'other' ELSE 'main' END AS package,
  CASE WHEN length(path) % 17 = 0 THEN 'cgo' END AS reason FROM files WHERE path LIKE '%.go')"""


@query(f"""WITH {_GO_PACKAGES}, n AS (SELECT *, split_part(name, '.', 1) AS stem FROM g), ok AS (SELECT * FROM n WHERE NOT (starts_with(name, '_') OR ends_with(name, '_test.go') OR (contains(stem, '_') AND list_last(string_split(stem, '_')) IN ({', '.join(repr(x) for x in (*P.GO_OS, *P.GO_ARCH))}))))
SELECT d AS directory, CASE WHEN min(reason) IS NULL AND count(*) = count(package) AND count(DISTINCT package) = 1 THEN min(package) END AS package,
CASE WHEN min(reason) IS NOT NULL THEN min(reason) WHEN count(*) > count(package) THEN 'package_unknown' WHEN count(DISTINCT package) > 1 THEN 'packages_differ' END AS reason FROM ok GROUP BY d""")
def go_packages(spark, d):
    g = _paths(spark, d).where(P.extension("path") == "go")
    n = F.length("path")
    return golang.packages(g.select("path", F.when(n % 11 == 0, F.lit(None).cast("string")).when(n % 11 == 1, "other").otherwise("main").alias("package"), F.when(n % 17 == 0, "cgo").alias("reason")))


@query(f"""WITH {_IMPORTS} SELECT {_DIR} AS directory, name, count(*) AS count, min(path) AS path FROM imp WHERE path LIKE '%.go' AND name IS NOT NULL GROUP BY 1, 2""")
def go_bindings(spark, d):
    b = _statements(spark, d).where((P.extension("path") == "go") & F.col("name").isNotNull()).select("path", "name", F.lit("definition").alias("kind"), F.col("module").alias("value"))
    return golang.package_bindings(b).select("directory", "name", "count", "path")


@query(f"""WITH {_FILES}, {_IMPORTS}, b AS (SELECT {_DIR} AS directory, name, count(*) AS n, arg_min(module, (path, module)) AS v FROM imp WHERE path LIKE '%.go' AND name IS NOT NULL GROUP BY 1, 2),
s AS (SELECT path || ':' || ordinal AS site_id, path, name FROM imp WHERE path LIKE '%.go' AND name IS NOT NULL), q AS (SELECT *, {_DIR} AS directory FROM s)
SELECT site_id, CASE WHEN length(q.directory) % 5 <> 0 AND n = 1 THEN v END AS value, CASE WHEN length(q.directory) % 5 = 0 THEN 'packages_differ' WHEN n IS NULL THEN 'unbound' WHEN n > 1 THEN 'ambiguous' END AS reason FROM q LEFT JOIN b USING (directory, name)""")
def go_package_lookup(spark, d):
    s = _statements(spark, d).where((P.extension("path") == "go") & F.col("name").isNotNull())
    b = s.select("path", "name", F.lit("definition").alias("kind"), F.col("module").alias("value"))
    q = s.select(P.dirname("path").alias("directory")).distinct().select("directory", F.when(F.length("directory") % 5 == 0, "packages_differ").alias("reason"))
    return golang.resolve_in_package(s.select(F.concat_ws(":", "path", F.col("ordinal").cast("string")).alias("site_id"), "path", "name"), b, q).select("site_id", "value", "reason")


def _modules(spark, d) -> DataFrame:
    return _paths(spark, d).select(F.substring_index("path", "/", 1).alias("module")).distinct().select(F.concat("module", F.lit("/go.mod")).alias("path"), "module")


@query(f"WITH {_FILES} SELECT path, split_part(path, '/', 1) AS module FROM files")
def governing_module(spark, d):
    return golang.module_of(_paths(spark, d), _modules(spark, d))


@query(f"""WITH {_FILES}, {_IMPORTS}, m AS (SELECT DISTINCT split_part(path, '/', 1) AS module FROM files)
SELECT i.path, i.ordinal, i.module, CASE WHEN m.module IS NOT NULL THEN i.module END AS target_dir FROM imp i LEFT JOIN m ON split_part(i.module, '/', 1) = m.module WHERE i.path LIKE '%.go'""")
def go_import_directory(spark, d):
    i = _statements(spark, d).where(P.extension("path") == "go").select("path", "ordinal", "module")
    return golang.import_directory(i, _modules(spark, d))


@query(f"""WITH {_FILES}, bound AS (SELECT d, list_last(string_split(path, '.')) AS name, count(*) AS n, min(path) AS v FROM files GROUP BY 1, 2),
asked AS (SELECT path, d, unnest(['md', 'py']) AS name FROM files), up AS (SELECT path, name, unnest({_UP.format(d='d')}) AS a FROM asked),
best AS (SELECT path, up.name, arg_max(n, length(a)) AS n, arg_max(v, length(a)) AS v FROM up JOIN bound ON a = d AND up.name = bound.name GROUP BY 1, 2)
SELECT asked.path, asked.name, CASE WHEN n = 1 THEN v END AS value, CASE WHEN n IS NULL THEN 'unbound' WHEN n > 1 THEN 'ambiguous' END AS reason FROM asked LEFT JOIN best USING (path, name)""")
def nearest_scopes(spark, d):
    """Directories as scopes: the nearest one above a file that binds a name, if it binds it once."""
    files = _paths(spark, d)
    counts = rollup.tree_counts(files).select("directory")
    # a scope's number is its directory's hash; the root of all has no parent
    number = lambda c: F.xxhash64(c)
    scopes = counts.select(F.lit("all").alias("path"), number("directory").alias("ordinal"), F.when(F.col("directory") != "", number(P.dirname("directory"))).alias("parent"))
    scopes = scopes.withColumn("ordinal", F.abs("ordinal")).withColumn("parent", F.abs("parent"))
    at = F.abs(number(P.dirname("path")))
    bindings = files.select(F.lit("all").alias("path"), at.alias("scope"), F.substring_index("path", ".", -1).alias("name"), F.col("path").alias("value"))
    sites = files.select("path", at.alias("scope"), F.explode(F.array(F.lit("md"), F.lit("py"))).alias("name")).select(F.concat_ws("|", "path", "name").alias("site_id"), F.lit("all").alias("path"), "scope", "name")
    out = resolution.nearest_binding(sites, scopes, bindings)
    return out.select(F.substring_index("site_id", "|", 1).alias("path"), "name", "value", "reason")


# Impact


_REACH = f"""{_TREE}, {_IMPORTS}, stem AS (SELECT regexp_replace(list_last(string_split(path, '/')), '\\.[^.]*$', '') AS name, count(*) AS n, min(path) AS p FROM files GROUP BY 1),
links AS (SELECT i.path AS source, CASE WHEN n = 1 THEN p END AS target, CASE WHEN n = 1 AND i.path LIKE '%.go' THEN 'candidate' WHEN n = 1 THEN 'resolved' ELSE 'unresolved' END AS certainty, i.path || ':' || i.ordinal AS site_id FROM imp i LEFT JOIN stem USING (name)),
start AS (SELECT path AS node FROM files WHERE starts_with(path, 'lantern-loom/'))"""


def _reach(spark, d) -> tuple[DataFrame, DataFrame]:
    files = _paths(spark, d)
    i = imports.module_candidates(_statements(spark, d), table(spark, d, "structural_files"))
    certainty = F.when(F.col("target_path").isNull(), "unresolved").when(P.extension("path") == "go", "candidate").otherwise("resolved")
    i = i.select(F.concat_ws(":", "path", F.col("ordinal").cast("string")).alias("site_id"), "path", "target_path", certainty.alias("certainty"))
    none = spark.createDataFrame([], "site_id string, path string, caller_id string, target_id string, certainty string")
    return impacts.links(none, i, spark.createDataFrame([], "id string, path string")), files


@query(f"""WITH RECURSIVE {_REACH}, walk(node, level) AS (SELECT node, 0 FROM start UNION SELECT source, level + 1 FROM walk JOIN links ON target = node WHERE level < 3),
first AS (SELECT node, min(level) AS level FROM walk GROUP BY node)
SELECT level, site_id, certainty, 'file:' || source AS source, 'file:' || target AS target FROM links JOIN first ON target = node WHERE level < 3""")
def impact_files(spark, d):
    """What depends on one repository's files over imports, three steps far; every link once, at its smallest level."""
    edges, files = _reach(spark, d)
    rows, _ = impacts.impact(edges, files, ["lantern-loom/"], 3)
    return rows.select("level", "site_id", "certainty", "source", "target")


@query(f"""WITH RECURSIVE {_REACH}, walk(node, level) AS (SELECT node, 0 FROM start UNION SELECT source, level + 1 FROM walk JOIN links ON target = node WHERE level < 1),
first AS (SELECT node, min(level) AS level FROM walk GROUP BY node)
SELECT reason, count(*) AS count FROM (
  SELECT 'unresolved_import' AS reason FROM links JOIN first ON source = node WHERE target IS NULL
  UNION ALL SELECT 'candidate_import' FROM links JOIN first ON source = node WHERE certainty = 'candidate'
  UNION ALL SELECT 'filtered' FROM links JOIN first ON target = node WHERE certainty = 'candidate'
  UNION ALL SELECT 'depth_limit' FROM links JOIN first ON target = node WHERE level = 1 AND certainty = 'resolved'
  UNION ALL SELECT 'area_not_in_inventory') GROUP BY reason""".replace("JOIN links ON target = node WHERE level < 1)", "JOIN links ON target = node WHERE level < 1 AND certainty = 'resolved')"))
def impact_boundaries(spark, d):
    """Why that is not known to be all: one step over resolved links only, and a file that doesn't exist."""
    edges, files = _reach(spark, d)
    _, why = impacts.impact(edges, files, ["lantern-loom/", "no/such.file"], 1, certainties=("resolved",))
    return why


@query(f"""WITH RECURSIVE {_REACH}, {_BEFORE}, changed AS (SELECT coalesce(o.path, n.path) AS path FROM old o FULL JOIN new n ON o.path = n.path WHERE o.path IS NULL OR n.path IS NULL OR o.digest IS DISTINCT FROM n.digest),
walk(node, level) AS (SELECT path, 0 FROM changed UNION SELECT source, level + 1 FROM walk JOIN links ON target = node WHERE level < 2),
first AS (SELECT node, min(level) AS level FROM walk GROUP BY node)
SELECT level, site_id, 'file:' || source AS source, 'file:' || target AS target FROM links JOIN first ON target = node WHERE level < 2""")
def impact_changes(spark, d):
    """What depends, over imports and two steps far, on the paths that changed since the run before the last."""
    edges, files = _reach(spark, d)
    changed = snapshot.changes(_before(spark, d), _now_digest(spark, d), "path", "digest")
    rows, _ = impacts.impact(edges, files, [], 2, changed=changed)
    return rows.select("level", "site_id", "source", "target")


@query(f"""WITH {_EDGES} SELECT certainty || '_import' AS reason, count(*) AS count FROM (SELECT CASE WHEN target IS NULL THEN 'unresolved' WHEN path LIKE '%.go' THEN 'candidate' ELSE 'resolved' END AS certainty FROM linked) WHERE certainty <> 'resolved' GROUP BY 1""")
def walk_boundaries(spark, d):
    t = F.when(F.col("target").isNotNull(), F.array("target")).otherwise(F.array().cast("array<string>"))
    return graph.boundaries(_linked(spark, d).select(imports.certainty(t, F.lit(False), P.extension("path")).alias("certainty"), F.lit("import").alias("relation")))


# Contracts


_PICK = "CASE WHEN o_orderkey % {m} = 0 THEN {a} ELSE {b} END"
_BINDING = {
    "id": "CAST(o_orderkey AS STRING)", "service_id": "CASE WHEN o_orderkey % 23 = 0 THEN 'svc9' ELSE concat('svc', o_custkey % 3) END", "role": "CASE o_orderkey % 5 WHEN 0 THEN 'server' WHEN 1 THEN 'consumer' WHEN 2 THEN 'producer' ELSE 'client' END",
    "contract_id": "concat('c', o_custkey)", "protocol": "CASE o_custkey % 3 WHEN 0 THEN 'http' WHEN 1 THEN 'rpc' ELSE 'queue' END", "namespace": "CASE WHEN o_orderkey % 29 = 0 THEN 'elsewhere' ELSE 'main' END",
    "contract_service_id": "CASE WHEN o_orderkey % 31 = 0 THEN NULL WHEN o_orderkey % 37 = 0 THEN '' ELSE concat('svc', o_custkey % 3) END", "operation": "CASE WHEN o_orderkey % 41 = 0 THEN 'odd' WHEN o_orderkey % 43 = 0 THEN 'op1' ELSE concat('op', o_custkey % 7) END",
    "path": "CASE WHEN o_orderkey % 47 = 0 THEN NULL WHEN o_orderkey % 53 = 0 THEN '' ELSE '/p' END", "topic": "CASE WHEN o_orderkey % 59 = 0 THEN NULL ELSE 't' END", "schema": "CASE WHEN o_orderkey % 61 = 0 THEN 's2' ELSE 's' END",
    "endpoint": "CASE WHEN o_orderkey % 67 = 0 THEN 'stale_binding_source_digest' END", "claimed": "o_orderkey % 71 = 0", "expected": "CASE WHEN o_orderkey % 73 = 0 THEN 'sha-old' END",
}
_CONTRACT = {
    "id": "concat('c', c_custkey)", "protocol": "CASE c_custkey % 3 WHEN 0 THEN 'http' WHEN 1 THEN 'rpc' ELSE 'queue' END", "service": "concat('svc', c_custkey % 3)", "operation": "concat('op', c_custkey % 7)",
    "artifact": "CASE WHEN c_custkey % 19 = 0 THEN NULL ELSE 'sha' END", "why": "CASE WHEN c_custkey % 13 = 0 THEN 'stale_artifact_digest' END",
}


def _declared(spark, d) -> tuple[DataFrame, DataFrame]:
    b = {k: F.expr(v) for k, v in _BINDING.items()}
    none = F.lit(None).cast("string")
    http, rpc, queue = (b["protocol"] == p for p in ("http", "rpc", "queue"))
    both = http | rpc
    fields = {"method": F.when(http, "GET"), "path": F.when(http, b["path"]), "operation": F.when(both, b["operation"]), "operation_ref": F.when(http, "ref"), "request_schema": F.when(both, b["schema"]), "response_schema": F.when(both, "r"), "rpc_service": F.when(rpc, "S"), "topic": F.when(queue, b["topic"]), "schema": F.when(queue, b["schema"])}
    bindings = table(spark, d, "orders").where("o_custkey % 2 = 0").select(b["id"].alias("id"), b["service_id"].alias("service_id"), b["role"].alias("role"), b["contract_id"].alias("contract_id"), b["protocol"].alias("protocol"), b["namespace"].alias("namespace"), b["contract_service_id"].alias("contract_service_id"), *[c.alias(k) for k, c in fields.items()], b["endpoint"].alias("endpoint_reason"), b["claimed"].alias("claimed_generated"), b["expected"].alias("expected_sha256"))
    c = {k: F.expr(v) for k, v in _CONTRACT.items()}
    http, rpc, queue = (c["protocol"] == p for p in ("http", "rpc", "queue"))
    both = http | rpc
    fields = {"method": F.when(http, "GET"), "path": F.when(http, "/p"), "operation": F.when(both, c["operation"]), "operation_ref": F.when(http, "ref"), "request_schema": F.when(both, "s"), "response_schema": F.when(both, "r"), "rpc_service": F.when(rpc, "S"), "topic": F.when(queue, "t"), "schema": F.when(queue, "s")}
    declared = table(spark, d, "customer").where("c_custkey % 17 <> 0").select(c["id"].alias("id"), c["protocol"].alias("protocol"), F.lit("main").alias("namespace"), c["service"].alias("contract_service_id"), *[F.coalesce(x, none).alias(k) for k, x in fields.items()], c["artifact"].alias("artifact_sha256"), c["why"].alias("contract_reason"))
    return bindings, declared


_DECLARED = f"""b AS (SELECT {', '.join(f'{v} AS {k}' for k, v in _BINDING.items())} FROM orders WHERE o_custkey % 2 = 0),
c AS (SELECT {', '.join(f'{v} AS {k}' for k, v in _CONTRACT.items())} FROM customer WHERE c_custkey % 17 <> 0),
ops AS (SELECT DISTINCT operation AS op FROM c WHERE protocol <> 'queue'),
bi AS (SELECT *, concat(coalesce(contract_service_id, '~'), '|', namespace, '|', CASE protocol WHEN 'http' THEN concat(coalesce(path, '~'), '|', operation, '|', schema) WHEN 'rpc' THEN concat(operation, '|', schema) ELSE concat(coalesce(topic, '~'), '|', schema) END) AS ident FROM b),
ci AS (SELECT *, concat(service, '|main|', CASE protocol WHEN 'http' THEN concat('/p|', operation, '|s') WHEN 'rpc' THEN concat(operation, '|s') ELSE 't|s' END) AS ident FROM c),
e AS (SELECT CASE role WHEN 'server' THEN 'client' ELSE 'producer' END AS role, contract_id, ident, count(*) AS n, min(id) AS e, min(endpoint) AS why, min(CASE WHEN claimed THEN 1 END) AS bad, min(expected) AS expected FROM bi WHERE role = 'consumer' OR (role = 'server' AND service_id IS NOT DISTINCT FROM contract_service_id) GROUP BY ALL),
j AS (SELECT o.*, ci.id AS has, ci.ident AS c_ident, ci.operation AS c_op, artifact, ci.why AS c_why, e.n, e.e, e.why AS e_why, e.bad, e.expected AS e_expected, op FROM bi o LEFT JOIN ci ON o.contract_id = ci.id LEFT JOIN e ON e.role = o.role AND e.contract_id = o.contract_id AND e.ident = o.ident LEFT JOIN ops ON op = CASE WHEN o.protocol <> 'queue' THEN o.operation END WHERE o.role IN ('client', 'producer')),
r AS (SELECT *, CASE WHEN endpoint IS NOT NULL THEN 'origin_source_affinity_unqualified' WHEN contract_service_id IS NULL THEN 'computed_service' WHEN contract_service_id = '' THEN 'missing_service'
  WHEN protocol = 'http' AND path IS NULL THEN 'computed_route' WHEN protocol = 'http' AND path = '' THEN 'missing_route' WHEN protocol = 'queue' AND topic IS NULL THEN 'computed_topic'
  WHEN has IS NULL THEN 'missing_contract' WHEN artifact IS NULL THEN 'missing_artifact_source' WHEN claimed THEN 'unqualified_generated_claim' WHEN expected <> artifact THEN 'stale_artifact'
  WHEN ident <> c_ident AND protocol = 'rpc' AND operation <> c_op THEN CASE WHEN op IS NOT NULL THEN 'rpc_service_and_operation_not_matched' ELSE 'missing_operation' END
  WHEN ident <> c_ident AND schema <> 's' THEN 'schema_mismatch' WHEN ident <> c_ident AND protocol = 'queue' AND namespace <> 'main' THEN 'namespace_mismatch' WHEN ident <> c_ident THEN 'binding_contract_identity_mismatch'
  WHEN c_why IS NOT NULL THEN c_why WHEN n IS NULL THEN CASE WHEN role = 'producer' THEN 'missing_consumer_binding' ELSE 'missing_server_binding' END WHEN n > 1 THEN 'duplicate_endpoint_bindings'
  WHEN bad IS NOT NULL THEN 'unqualified_generated_claim' WHEN e_expected <> artifact THEN 'stale_artifact' WHEN e_why IS NOT NULL THEN e_why END AS reason FROM j)"""
_DECLARED = _DECLARED.replace("AS STRING", "AS VARCHAR")


@query(f"WITH {_DECLARED} SELECT id AS binding_id, CASE WHEN reason IS NULL THEN e END AS target_binding_id, CASE WHEN reason IS NULL THEN 'resolved' ELSE 'unresolved' END AS certainty, reason FROM r")
def contract_matches(spark, d):
    return contracts.matches(*_declared(spark, d))


@query(f"WITH {_DECLARED} SELECT reason, count(*) AS bindings FROM r GROUP BY reason")
def contract_reasons(spark, d):
    return contracts.matches(*_declared(spark, d)).groupBy("reason").agg(F.count("*").alias("bindings"))


@query("""SELECT DISTINCT 'spec/' || (c_custkey % 50) || '.yaml' AS path, CAST(o_orderkey AS VARCHAR) AS site_id FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_custkey % 2 = 0 AND c_custkey % 17 <> 0""")
def contract_memberships(spark, d):
    bindings, declared = _declared(spark, d)
    w = declared.select(F.col("id").alias("contract_id"), F.concat(F.lit("spec/"), (F.expr("cast(substring(id, 2) as bigint)") % 50).cast("string"), F.lit(".yaml")).alias("path"))
    return contracts.memberships(bindings, w.union(w))


@query(f"""WITH b AS (SELECT {', '.join(f'{v} AS {k}' for k, v in _BINDING.items())} FROM orders WHERE o_custkey % 2 = 0)
SELECT id, CASE WHEN coalesce(contract_service_id, '') = '' OR (protocol = 'http' AND coalesce(path, '') = '') OR (protocol = 'queue' AND topic IS NULL) THEN 'incomplete_identity' END AS reason FROM b WHERE reason IS NOT NULL""".replace("AS STRING", "AS VARCHAR"))
def contract_identities(spark, d):
    """Declared identities that lack a field of their protocol."""
    return contracts.invalid(_declared(spark, d)[0])


@query("""WITH s AS (SELECT l_orderkey AS k, count(*) AS n, min(l_linenumber) AS m FROM lineitem WHERE l_quantity > 25 GROUP BY 1)
SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' AND o_shippriority = 0 AND n = 1 THEN k || ':' || m END AS declaration_id,
CASE WHEN o_orderkey % 7 = 0 THEN 'missing_binding_source' WHEN o_orderstatus = 'P' THEN 'partial_or_stale_endpoint_source' WHEN o_orderkey % 5 = 0 THEN 'stale_binding_source_digest' WHEN o_orderstatus = 'O' THEN 'binding_source_affinity_unqualified' WHEN coalesce(n, 0) <> 1 THEN 'missing_or_ambiguous_endpoint_declaration' END AS reason
FROM orders LEFT JOIN s ON k = o_orderkey""".replace("o_orderstatus = 'F' AND o_shippriority = 0 AND n = 1", "o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0 AND o_orderstatus = 'F' AND n = 1"))
def endpoint_affinity(spark, d):
    """Orders as bindings of the files named by their keys, line items as declarations in these."""
    o = table(spark, d, "orders")
    path = F.concat(F.lit("f"), F.col("o_orderkey").cast("string"))
    zero = F.lit(0).cast("bigint")
    b = o.select(F.col("o_orderkey").alias("id"), path.alias("path"), zero.alias("start_byte"), (zero + 9).alias("end_byte"), F.lit("f").alias("name"), F.when(F.col("o_orderkey") % 5 == 0, "old").otherwise("now").alias("sha256"))
    files = o.where("o_orderkey % 7 <> 0").select(path.alias("path"), F.when(F.col("o_orderstatus") == "P", "partial_parse").when(F.col("o_orderstatus") == "F", "parsed").otherwise("configuration").alias("status"), F.lit("now").alias("sha256"))
    li = table(spark, d, "lineitem").where("l_quantity > 25")
    s = li.select(F.concat_ws(":", "l_orderkey", "l_linenumber").alias("id"), F.concat(F.lit("f"), F.col("l_orderkey").cast("string")).alias("path"), zero.alias("start_byte"), (zero + 9).alias("end_byte"), F.lit("f").alias("name"), F.lit(True).alias("callable"))
    return contracts.endpoints(b, files, s).select("id", "declaration_id", F.col("endpoint_reason").alias("reason"))


@query("""SELECT id, CASE WHEN reason IS NULL THEN len(string_split(substr(c, 1, 20), chr(10))) END AS start_line, CASE WHEN reason IS NULL THEN len(string_split(substr(c, 1, 60), chr(10))) - CASE WHEN substr(c, 60, 1) = chr(10) THEN 1 ELSE 0 END END AS end_line, reason FROM
(SELECT id, body AS c, CASE WHEN id % 7 = 0 THEN 'missing_source' WHEN id % 5 = 0 THEN 'stale_source_digest' WHEN length(body) < 60 THEN 'range_outside_source' WHEN id % 3 = 0 THEN 'slice_differs' END AS reason FROM docs WHERE body IS NOT NULL AND regexp_full_match(body, '[\\x00-\\x7F]*'))""")
def witness_slices(spark, d):
    """Bytes 20 to 60 of every ASCII body as a witness."""
    docs = table(spark, d, "docs").where(F.col("body").isNotNull() & F.col("body").rlike(r"\A[\x00-\x7F]*\z"))
    at = F.col("id").cast("string")
    files = docs.where("id % 7 <> 0").select(at.alias("path"), F.lit("now").alias("sha256"), F.col("body").cast("binary").alias("content"))
    part = F.substring("body", 21, 40)
    w = docs.select("id", at.alias("path"), F.lit(20).cast("bigint").alias("start_byte"), F.lit(60).cast("bigint").alias("end_byte"), F.when(F.col("id") % 5 == 0, "old").otherwise("now").alias("source_sha256"), F.sha2(F.when(F.col("id") % 3 == 0, F.concat(part, F.lit("x"))).otherwise(part), 256).alias("slice_sha256"))
    return contracts.slices(w, files).select("id", "start_line", "end_line", "reason")


# Answers


_OPEN = answers.Budget(work=300, edges=200, entities=60, response_bytes=9000)


@query(f"""WITH {_IMPORTS}, p AS (SELECT path, ordinal, module, row_number() OVER (ORDER BY path, ordinal, module) AS place FROM imp ORDER BY path, ordinal, module LIMIT 301),
s AS (SELECT *, len(list_distinct(flatten(list([path, module]) OVER (ORDER BY place ROWS UNBOUNDED PRECEDING)))) AS n, sum(strlen('{{"path":"' || path || '","ordinal":' || ordinal || ',"module":"' || module || '"}}')) OVER (ORDER BY place ROWS UNBOUNDED PRECEDING) AS b FROM p),
t AS (SELECT *, CASE WHEN place > 300 THEN 'work_budget_exceeded' WHEN place > 200 THEN 'edge_budget_exceeded' WHEN n > 60 THEN 'entity_budget_exceeded' WHEN b > 9000 THEN 'response_byte_budget_exceeded' END AS stop FROM s)
SELECT path, ordinal, module, place, stop FROM t WHERE place <= coalesce((SELECT min(place) FROM t WHERE stop IS NOT NULL), 1000)""")
def bounded_answer(spark, d):
    """Rows until the first budget is used up, and the row that names which."""
    rows = _statements(spark, d).select("path", "ordinal", "module")
    return answers.bounded(rows, ["path", "ordinal", "module"], _OPEN, ["path", "module"]).withColumn("place", F.col("place").cast("bigint"))


@query("""SELECT 'open' AS answer, 25 AS value, 'exact' AS kind UNION ALL SELECT 'cut', 7, 'lower_bound' UNION ALL SELECT 'none', NULL, 'unavailable'""")
def answer_totals(spark, d):
    """Totals of three answers over the nations: all of them, seven of them, and one that nothing can give."""
    n = table(spark, d, "nation").select("n_nationkey")
    whole = answers.total_count(answers.bounded(n, ["n_nationkey"], answers.Budget()))
    part = answers.total_count(answers.bounded(n, ["n_nationkey"], answers.Budget(edges=7)))
    none = answers.total_count(n, available=False)
    named = lambda name, df: df.select(F.lit(name).alias("answer"), F.col("value").cast("int").alias("value"), "kind")
    return named("open", whole).union(named("cut", part)).union(named("none", none))


_LISTED = f"""{_IMPORTS}, l AS (SELECT path, ordinal, name, CASE ordinal % 4 WHEN 0 THEN 'call' WHEN 1 THEN 'reference' WHEN 2 THEN 'contract' ELSE 'framework' END AS role, CASE WHEN length(path) % 2 = 0 THEN 'web' ELSE 'jobs' END AS family, CASE length(path) % 3 WHEN 0 THEN 'http' WHEN 1 THEN 'rpc' END AS protocol FROM imp)"""


@query(f"""WITH {_LISTED} SELECT 'plain' AS listing, path, ordinal FROM l WHERE role IN ('call', 'reference') AND starts_with(path, 'lantern-') AND starts_with(name, 's')
UNION ALL SELECT 'framework', path, ordinal FROM l WHERE role = 'framework' AND family = 'web' UNION ALL SELECT 'contract', path, ordinal FROM l WHERE role = 'contract' AND protocol = 'rpc'""")
def listings(spark, d):
    """Three filtered listings: calls and references below a raw prefix, one family of frameworks, one protocol of contracts."""
    n = F.col("ordinal") % 4
    rows = _statements(spark, d).select("path", "ordinal", F.col("name").alias("target_name"), F.when(n == 0, "call").when(n == 1, "reference").when(n == 2, "contract").otherwise("framework").alias("role"), F.when(F.length("path") % 2 == 0, "web").otherwise("jobs").alias("family"), F.when(F.length("path") % 3 == 0, "http").when(F.length("path") % 3 == 1, "rpc").alias("protocol"))
    take = lambda name, df: df.select(F.lit(name).alias("listing"), "path", "ordinal")
    return take("plain", answers.filtered(rows, scope="lantern-", prefix="s")).union(take("framework", answers.filtered(rows, role="framework", families=("web",)))).union(take("contract", answers.filtered(rows, role="contract", protocols=("rpc",))))


@query("SELECT r_regionkey AS id, r_name AS name FROM region ORDER BY r_name, r_regionkey LIMIT 4")
def merged_scene(spark, d):
    r = table(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    return answers.merged_scene(r.where("id <= 3"), r.where("id >= 1"), "id", ["name", "id"], 4)


@query(f"""WITH {_TREE}, top AS (SELECT directory, files FROM tree WHERE directory <> '' AND directory NOT LIKE '%/%') SELECT count(*) AS tiles, round(sum(files / (SELECT sum(files) FROM top)), 6) AS area FROM top""")
def treemap_area(spark, d):
    """All tiles of the repositories' map, and that their areas are in proportion: each tile's area is its share of files."""
    top = rollup.tree_counts(_paths(spark, d)).where("directory <> '' and not directory like '%/%'")
    t = answers.treemap(top, "directory", "files").join(top.withColumnRenamed("directory", "name"), "name")
    share = F.col("files") / F.sum("files").over(Window.partitionBy(F.lit(0)))
    t = t.withColumn("share", share).withColumn("right", F.abs(F.col("w") * F.col("h") - F.col("share")) < 1e-9)
    return t.agg(F.count("*").alias("tiles"), F.round(F.sum(F.when(F.col("right"), F.col("share"))), 6).alias("area"))


@query(f"WITH {_TREE}, o AS (SELECT directory, row_number() OVER (ORDER BY files DESC, directory) AS r FROM tree WHERE directory NOT LIKE '%/%') SELECT directory, r AS place FROM o")
def viewer_order(spark, d):
    t = rollup.tree_counts(_paths(spark, d)).where("not directory like '%/%'")
    return answers.ordered(t, "files").select("directory", "files").withColumn("place", F.row_number().over(Window.orderBy(F.desc("files"), "directory")).cast("bigint")).drop("files")


# Evaluation


@query(f"""WITH {_FILES}, g AS (SELECT count(*) AS files FROM files), q AS (SELECT count(*) FILTER (l_linenumber <= 5) AS n FROM lineitem)
SELECT 'all_files_in_system' AS check, true AS passed UNION ALL SELECT 'system_node_cap', true UNION ALL SELECT 'all_corpus_embedded', (SELECT count(vector) = count(*) FROM docs)
UNION ALL SELECT 'hybrid_hit_at_5_at_least_75_percent', (SELECT round(avg(CASE WHEN m <= 5 THEN 1.0 ELSE 0 END), 6) >= 0.75 FROM (SELECT l_orderkey, min(l_linenumber) FILTER (l_quantity > 30) AS m FROM lineitem GROUP BY 1))
UNION ALL SELECT 'hybrid_warm_p95_under_one_second', (SELECT list_sort(list(l_discount * 20))[CAST(floor(0.95 * (count(*) - 1)) AS INT) + 1] < 1 FROM lineitem)""")
def acceptance_checks(spark, d):
    """The five checks, with the orders as queries and their line items as ranked answers."""
    groups, _ = rollup.system_partition(_paths(spark, d))
    li = table(spark, d, "lineitem")
    quality = evaluation.retrieval_quality(li.select(F.col("l_orderkey").alias("query"), F.col("l_linenumber").alias("rank"), (F.col("l_quantity") > 30).alias("relevant")))
    return evaluation.acceptance(groups, _paths(spark, d), table(spark, d, "docs"), quality, li.select((F.col("l_discount") * 20).cast("double").alias("seconds")))


_METHODS = "CASE o_orderkey % 3 WHEN 0 THEN 'hybrid' WHEN 1 THEN 'local' ELSE 'remote' END"


@query(f"""WITH m AS (SELECT o_orderkey, {_METHODS} AS method, CASE WHEN o_orderkey % 3 = 2 THEN o_custkey END AS tokens, o_totalprice::DOUBLE AS s, CASE WHEN o_orderkey % 10 = 7 THEN 'fallback' ELSE 'ok' END AS status FROM orders),
f AS (SELECT method, o_orderkey, min(l_linenumber) FILTER (l_quantity > 30) AS r FROM m JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2),
q AS (SELECT method, count(*) AS queries, round(avg(CASE WHEN r <= 5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit_at_5, round(avg(CASE WHEN r <= 10 THEN 1.0::DOUBLE / r ELSE 0 END), 6) AS mrr_at_10 FROM f GROUP BY 1),
t AS (SELECT method, CAST(coalesce(sum(tokens), 0) AS BIGINT) AS input_tokens, count(*) FILTER (status = 'fallback') AS fallbacks, count(tokens) AS calls, list_sort(list(s)) AS xs FROM m GROUP BY 1)
SELECT method, queries, hit_at_5, mrr_at_10, input_tokens, fallbacks, calls, xs[CAST(floor((len(xs) - 1) / 2) AS INT) + 1] AS p50, xs[CAST(floor(0.95 * (len(xs) - 1)) AS INT) + 1] AS p95, round(input_tokens * 0.042 / 1e6, 8) AS cost FROM q JOIN t USING (method)""")
def methods_compared(spark, d):
    o = table(spark, d, "orders").withColumn("method", F.expr(_METHODS))
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("query"), F.col("l_linenumber").alias("rank"), (F.col("l_quantity") > 30).alias("relevant"))
    ranked = li.join(o.select(F.col("o_orderkey").alias("query"), "method"), "query")
    receipts = o.select("method", F.col("o_orderkey").alias("query"), F.col("o_totalprice").cast("double").alias("seconds"), F.when(F.col("o_orderkey") % 3 == 2, F.col("o_custkey").cast("bigint")).alias("input_tokens"), F.when(F.col("o_orderkey") % 10 == 7, "fallback").otherwise("ok").alias("status"))
    return evaluation.compared(ranked, receipts)


@query("""SELECT count(*) AS queries, round(avg(h), 6) AS candidate_hit_rate FROM (SELECT l_orderkey, max(CASE WHEN l_quantity > 40 THEN 1.0::DOUBLE ELSE 0 END) AS h FROM lineitem GROUP BY 1)""")
def candidate_hits(spark, d):
    return evaluation.candidate_hit_rate(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("query"), (F.col("l_quantity") > 40).alias("relevant")))


@query(f"""WITH {_FILES}, j AS (SELECT * FROM (VALUES ('one', 'lantern-'), ('one', 'slate-gate/'), ('two', 'tidewater-index/a')) t(query, prefix)), h AS (SELECT path, CASE length(path) % 3 WHEN 0 THEN 'one' WHEN 1 THEN 'two' ELSE 'three' END AS query FROM files)
SELECT path, query, coalesce((SELECT bool_or(starts_with(h.path, j.prefix)) FROM j WHERE j.query = h.query), false) AS relevant FROM h""")
def judged_paths(spark, d):
    h = _paths(spark, d).select("path", F.when(F.length("path") % 3 == 0, "one").when(F.length("path") % 3 == 1, "two").otherwise("three").alias("query"))
    j = spark.createDataFrame([("one", "lantern-"), ("one", "slate-gate/"), ("two", "tidewater-index/a")], "query string, prefix string")
    return evaluation.relevant_by_prefix(h, j).select("path", "query", "relevant")


_CLAIMS = """g AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 6 <> 0 THEN 'c' || o_custkey END AS target, o_orderkey % 11 AS m, o_custkey FROM orders),
a AS (SELECT k, CASE WHEN m < 5 THEN 'resolved' WHEN m < 8 THEN 'candidate' ELSE 'unresolved' END AS certainty, CASE WHEN m IN (0, 1, 2) THEN ['c' || o_custkey] WHEN m IN (3, 5) THEN ['x'] WHEN m IN (4, 6) THEN ['c' || o_custkey, 'x'] ELSE []::VARCHAR[] END AS targets FROM g WHERE m <> 10)"""


def _claims(spark, d) -> tuple[DataFrame, DataFrame]:
    o = table(spark, d, "orders")
    own, m = F.concat(F.lit("c"), F.col("o_custkey").cast("string")), F.col("o_orderkey") % 11
    gold = o.select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 6 != 0, own).alias("target"))
    targets = F.when(m.isin(0, 1, 2), F.array(own)).when(m.isin(3, 5), F.array(F.lit("x"))).when(m.isin(4, 6), F.array(own, F.lit("x"))).otherwise(F.array().cast("array<string>"))
    return gold, o.where(m != 10).select(F.col("o_orderkey").alias("k"), F.when(m < 5, "resolved").when(m < 8, "candidate").otherwise("unresolved").alias("certainty"), targets.alias("targets"))


@query(f"""WITH {_CLAIMS} SELECT CASE WHEN certainty IS NULL THEN 'missing' WHEN target IS NULL THEN CASE WHEN certainty = 'unresolved' OR len(targets) = 0 THEN 'right_unresolved' ELSE 'wrong_claim' END
WHEN certainty = 'resolved' THEN CASE WHEN list_contains(targets, target) AND len(targets) = 1 THEN 'exact' ELSE 'wrong' END WHEN certainty = 'candidate' THEN CASE WHEN list_contains(targets, target) THEN 'candidate' ELSE 'wrong' END ELSE 'unresolved' END AS verdict, count(*) AS rows
FROM g LEFT JOIN a USING (k) GROUP BY 1""")
def certain_grade(spark, d):
    return evaluation.grade_certain(*_claims(spark, d), ["k"])


@query(f"WITH {_CLAIMS} SELECT count(*) AS targets, count(*) FILTER (list_contains(targets, target)) AS found, round(count(*) FILTER (list_contains(targets, target)) / count(*), 6) AS recall FROM g LEFT JOIN a USING (k) WHERE target IS NOT NULL")
def call_recall(spark, d):
    return evaluation.candidate_recall(*_claims(spark, d), ["k"])


@query("""WITH e AS (SELECT path, bytes AS line, coalesce(status, 'none') AS message FROM structural_files WHERE path IS NOT NULL AND kind IS NOT NULL), f AS (SELECT path, line, message FROM e ORDER BY path, line, message LIMIT 16),
k AS (SELECT *, sum(strlen('{"path":"' || path || '","line":' || line || ',"message":"' || message || '"}')) OVER (ORDER BY path, line, message ROWS UNBOUNDED PRECEDING) AS n FROM f)
SELECT (SELECT count(*) FROM e) AS errors, count(*) AS samples, string_agg(path || ':' || line, chr(10) ORDER BY path || ':' || line) AS first, count(*) < (SELECT count(*) FROM e) AS truncated FROM k WHERE n <= 900""")
def parser_error_samples(spark, d):
    """All rows of known kind as errors, the first of them as far as 900 bytes go."""
    e = table(spark, d, "structural_files").where("path is not null and kind is not null").select("path", F.col("bytes").alias("line"), F.coalesce("status", F.lit("none")).alias("message"))
    return coverage.parser_errors(e, 16, 900)


@query("""SELECT l_returnflag AS lane, max(l_quantity)::DOUBLE AS peak_memory, max(l_tax)::DOUBLE AS longest, count(*) AS files, CAST(sum(l_linenumber) AS BIGINT) AS nodes, CAST(sum(l_partkey) AS BIGINT) AS bytes FROM lineitem GROUP BY 1""")
def batch_resources(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("lane"), F.col("l_quantity").cast("double").alias("memory"), F.col("l_tax").cast("double").alias("seconds"), F.lit(1).alias("files"), F.col("l_linenumber").alias("nodes"), F.col("l_partkey").alias("bytes"))
    return coverage.resources(li, ["lane"])


# Snapshots


@query(f"""WITH {_CURRENT}, old AS (SELECT path, CASE WHEN length(path) % 4 = 0 THEN 'x' ELSE digest END AS digest, CASE WHEN length(path) % 5 = 0 THEN 'a0' ELSE 'a1' END AS analyzer FROM cur)
SELECT old.path FROM old JOIN cur USING (path) WHERE old.digest IS NOT DISTINCT FROM cur.digest AND analyzer = 'a1'""")
def reusable_rows(spark, d):
    """Collected rows that another run may keep: same digest, same analyzer."""
    now = _now_digest(spark, d)
    old = now.select("path", F.when(F.length("path") % 4 == 0, "x").otherwise(F.col("digest")).alias("digest"), F.when(F.length("path") % 5 == 0, "a0").otherwise("a1").alias("analyzer"))
    return snapshot.reusable(old, now, "path", "digest", "a1").select("path")


@query(f"""WITH {_CURRENT}, r AS (SELECT path, CASE WHEN length(path) % 4 = 0 THEN 'x' ELSE digest END AS digest FROM cur UNION ALL SELECT 'gone/' || path, digest FROM cur WHERE length(path) % 9 = 0)
SELECT r.path, CASE WHEN cur.path IS NULL THEN 'gone' ELSE 'changed' END AS cause FROM r LEFT JOIN cur USING (path) WHERE cur.path IS NULL OR r.digest IS DISTINCT FROM cur.digest""")
def moved_sources(spark, d):
    """Sources that changed between reading and publishing."""
    now = _now_digest(spark, d)
    read = now.select("path", F.when(F.length("path") % 4 == 0, "x").otherwise(F.col("digest")).alias("digest"))
    read = read.union(now.where(F.length("path") % 9 == 0).select(F.concat(F.lit("gone/"), "path"), "digest"))
    return snapshot.moved_since(read, now, "path", "digest")


@query(f"""WITH {_EDGES}, m AS (SELECT DISTINCT path FROM linked WHERE target IS NULL) SELECT path, 'dependency' AS cause FROM m UNION SELECT path, 'dependency' FROM linked WHERE target IS NOT NULL AND length(target) % 6 = 0""")
def open_closures(spark, d):
    """Files with an import of unknown target depend on the whole inventory, others on the directories they name; both changed."""
    linked = _linked(spark, d)
    sites = linked.select("path", F.when(F.col("target").isNull(), "import_missing").alias("reason"))
    deps = linked.where("target is not null").select("path", F.lit("directory").alias("kind"), F.col("target").alias("key"), F.when(F.length("target") % 6 == 0, "old").otherwise("now").alias("fingerprint"), F.lit(True).alias("present")).distinct()
    now = deps.select("kind", "key", F.lit("now").alias("fingerprint")).distinct().union(spark.createDataFrame([("inventory", "*", "other")], "kind string, key string, fingerprint string"))
    none = linked.select("path", F.lit(False).alias("changed")).limit(0)
    return snapshot.dirty(none, snapshot.open_consumers(sites, deps), now).distinct()


# Sources and sinks


@query("""SELECT s_suppkey AS ordinal, 'rec' || s_suppkey AS record_id, 'name' AS field, s_name AS content FROM supplier WHERE s_suppkey % 13 <> 0
UNION ALL SELECT s_suppkey, 'rec' || s_suppkey, 'active', NULL FROM supplier WHERE s_suppkey % 13 <> 0""")
def xml_records(spark, d):
    """One configuration file per supplier, one record in each; every thirteenth holds a document type and is refused."""
    s = table(spark, d, "supplier")
    body = F.concat(F.when(F.col("s_suppkey") % 13 == 0, "<!DOCTYPE x [<!ENTITY a 'b'>]>").otherwise(""), F.lit('<odoo><record id="rec'), F.col("s_suppkey").cast("string"), F.lit('" model="m"><field name="name">'), "s_name", F.lit('</field><field name="active" eval="1"/></record></odoo>'))
    c = xmlconfig.configuration(s.select(F.col("s_suppkey").cast("string").alias("path"), body.cast("binary").alias("content"))).where("error is null")
    return c.select(F.col("path").cast("bigint").alias("ordinal"), "record_id", "field", F.nullif(F.coalesce("content", F.lit("")), F.lit("")).alias("content"))


@query("SELECT n_nationkey, n_name, 2 AS generation FROM nation WHERE n_regionkey <> 1")
def published_table(spark, d):
    """What a reader sees after two writers started from the same generation: the first to publish, whole."""
    base = f"{shared_folder(spark)}/{fresh('store')}"
    a, b = generations.Store(spark, base), generations.Store(spark, base)
    n = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    a.publish(a.write({"t": n}), 0)
    expected = b.current()
    late = b.write({"t": n.where("n_regionkey = 1")})
    a.publish(a.write({"t": n.where("n_regionkey <> 1")}), expected)
    b.publish(late, expected)
    return a.read("t").select("n_nationkey", "n_name", F.lit(a.current()).alias("generation"))


@query("SELECT 'ready' AS state, 1 AS attempts UNION ALL SELECT 'failed', 2")
def attempt_states(spark, d):
    """Three attempts: one publishes, one breaks, one loses to a writer that was first."""
    store = generations.Store(spark, f"{shared_folder(spark)}/{fresh('store')}")
    one = table(spark, d, "region")

    def breaks():
        raise ValueError("broken")

    def loses():
        store.publish(store.write({"t": one}), store.current())
        return {"t": one}

    for ident, build in (("a", lambda: {"t": one}), ("b", breaks), ("c", loses)):
        try:
            generations.lifecycle(store, ident, build)
        except (ValueError, RuntimeError):
            pass
    states = spark.createDataFrame([(store.attempt_state(i)["state"],) for i in "abc"], "state string")
    return states.groupBy("state").agg(F.count("*").cast("int").alias("attempts"))


_BIG = "big AS (SELECT split_part(path, '/', 1) AS repo FROM files GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
_BETWEEN = f"""{_EDGES}, {_BIG}, e AS (SELECT split_part(source, '/', 2) AS s, split_part(target, '/', 2) AS t, CAST(sum(count) AS BIGINT) AS n FROM edges, big WHERE starts_with(source, repo || '/') AND starts_with(target, repo || '/') GROUP BY 1, 2)"""


def _between(spark, d) -> tuple[DataFrame, DataFrame]:
    """The files of the largest repository, and the imports between its first directories."""
    repo, first = _largest(spark, d), lambda c: F.substring_index(c, "/", 1)
    e = _within(_within(_edges(spark, d), "source", repo), "target", repo).select(first("source").alias("source"), first("target").alias("target"), "count")
    return _within(_paths(spark, d), "path", repo), e.where("source <> target").groupBy("source", "target").agg(F.sum("count").alias("count"))


@query(f"""WITH {_BETWEEN}, top AS (SELECT split_part(directory, '/', 2) AS directory, files, row_number() OVER (ORDER BY directory) AS r FROM tree, big WHERE starts_with(directory, repo || '/') AND len(string_split(directory, '/')) = 2 ORDER BY 1 LIMIT 23),
shown AS (SELECT a.r AS ar, b.r AS br, s, t, n FROM e JOIN top a ON a.directory = s JOIN top b ON b.directory = t WHERE s <> t ORDER BY n DESC, s, t LIMIT (SELECT greatest(0, 39 - count(*)) FROM top)),
lines AS (SELECT 0 AS o, 0::BIGINT AS p, 'flowchart LR' AS l UNION ALL SELECT 1, 0, '  n0["root"]' UNION ALL SELECT 2, r, '  n' || r || '["' || substr(regexp_replace(directory, '[^A-Za-z0-9_./ -]', '_', 'g'), 1, 60) || ' (' || files || ')"]' FROM top
  UNION ALL SELECT 3, row_number() OVER (ORDER BY n DESC, s, t), '  n' || ar || ' -->|' || n || '| n' || br FROM shown)
SELECT string_agg(l, chr(10) ORDER BY o, p) || chr(10) AS chart FROM lines""")
def flowchart(spark, d):
    """The largest repository's map as text: root, first children, strongest links, at most forty elements."""
    files, e = _between(spark, d)
    return spark.createDataFrame([(sinks.flowchart(rollup.tree_counts(files), e),)], "chart string")


@query(f"""WITH {_BETWEEN}
SELECT (SELECT count(DISTINCT split_part(path, '/', 1)) FROM files) AS groups, (SELECT count(*) FROM files) AS files, count(*) AS relations, CAST(sum(n) AS BIGINT) AS imports, greatest(count(*) - 40, 0) AS omitted FROM e WHERE s <> t""")
def overview_totals(spark, d):
    g = _paths(spark, d).groupBy(F.substring_index("path", "/", 1).alias("name")).agg(F.count("*").alias("files"))
    return sinks.system_overview(g, _between(spark, d)[1])


@query("SELECT p_partkey, length(p_name) AS size, CASE p_partkey % 3 WHEN 1 THEN 'not_an_object' END AS fault, CASE WHEN p_partkey % 3 <> 1 THEN p_partkey END AS part FROM part")
def json_requests(spark, d):
    """Requests of one line each: an object, no object, an object with an extra field."""
    n = F.col("p_partkey").cast("string")
    line = F.when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("["), n, F.lit("]"))).when(F.col("p_partkey") % 3 == 2, F.concat(F.lit('{"part":'), n, F.lit(',"more":1}'))).otherwise(F.concat(F.lit('{"part":'), n, F.lit("}")))
    p = table(spark, d, "part").select("p_partkey", F.length("p_name").cast("bigint").alias("size"), line.alias("value"))
    r = sinks.requests(p.select("value").distinct(), "part bigint")
    return p.join(r, "value").select("p_partkey", "size", "fault", "part")


@query(f"WITH {_CURRENT} SELECT path, CASE WHEN length(path) % 4 = 0 THEN 'scan' ELSE 'known' END AS how FROM cur")
def scan_reuse(spark, d):
    """A scan's cache read by the next one: files that changed or are new must be scanned again."""
    now = _now_digest(spark, d)
    at = f"{shared_folder(spark)}/{fresh('scan')}"
    sinks.scan_cache(now.select("path", F.when(F.length("path") % 4 == 0, "old").otherwise(F.col("digest")).alias("digest"), F.array("path").alias("imports")), at)
    known, rest = sinks.cached_scan(spark, at, now)
    return known.select("path", F.lit("known").alias("how")).union(rest.select("path", F.lit("scan")))


# Evidence and bytes


def _captured(spark, d) -> tuple[DataFrame, DataFrame]:
    """Every readable body as one definition of its file."""
    docs = table(spark, d, "docs").where("path is not null and body is not null")
    at = F.concat_ws("#", "path", F.col("id").cast("string"))
    kind = F.when(F.col("id") % 9 == 0, "class").otherwise("function")
    s = docs.select(F.col("id").cast("string").alias("id"), at.alias("path"), P.basename("path").alias("name"), kind.alias("kind"), F.lit(True).alias("callable"), F.lit(0).cast("bigint").alias("start_byte"), F.lit(1).alias("start_line"), F.col("body").alias("text"))
    f = docs.select(at.alias("path"), P.extension("path").alias("language"), F.when(F.col("id") % 5 == 0, "partial_parse").otherwise("parsed").alias("status"), F.col("digest").alias("sha256"), F.octet_length(F.col("body").cast("binary")).cast("bigint").alias("bytes"))
    return s, f


@query("""WITH s AS (SELECT *, contains(body, 'PRIVATE KEY-----') AS key, octet_length(encode(body)) AS n FROM docs WHERE path IS NOT NULL AND body IS NOT NULL)
SELECT count(*) FILTER (id % 9 <> 0) AS symbols, count(*) FILTER (id % 9 <> 0 AND id % 5 = 0) AS partial_symbols, count(*) FILTER (id % 9 <> 0 AND key) AS excluded_private_keys, count(*) FILTER (id % 9 = 0) AS excluded_kinds,
CAST(coalesce(sum(n) FILTER (id % 9 <> 0 AND NOT key), 0) AS BIGINT) AS body_bytes FROM s""")
def evidence_counters(spark, d):
    s, f = _captured(spark, d)
    return evidence.projection_counters(s, f, evidence.function_chunks(s, f)).drop("chunks", "redacted_chunks")


@query("""SELECT id, octet_length(encode(body)) AS bytes, len(string_split(body, chr(10))) - CASE WHEN ends_with(body, chr(10)) THEN 1 ELSE 0 END AS last_line FROM docs WHERE body IS NOT NULL AND body <> '' AND NOT contains(body, 'PRIVATE KEY-----')""")
def window_totals(spark, d):
    """Byte windows put end to end: the bytes and lines of the whole body, without a gap."""
    w = B.byte_windows(table(spark, d, "docs"), "id", "body")
    gap = F.col("start_byte") != F.coalesce(F.lag("end_byte").over(Window.partitionBy("id").orderBy("window")), F.lit(0))
    w = w.select("id", "start_byte", "end_byte", "end_line", "window").withColumn("gap", gap)  # a window holds the pieces of one body
    return w.groupBy("id").agg(F.when(F.max("gap"), F.lit(-1)).otherwise(F.sum(F.col("end_byte") - F.col("start_byte"))).alias("bytes"), F.max("end_line").cast("bigint").alias("last_line"))


@query("SELECT doc_id AS id, starts_with(text, excerpt) OR contains(excerpt, '[redacted]') AS prefix, truncated FROM (SELECT doc_id, text, '' AS excerpt, octet_length(encode(text)) > 900 AS truncated FROM documents WHERE text IS NOT NULL)")
def excerpt_bounds(spark, d):
    """Excerpts of at most 900 bytes: each is the beginning of its text, and cut only where the text is longer."""
    docs = table(spark, d, "documents").where("text is not null")
    e = B.excerpts(docs, "doc_id", "text", 900).join(docs.select(F.col("doc_id").alias("id"), "text"), "id")
    fits = F.octet_length(F.col("excerpt").cast("binary")) <= 900
    return e.select("id", (fits & (F.col("text").startswith(F.col("excerpt")) | F.col("excerpt").contains("[redacted]"))).alias("prefix"), "truncated")


@query("""SELECT path, count(*) AS functions FROM (SELECT path, unnest(regexp_extract_all(body, '(?m)^func (?:\\([^)]*\\) )?\\w+')) AS f FROM (SELECT path, body FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY CAST(split_part(stamp, ':', 1) AS BIGINT) DESC, id DESC) AS rn FROM docs WHERE path IS NOT NULL) WHERE rn = 1) WHERE path LIKE '%.go' AND body IS NOT NULL) GROUP BY path""")
def go_functions(spark, d):
    """Functions and methods that the facts of every Go file hold."""
    from .queries import _current_files

    s = facts.symbols(facts.collect(_current_files(spark, d).where(P.extension("path") == "go"))).where("kind in ('function', 'method')")
    return s.groupBy("path").agg(F.count("*").alias("functions"))
