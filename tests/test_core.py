import math
import random

import pytest
from pyspark.sql import functions as F

from stratalode.functions import ids
from stratalode.functions import paths as P
from stratalode.functions import text as X
from stratalode.functions import vectors as V
from stratalode.operators import coverage, evaluation, graph, imports, resolution, retrieval, rollup, snapshot
from stratalode.operators.current import latest, stamp_ns
from stratalode.operators.skew import salted_join
from stratalode.sources import postings
from stratalode.sources.generations import Store


def one(spark, value, kind, f):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f("x")).first()[0]


@pytest.mark.parametrize("path,want", [("a/b/c.py", ("a/b", "c.py", "py")), ("c.py", ("", "c.py", "py")), (".hidden", ("", ".hidden", "")), ("a/x.tar.GZ", ("a", "x.tar.GZ", "gz")), ("", ("", "", ""))])
def test_path_parts(spark, path, want):
    assert tuple(spark.createDataFrame([(path,)], "x string").select(P.dirname("x"), P.basename("x"), P.extension("x")).first()) == want


def test_prefix_boundary_and_raw_prefix(spark):
    df = spark.createDataFrame([("a/b",), ("a/b/x",), ("a/bc",), ("a/b0",), ("a/b%_[",), ("a/b/漢",), (None,)], "p string")
    assert [r.p for r in df.where(P.under("p", "/a/b/")).collect()] == ["a/b", "a/b/x", "a/b/漢"]
    assert df.where(F.col("p").startswith("a/b")).count() == 6
    assert df.where(P.selected("p", "a/b/")).count() == 2 and df.where(P.selected("p", "a/b")).count() == 1


def test_visible(spark):
    df = spark.createDataFrame([("a/.git/x",), ("node_modules/x",), ("a/b",), (".x",), ("a/builder/x",)], "p string")
    assert [r.p for r in df.where(P.visible("p")).collect()] == ["a/b", "a/builder/x"]


@pytest.mark.parametrize("a,b,n", [("a/b/c", "a/b/d", 2), ("a", "b", 0), ("", "a", 0), ("a/b", "a/b", 2), ("a/b", "a/bc", 1), ("a/x/c", "a/y/c", 1)])
def test_common_depth(spark, a, b, n):
    assert spark.createDataFrame([(a, b)], "a string, b string").select(P.common_depth("a", "b")).first()[0] == n


@pytest.mark.parametrize("name,want", [("x_linux.go", "platform_variant"), ("linux.go", "neutral"), ("x_test.go", "test_file"), ("_x.go", "ignored_filename"), ("x.py", "not_go_source"), ("d/x_amd64.v2.go", "platform_variant"), ("x_foo.go", "neutral")])
def test_go_filename_class(spark, name, want):
    assert one(spark, name, "string", P.go_filename_class) == want


def test_words_and_query_terms(spark):
    assert one(spark, "parseHTTPRequest some_name naïve漢字-x", "string", X.words) == "parse HTTPRequest some name naïve漢字 x"
    assert X.query_terms("Which of the parseTree nodes, and Which?") == ["parse", "tree", "nodes"]
    assert len(X.query_terms(" ".join(f"t{i}" for i in range(99)))) == 32


def test_synopsis_limit_and_redaction(spark):
    body = "\n".join(["# Copyright x", "# ghp_" + "a" * 24 + " key"] + [f"def f{i}(): " + "x" * 200 for i in range(20)])
    s = spark.createDataFrame([("a/my_file.py", body)], "p string, b string").select(X.synopsis("p", "b")).first()[0].split("\n")
    assert s[0] == "a my file py" and s[1] == "L2: # [redacted] key" and all(len(x) <= 185 for x in s[2:])
    total = sum(map(len, s[1:]))
    assert total >= 1400 and total - len(s[-1]) < 1400
    assert spark.createDataFrame([("p", "x PRIVATE KEY----- y")], "p string, b string").select(X.synopsis("p", "b")).first()[0] == ""
    assert spark.createDataFrame([("p.md", None)], "p string, b string").select(X.synopsis("p", "b")).first()[0] is None


def test_end_line_and_csv_guard(spark):
    f = lambda s: spark.createDataFrame([(5, s)], "n int, t string").select(X.end_line(F.col("n"), F.col("t"))).first()[0]
    assert f("a\nb\n") == 6 and f("a") == 5 and f("\n") == 5 and f("") == 5
    assert [one(spark, s, "string", X.csv_guard) for s in ("=1", " +x", "ok", "@a", "-1")] == ["'=1", "' +x", "ok", "'@a", "'-1"]


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([1.0, 1.0], [2.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0, 1.0]), ([1.0], [1.0, 2.0])], "a array<float>, b array<float>")
    got = [r[0] for r in df.select(V.cosine("a", "b")).collect()]
    assert got[0] == 0 and math.isclose(got[1], 1, rel_tol=1e-9) and got[2:] == [None, None, None]


def test_latest(spark, rows):
    df = spark.createDataFrame([("a", "5:1", 1), ("a", "9:1", 2), ("a", "9:1", 2), ("b", "x", 3), (None, "1:1", 4)], "p string, s string, v int").withColumn("t", stamp_ns("s"))
    assert rows(latest(df, "p", ["t"], ["v"])) == [("a", 2), ("b", 3)]


def test_tree(spark, rows):
    paths = rollup.inventory(spark.createDataFrame([(p,) for p in ["r.md", "a/1.py", "a/2.py", "a/b/3.py", "a/b/3.py", None]], "path string"))
    assert rows(rollup.tree_counts(paths)) == [("", 4), ("a", 3), ("a/b", 1)]
    nodes = {r.directory: r for r in rollup.tree_nodes(paths).collect()}
    assert nodes[""].children == 1 and nodes[""].direct == 1 and nodes["a"].sample == ["a/1.py", "a/2.py", "a/b/3.py"] and nodes["a/b"].children == 0
    assert rows(rollup.child_directories(rollup.tree_counts(paths))) == [("", "a"), ("a", "a/b")]
    many = rollup.inventory(spark.createDataFrame([(f"d/{i:03}",) for i in range(230)], "path string"))
    assert rollup.tree_nodes(many).where("directory = 'd'").first().sample == [f"d/{i:03}" for i in range(8)]
    deep = rollup.inventory(spark.createDataFrame([(f"z/{k:02}/{i}",) for k in range(9) for i in range(3)] + [("z/zz",)], "path string"))
    assert rollup.tree_nodes(deep).where("directory = ''").first().sample == ["z/00/0", "z/00/1", "z/00/2", "z/01/0", "z/01/1", "z/01/2", "z/02/0", "z/02/1"]


def test_scope_edges(spark, rows):
    e = spark.createDataFrame([("a/b/c", "a/b/d", 2), ("a/b/c/x", "a/b/d/y", 3), ("a", "a/b", 1), ("a", "z", 4)], "source string, target string, count bigint")
    assert rows(rollup.scope_edges(e)) == [("", "a", "z", 4), ("a", "scope:a", "a/b", 1), ("a/b", "a/b/c", "a/b/d", 5)]


def test_system_partition_is_disjoint_and_bounded(spark):
    files = ["readme", "go.mod"] + [f"internal/{d}/{i}.go" for d in ("api", "conns", "alpha", "beta", "gamma", "delta", "tests") for i in range(3)] + ["internal/x.go"] + [f"docs/{i}.md" for i in range(4)] + ["website/a.md"] + [f"area{k}/f{i}" for k in range(12) for i in range(k + 1)]
    paths = rollup.inventory(spark.createDataFrame([(f,) for f in files], "path string"))
    groups, owners = rollup.system_partition(paths)
    g = {r.name: r for r in groups.collect()}
    assert len(g) == 12 and sum(r.files for r in g.values()) == len(files)
    listed = [p for r in g.values() for p in r.paths]
    assert len(listed) == len(set(listed))
    assert g["Root files"].files == 2 and g["internal/api"].role == "runtime" and g["Shared internal components"].files == 7 and "Other components" in g
    e = spark.createDataFrame([("internal/api/v1", "internal/conns", 5), ("internal/api", "internal/api/x", 9), ("nowhere", "docs", 1), ("internal/delta", "internal/api", 2)], "source string, target string, count bigint")
    got = {(r.source, r.target): r["count"] for r in rollup.system_edges(e, owners).collect()}
    assert got[("internal/api", "internal/conns")] == 5 and ("internal/api", "internal/api") not in got


def test_empty_tree(spark):
    none = rollup.inventory(spark.createDataFrame([], "path string"))
    assert rollup.tree_nodes(none).count() == 0 and rollup.system_partition(none)[0].count() == 0


GO = 'package x\nimport (\n\t"a/b" // "c"\n\talias "d"\n)\nimport "e"\nvar s = "import"\n'


def test_import_statements(spark, rows):
    df = spark.createDataFrame([("m.go", GO), ("m.py", "from .a import b\nimport os.path, sys\nx = 1\n"), ("m.ts", "import a from './b';\nconst c = require('d');\nawait import('e');\nexport * from \"f\";"), ("n.py", None), ("t.md", "import x")], "path string, body string")
    got = {}
    for p, o, m in rows(imports.statements(df)):
        got.setdefault(p, []).append(m)
    assert got == {"m.go": ["a/b", "d", "e"], "m.py": [".a", "os.path"], "m.ts": ["./b", "d", "e", "f"]}


def test_import_targets(spark, rows):
    files = spark.createDataFrame([(p,) for p in ["pkg/a.py", "pkg/sub/b.py", "web/x.ts", "web/lib/y.ts", "svc/m.go"]], "path string")
    cases = [("pkg/sub/b.py", "..a", "pkg"), ("pkg/sub/b.py", "pkg.sub", "pkg/sub"), ("pkg/a.py", "os", None), ("web/x.ts", "./lib/y", "web/lib"), ("web/x.ts", "react", None), ("svc/m.go", "example.org/r/svc", "svc"), ("svc/m.go", "fmt", None), ("web/x.ts", "../../..", None)]
    df = spark.createDataFrame([(p, m, "example.org/r") for p, m, _ in cases], "path string, module string, gm string")
    t = df.withColumn("target", imports.target_path(F.col("path"), F.col("module"), F.col("gm")))
    got = {(r.path, r.module): r.target_dir for r in imports.resolve(t, files).collect()}
    assert got == {(p, m): w for p, m, w in cases}


def test_go_requirements(spark):
    good = "module ex.org/a\n\ngo 1.22\nrequire (\n\tx/y v1.2.3 // indirect\n\tz/w v0.1.0\n)\nreplace x/y => ./y\n"
    df = spark.createDataFrame([("go.mod", good), ("b/go.mod", good + "\nretract v1\n"), ("c/go.mod", None)], "path string, body string")
    got = sorted((r.path, r.module, r.directive, r.name, r.version) for r in imports.go_requirements(df).collect())
    assert got == [("go.mod", "ex.org/a", "replace", "x/y", "./y"), ("go.mod", "ex.org/a", "require", "x/y", "v1.2.3"), ("go.mod", "ex.org/a", "require", "z/w", "v0.1.0")]


def test_bm25_against_python(spark, tmp_path):
    r = random.Random(3)
    vocab = ["alpha", "beta", "gamma", "delta", "omega"]
    docs = [(i, " ".join(r.choice(vocab) for _ in range(r.randrange(1, 30)))) for i in range(40)] + [(40, None), (41, "")]
    store = Store(spark, f"file://{tmp_path}/k")
    assert postings.build(spark.createDataFrame(docs, "id bigint, text string"), store) == 1
    got = {x.id: x.score for x in postings.bm25(store, "Alpha and the omega").collect()}
    texts = {i: t.split() for i, t in docs if t is not None}
    n, avg = len(texts), sum(map(len, texts.values())) / len(texts)
    want = {}
    for i, t in texts.items():
        s = 0.0
        for q in ("alpha", "omega"):
            d, tf = sum(q in x for x in texts.values()), t.count(q)
            if tf:
                s += max(math.log((n - d + 0.5) / (d + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / avg))
        if "alpha" in t or "omega" in t:
            want[i] = round(s, 6)
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 2e-6 for i in want)
    assert postings.bm25(store, "the of").count() == 0 and postings.bm25(store, "unknown").count() == 0
    plan = postings.bm25(store, "Alpha and the omega")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(term" in plan or "PushedFilters: [IsNotNull(term), In(term" in plan


def test_vector_ties_take_the_larger_id(spark):
    df = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(1027)] + [(2000, None), (2001, [0.0, 0.0])], "id bigint, vector array<float>")
    best = retrieval.top(retrieval.cosine_scores(df, [1.0, 0.0]), 3, True).collect()
    assert [r.id for r in best] == [1026, 1025, 1024]


def test_fusion(spark, rows):
    a = spark.createDataFrame([(1, 1), (2, 2)], "id bigint, rank int")
    b = spark.createDataFrame([(2, 1), (3, 2)], "id bigint, rank int")
    got = [tuple(r) for r in retrieval.fuse(a, b, limit=2).collect()]
    assert got == [(2, round(1 / 62 + 1 / 61, 6)), (1, round(1 / 61, 6))]


def test_rerank_keeps_the_tail(spark):
    ranked = spark.createDataFrame([(i, i) for i in range(1, 41)], "id bigint, rank int")
    scores = spark.createDataFrame([(i, float(i)) for i in range(1, 32)], "id bigint, score double")
    order = [r.id for r in retrieval.rerank(ranked, scores).orderBy("position").collect()]
    assert order == list(range(31, 0, -1)) + [32] + list(range(33, 41))


def test_islands_do_not_join_touching(spark):
    s = spark.createDataFrame([("f", 0, 10, 1.0, "a"), ("f", 5, 12, 3.0, "b"), ("f", 12, 20, 2.0, "c"), ("g", 0, 1, 1.0, "d"), ("f", 0, 30, 0.5, "e")], "p string, a int, b int, v double, m string")
    assert sorted(tuple(r) for r in retrieval.islands(s.where("m <> 'e'"), ["p"], "a", "b", "v", "m").collect()) == [("f", 0, 12, 3.0, 2), ("f", 12, 20, 2.0, 1), ("g", 0, 1, 1.0, 1)]
    assert retrieval.islands(s, ["p"], "a", "b", "v", "m").where("p = 'f'").count() == 1


EDGE = "caller_id string, target_id string"


def bfs(edges, seed, depth, reverse):
    level, out, frontier = {seed: 0}, [], [seed]
    for n in range(depth):
        nxt = []
        for f in frontier:
            for a, b in edges:
                x, y = (b, a) if reverse else (a, b)
                if x == f:
                    out.append((n, x, y))
                    if y and y not in level:
                        level[y] = n + 1
                        nxt.append(y)
        frontier = nxt
    return sorted(out)


@pytest.mark.parametrize("seed,reverse", [(0, False), (1, True), (2, False)])
def test_walk_against_plain_bfs(spark, seed, reverse):
    r = random.Random(seed)
    edges = sorted({(f"n{r.randrange(12)}", f"n{r.randrange(12)}") for _ in range(25)} | {("n1", "")})
    df, s = spark.createDataFrame(edges, EDGE), spark.createDataFrame([("n1",)], "node string")
    got = sorted((x.level, x.from_id, x.to_id) for x in graph.walk(df, s, 3, reverse).collect())
    assert got == bfs(edges, "n1", 3, reverse)


def test_cycle_depths(spark):
    df, s = spark.createDataFrame([("a", "b"), ("b", "a")], EDGE), spark.createDataFrame([("a",)], "node string")
    assert graph.walk(df, s, 2).count() == 2 and graph.walk(df, s, 1).count() == 1
    assert sorted(tuple(r) for r in graph.reached(df, s, 5).collect()) == [("a", 0), ("b", 1)]
    with pytest.raises(ValueError):
        graph.walk(df, s, 33)


def test_occurrences_and_pages(spark):
    sites = spark.createDataFrame([("s1", "p", ["t1", "t2"]), ("s2", "p", []), ("s3", "p", None)], "site_id string, path string, targets array<string>")
    assert sorted((r.site_id, r.target_id) for r in graph.occurrences(sites).collect()) == [("s1", "t1"), ("s1", "t2"), ("s2", ""), ("s3", "")]
    hub = spark.createDataFrame([(i // 10, i % 10) for i in range(113)], "a int, b int")
    seen, last, pages = 0, [-1, -1], []
    while page := graph.after(hub, ["a", "b"], last, 17).collect():
        pages.append(len(page))
        last = list(page[-1])
        seen += len(page)
    assert seen == 113 and pages == [17] * 6 + [11]


def test_budget(spark):
    df = spark.createDataFrame([(i, f"a{i}", f"b{i}") for i in range(31)], "k int, x string, y string")
    assert graph.within_budget(df, ["k"], ["x", "y"], 50).count() == 25


def test_layers(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("c", "d")], "source string, target string")
    n = spark.createDataFrame([(x,) for x in "abcde"], "node string")
    assert [tuple(r) for r in graph.closure_layers(e, n).orderBy("node").collect()] == [("a", "a", 0), ("b", "b", 1), ("c", "b", 1), ("d", "d", 2), ("e", "e", 0)]


def test_unique_match_and_probe(spark, rows):
    left = spark.createDataFrame([("x",), ("y",), ("z",), (None,)], "k string")
    right = spark.createDataFrame([("x", "1"), ("y", "2"), ("y", "3")], "k string, v string")
    got = {r.k: (r.v, r.reason) for r in resolution.unique_match(left, right, ["k"], "v").collect()}
    assert got == {"x": ("1", None), "y": (None, "duplicate"), "z": (None, "missing"), None: (None, "missing")}
    a, b = spark.createDataFrame([("1",), ("2",)], "a string"), spark.createDataFrame([("2",), ("3",)], "b string")
    assert rows(resolution.single_probe(("a", a), ("b", b))) == [("1", "a"), ("3", "b")]


def test_aliases(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "x"), ("w", "x"), ("s", "s"), ("n", None)], "name string, target string")
    got = {r.name: (r.final, r.hops, r.reason) for r in resolution.follow_aliases(df).collect()}
    assert got["a"] == ("d", 3, None) and got["c"] == ("d", 1, None) and all(got[k][2] == "cycle" for k in "xyws")


def test_nearest_binding(spark):
    scopes = spark.createDataFrame([("f", 0, -1), ("f", 1, 0), ("f", 2, 1)], "path string, ordinal int, parent int")
    b = spark.createDataFrame([("f", 0, "g", "mod"), ("f", 1, "g", "outer"), ("f", 0, "h", "m1"), ("f", 0, "h", "m2")], "path string, scope int, name string, value string")
    s = spark.createDataFrame([("s1", "f", 2, "g"), ("s2", "f", 0, "g"), ("s3", "f", 2, "h"), ("s4", "f", 2, "q")], "site_id string, path string, scope int, name string")
    got = {r.site_id: (r.value, r.reason) for r in resolution.nearest_binding(s, scopes, b).collect()}
    assert got == {"s1": ("outer", None), "s2": ("mod", None), "s3": (None, "ambiguous"), "s4": (None, "unbound")}


def test_longest_prefix_owner(spark):
    items = spark.createDataFrame([("a/b/c",), ("a/bc",), ("z",), (None,)], "p string")
    owners = spark.createDataFrame([("a", "A"), ("a/b", "B")], "d string, o string")
    assert {r.p: r.o for r in resolution.longest_prefix_owner(items, "p", owners, "d", "o").collect()} == {"a/b/c": "B", "a/bc": "A", "z": None, None: None}


def test_snapshot_changes_and_dirty(spark, rows):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", None)], "p string, d string")
    new = spark.createDataFrame([("a", "2"), ("c", None), ("e", "1")], "p string, d string")
    assert rows(snapshot.changes(old, new, "p", "d")) == [("a", "M"), ("b", "D"), ("e", "A")]
    cat = {r.p: (r.action, r.v) for r in snapshot.catalog(old.withColumn("v", F.lit(7)), new, "p", "d", ["v"]).collect()}
    assert cat == {"a": ("changed", None), "c": ("reused", 7), "e": ("new", None)}
    deps = spark.createDataFrame([("u", "file", "k", "f1", True), ("v", "file", "absent", "", False), ("w", "file", "gone", "g", True), ("x", "file", "k", "f0", True)], "path string, kind string, key string, fingerprint string, present boolean")
    now = spark.createDataFrame([("file", "k", "f1"), ("file", "absent", "n")], "kind string, key string, fingerprint string")
    rec = spark.createDataFrame([("r", True), ("s", False)], "path string, changed boolean")
    assert rows(snapshot.dirty(rec, deps, now)) == [("r", "changed"), ("v", "appeared"), ("w", "disappeared"), ("x", "dependency")]


def test_fingerprint_does_not_depend_on_order(spark):
    a = spark.createDataFrame([("g", 2, "y"), ("g", 1, "x"), ("h", 1, "z")], "g string, o int, v string")
    f = lambda df: sorted(tuple(r) for r in ids.fingerprint(df, ["g"], F.col("v"), F.col("o")).collect())
    assert f(a) == f(a.repartition(3, "o"))


def test_coverage(spark):
    df = spark.createDataFrame([(f"l{i:02}", "parsed") for i in range(40) for _ in range(40 - i)] + [(None, None)], "language string, status string")
    got = {(r.language, r.status): r.files for r in coverage.by_language(df).collect()}
    assert got[("(other)", "parsed")] + sum(v for k, v in got.items() if k[0].startswith("l")) + got.get(("(unknown)", "(none)"), 0) >= df.count() - 1
    n = df.agg(F.count("*").alias("n"))
    assert coverage.violations(n, ("x", coverage.by_language(df), "files")).count() == 0
    assert coverage.violations(n, ("x", coverage.by_language(df).limit(3), "files")).count() == 1


def test_quality_measures(spark):
    df = spark.createDataFrame([("q", 1, False), ("q", 3, True), ("r", 7, True), ("s", 1, False)], "query string, rank int, relevant boolean")
    assert tuple(evaluation.retrieval_quality(df).first()) == (3, round(1 / 3, 6), round((1 / 3 + 1 / 7) / 3, 6))
    r = random.Random(5)
    for n in (1, 2, 19, 20, 21, 400):
        values = [r.choice([r.random() * 100, 7.0, -3.5]) for _ in range(n)]
        x = spark.createDataFrame([("g", v) for v in values] + [("g", None), ("h", 4.0)], "g string, x double")
        got = {q.g: tuple(q)[1:] for q in evaluation.ranked_values(x, ["g"], "x", a=evaluation.p95_floor, b=evaluation.p95_ceil, c=evaluation.median_low).collect()}
        values.sort()
        assert got == {"g": (values[int(0.95 * (n - 1))], values[math.ceil(0.95 * n) - 1], values[(n - 1) // 2]), "h": (4.0, 4.0, 4.0)}
    g, a = spark.createDataFrame([(1,), (2,), (2,), (3,)], "k int"), spark.createDataFrame([(1,), (2,), (4,)], "k int")
    assert {r.verdict: r.rows for r in evaluation.grade(g, a, ["k"]).collect()} == {"matched": 1, "repeated": 1, "missing": 1, "unexpected": 1}
    assert evaluation.same_rows(g, g).count() == 0 and evaluation.same_rows(g, a).count() == 3


def test_allocation_is_balanced(spark):
    a = evaluation.allocation(spark, 4, 8).groupBy("question", "condition").count().collect()
    assert {r["count"] for r in a} == {8} and len(a) == 4 or sum(r["count"] for r in a) == 32


def test_salted_join_with_a_hot_key(spark):
    left = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    right = spark.createDataFrame([("hot", 1), ("4", 2)], "k string, v int")
    assert salted_join(left, right, ["k"], F.col("id")).count() == 1001
    assert salted_join(left, right, ["k"], F.col("id"), "left").count() == 3000
