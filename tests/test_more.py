import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from stratalode.operators import facts, frameworks, golang, impact, models, retrieval
from stratalode.sources import sinks, xmlconfig


def test_impact_over_files_and_symbols(spark):
    symbols = spark.createDataFrame([("f", "a.py"), ("g", "b.py"), ("h", "c.py"), ("u", "d.py")], "id string, path string")
    calls = spark.createDataFrame([("1", "b.py", "g", "f", "resolved"), ("2", "c.py", "h", "g", "candidate"), ("3", "b.py", "g", "", "unresolved"), ("4", "d.py", "u", "h", "resolved")], "site_id string, path string, caller_id string, target_id string, certainty string")
    imports = spark.createDataFrame([("5", "e.py", "b.py", "resolved"), ("6", "e.py", None, "unresolved")], "site_id string, path string, target_path string, certainty string")
    files = spark.createDataFrame([(p,) for p in ("a.py", "b.py", "c.py", "d.py", "e.py")], "path string")
    e = impact.links(calls, imports, symbols)
    rows, ends = impact.impact(e, files, ["a.py"], 2)
    assert sorted((r.level, r.site_id) for r in rows.collect()) == [(0, "1"), (1, "2"), (1, "5")]
    assert {r.reason: r["count"] for r in ends.collect()} == {"unresolved_call": 1, "unresolved_import": 1, "candidate_call": 1, "depth_limit": 1}
    rows, ends = impact.impact(e, files, ["a.py", "zz.py"], 5, certainties=("resolved",))
    assert sorted(r.site_id for r in rows.collect()) == ["1", "5"] and {r.reason for r in ends.collect()} == {"unresolved_call", "unresolved_import", "filtered", "area_not_in_inventory"}
    with pytest.raises(ValueError):
        impact.impact(e, files, ["."], 0)


def test_go_packages(spark, rows):
    f = spark.createDataFrame([("a/x.go", "a", None), ("a/y.go", "a", None), ("a/x_test.go", "zz", None), ("b/x.go", "b", None), ("b/y.go", "c", None), ("c/x.go", "c", "cgo"), ("d/x.go", None, None)], "path string, package string, reason string")
    got = {r.directory: (r.package, r.reason) for r in golang.packages(f).collect()}
    assert got == {"a": ("a", None), "b": (None, "packages_differ"), "c": (None, "cgo"), "d": (None, "package_unknown")}
    b = spark.createDataFrame([("a/x.go", "F", "definition", "1"), ("a/y.go", "G", "definition", "2"), ("a/y.go", "F2", "definition", "3"), ("a/x.go", "F2", "definition", "4"), ("a/x.go", "fmt", "import", "")], "path string, name string, kind string, value string")
    s = spark.createDataFrame([("s1", "a/x.go", "G"), ("s2", "a/x.go", "F2"), ("s3", "a/x.go", "fmt"), ("s4", "b/x.go", "F")], "site_id string, path string, name string")
    got = {r.site_id: (r.value, r.reason) for r in golang.resolve_in_package(s, b, golang.packages(f)).collect()}
    assert got == {"s1": ("2", None), "s2": (None, "ambiguous"), "s3": (None, "unbound"), "s4": (None, "packages_differ")}
    mods = spark.createDataFrame([("go.mod", "ex.org/m"), ("sub/go.mod", "ex.org/m/sub")], "path string, module string")
    p = spark.createDataFrame([("x/a.go",), ("sub/y/b.go",)], "path string")
    assert rows(golang.module_of(p, mods).select("path", "module")) == [("sub/y/b.go", "ex.org/m/sub"), ("x/a.go", "ex.org/m")]
    i = spark.createDataFrame([("ex.org/m/k",), ("ex.org/m/sub/q",), ("ex.org/m",), ("fmt",), ("ex.org/mm",)], "module string")
    assert {r.module: r.target_dir for r in golang.import_directory(i, mods).collect()} == {"ex.org/m/k": "k", "ex.org/m/sub/q": "sub/q", "ex.org/m": "", "fmt": None, "ex.org/mm": None}


URLS = """from django.urls import path, re_path, include
from . import views
from .views import detail as d
def local(request): pass
urlpatterns = [
    path('a/', views.index),
    path('b/', d, name='x'),
    re_path(r'^c$', local),
    path('inc/', include('app.urls')),
    path(PREFIX + 'e/', local),
    path('f/', lambda r: r),
    path('g/', views.Cls.as_view()),
    path(route='k/', view=local),
    other(),
]
"""
VIEWS = "def index(r): pass\ndef detail(r): pass\nclass Cls: pass\n"
ODOO = "from odoo import http, models\nclass C(http.Controller):\n    @http.route(['/x', '/y'])\n    def page(self): pass\n    @http.route(PATH)\n    def z(self): pass\nclass M(models.Model):\n    _name = 'sale.order'\n    def run(self): pass\n"
CRON = b'<odoo><record id="j" model="ir.cron"><field name="model_id" ref="sale.model_sale_order"/><field name="code">model.run()</field></record><record id="k" model="ir.cron"><field name="code">x</field></record></odoo>'


def test_frameworks(spark):
    files = spark.createDataFrame([("app/urls.py", URLS), ("app/views.py", VIEWS), ("m/management/commands/go.py", "class Command:\n    def handle(self): pass\n"), ("odoo/c.py", ODOO), ("bad.py", "urlpatterns = ["), ("mut.py", "urlpatterns = [path('a', b)]\nurlpatterns += []\n"), ("n.py", None)], "path string, body string")
    regs = frameworks.registrations(files)
    got = {(r.path, r.kind, r.pattern): (r.callback, r.role, r.reason) for r in regs.collect()}
    assert got[("app/urls.py", "route", "a/")] == ("views.index", "framework", None) and got[("app/urls.py", "include", "inc/")][0] == "app.urls"
    assert got[("app/urls.py", "route", "f/")] == (None, "framework_boundary", "lambda") and got[("mut.py", "route", "a")][2] == "mutated"
    assert got[("m/management/commands/go.py", "command", "go")][0] == "Command.handle" and got[("odoo/c.py", "route", "/y")][0] == "C.page" and got[("odoo/c.py", "route", None)][2] == "computed_pattern"
    targets = {(r.path, r.pattern): (r.target_id and r.target_id.split("@")[0], r.why) for r in frameworks.callbacks(regs, facts.collect(files)).collect()}
    assert targets[("app/urls.py", "a/")][0] == "app/views.py#index" and targets[("app/urls.py", "b/")][0] == "app/views.py#detail" and targets[("app/urls.py", "k/")][0] == "app/urls.py#local" and targets[("app/urls.py", "g/")][0] == "app/views.py#Cls"
    assert targets[("m/management/commands/go.py", "go")][0] == "m/management/commands/go.py#Command.handle"
    xml = xmlconfig.configuration(spark.createDataFrame([("d.xml", bytearray(CRON))], "path string, content binary"))
    jobs = {r.record_id: (r.target, r.reason) for r in frameworks.cron_jobs(xml, regs).collect()}
    assert jobs == {"j": ("odoo/c.py#M.run", None), "k": (None, "computed_call")}


def test_look_alikes_are_not_the_frameworks(spark):
    body = {
        "own.py": "from mine import path\nurlpatterns = [path('q', v)]\n", "alias.py": "import django.urls as u\nurlpatterns = [u.path('q', v)]\n", "twice.py": "from django.urls import path\nfrom mine import path\nurlpatterns = [path('q', v)]\n",
        "maybe.py": "try:\n    from django.urls import path\nexcept ImportError:\n    pass\nurlpatterns = [path('q', v)]\n", "made.py": "from django.urls import path\npath = wrap(path)\nurlpatterns = [path('q', v)]\n", "renamed.py": "from django.urls import re_path as r\nurlpatterns = [r('q', v)]\n",
        "a/management/commands/x.py": "from django.core.management.base import BaseCommand as B\nclass Command(B):\n    def handle(self): pass\n", "a/management/commands/y.py": "class Command(Other):\n    def handle(self): pass\n", "o.py": "from mine import route\nclass C:\n    @route('/a')\n    def f(self): pass\n",
    }
    got = {r.path: r.reason for r in frameworks.registrations(spark.createDataFrame(list(body.items()), "path string, body string")).collect()}
    assert {p for p, r in got.items() if r is None} == {"alias.py", "renamed.py", "a/management/commands/x.py"}
    assert all(got[p] == "api_identity_unproven" for p in ("own.py", "twice.py", "maybe.py", "made.py", "a/management/commands/y.py", "o.py"))


def test_impact_of_changes_and_contracts(spark):
    none = spark.createDataFrame([], "site_id string, path string, caller_id string, target_id string, certainty string")
    i = spark.createDataFrame([("1", "b.py", "a.py", "resolved"), ("2", "c.py", "gone.py", "resolved")], "site_id string, path string, target_path string, certainty string")
    c = spark.createDataFrame([("k", "client.py", "", "spec.yaml", "resolved")], "site_id string, path string, caller_id string, witness_path string, certainty string")
    e = impact.links(none, i, spark.createDataFrame([], "id string, path string"), c)
    files = spark.createDataFrame([(p,) for p in ("a.py", "b.py", "c.py", "client.py", "spec.yaml")], "path string")
    changed = spark.createDataFrame([("a.py",), ("gone.py",), ("spec.yaml",), (None,)], "path string")
    rows, why = impact.impact(e, files, [], 2, ("call", "import", "contract"), changed=changed)
    assert {(r.relation, r.source, r.target) for r in rows.collect()} == {("import", "file:b.py", "file:a.py"), ("import", "file:c.py", "file:gone.py"), ("contract", "file:client.py", "file:spec.yaml")}
    assert {r.reason: r["count"] for r in why.collect()} == {"changed_path_not_in_inventory": 1}


def test_models(spark):
    class Length:
        def rank(self, query, texts):
            return [len(t) for t in texts]

    class Broken:
        def rank(self, query, texts):
            raise RuntimeError

    class Wrong:
        def rank(self, query, texts):
            return [undefined_name for _ in texts]  # noqa: F821

    df = spark.createDataFrame([(1, "alpha beta", None), (2, "alpha beta", [3.0, 4.0]), (3, None, None), (4, "", None)], "id bigint, text string, vector array<float>")
    got = {r.id: r.vector for r in models.embed(df, "id", "text", lambda: models.HashedTerms(64)).collect()}
    assert abs(sum(x * x for x in got[1]) - 1) < 1e-6 and got[2] == [3.0, 4.0] and got[3] is None and got[4] is None
    hits = spark.createDataFrame([(i, i, "漢" * i) for i in range(1, 41)], "id bigint, rank int, evidence string")
    out, how = models.rerank_or_keep(hits.select("id", "rank"), hits, "q", Length)
    assert how == "ranked" and [int(r.id) for r in out.orderBy("position").limit(2).collect()] == [32, 31] and out.count() == 40
    with pytest.raises(PythonException):
        models.rerank_or_keep(hits.select("id", "rank"), hits, "q", Wrong)
    out, how = models.rerank_or_keep(hits.select("id", "rank"), hits, "q", Broken)
    assert how == "fallback" and [r.id for r in out.orderBy("position").limit(2).collect()] == [1, 2]
    assert retrieval.depth_for(3) == 50 and retrieval.depth_for(40) == 200


def test_sinks(spark, tmp_path):
    tree = spark.createDataFrame([("", 5), ("a", 3), ("b<c", 2), ("a/x", 1)], "directory string, files bigint")
    edges = spark.createDataFrame([("a", "b<c", 4), ("a", "zz", 1)], "source string, target string, count bigint")
    text = sinks.flowchart(tree, edges)
    assert text.splitlines() == ["flowchart LR", '  n0["root"]', '  n1["a (3)"]', '  n2["b_c (2)"]', "  n1 -->|4| n2"]
    sinks.graph_json(tree, edges, f"file://{tmp_path}/g")
    assert "<" not in "".join(r.value for r in spark.read.text(f"file://{tmp_path}/g/nodes").collect())
    sinks.guarded_csv(tree.withColumn("x", F.lit("=1")), f"file://{tmp_path}/c")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/c").first().x == "'=1"
    o = sinks.system_overview(tree, edges).first()
    assert (o.groups, o.relations, o.imports, o.omitted) == (4, 2, 5, 0)
