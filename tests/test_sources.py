import json

import pytest
from pyspark.sql import functions as F

from stratalode.functions import bytes as B
from stratalode.operators import answers, contracts, coverage, evidence, facts
from stratalode.operators.answers import Budget
from stratalode.plans.facade import Index
from stratalode.sources import generations, inventory, sinks, xmlconfig
from stratalode.sources.shared import cut, shared_folder
from stratalode.streaming import refresh


def test_inventory(spark, tmp_path):
    for name, text in {"a/x.py": b"1", "a/.hidden/y.py": b"2", "node_modules/z.js": b"3", "b c+%20.md": b"q" * 70000}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text)
    got = {r.path: r.bytes for r in inventory.scan(spark, f"file://{tmp_path}").collect()}
    assert got == {"a/x.py": 1, "b c+%20.md": 70000}
    heads = {r.path: (len(r.head), r.sha256) for r in inventory.read(spark, str(tmp_path)).collect()}
    assert heads["b c+%20.md"][0] == 65536 and heads["a/x.py"][1].startswith("6b86b2")
    assert [r.path for r in inventory.read(spark, str(tmp_path), most=100).collect()] == ["a/x.py"]


def test_windows_and_excerpts():
    text = "é" * 5000 + "\n漢" * 10
    data = text.encode()
    w = B.windows(data, 8192)
    assert b"".join(data[a:b] for a, b in w) == data and all(b - a <= 8192 for a, b in w)
    for a, b in w:
        data[a:b].decode()
    assert B.windows(b"") == []
    s = "x é sk-" + "a" * 30 + " end"
    spans = B.secret_spans(s)
    assert B.blank(s.encode(), spans).decode() == "x é [redacted] end"
    for n in range(0, 40):
        shown, cutpoint = B.excerpt(s.encode(), spans, n)
        assert len(shown) <= n or cutpoint == 0
        s.encode()[:cutpoint].decode()
    assert B.excerpt(s.encode(), spans, 999)[1] == len(s.encode())


def test_byte_windows(spark):
    df = spark.createDataFrame([(1, "a\nb\n" * 3), (2, None), (3, ""), (4, "-----BEGIN PRIVATE KEY-----")], "id bigint, t string")
    rows = B.byte_windows(df, "id", "t", 8).orderBy("window").collect()
    assert [(r.start_byte, r.end_byte, r.start_line, r.end_line) for r in rows] == [(0, 8, 1, 4), (8, 12, 5, 6)]
    assert B.excerpts(df, "id", "t", 3).where("id = 1").first().truncated


XML = b'<odoo>\n <record id="a" model="m"><field name="n" eval="1">x &amp; y</field><field name="c"><b/></field></record>\n <record id="b" model="m"/>\n</odoo>'


def test_xml(spark):
    found = xmlconfig.records(XML)
    assert [XML[r["start"] : r["end"]][:14] for r in found] == [b'<record id="a"', b'<record id="b"']
    assert XML[found[0]["start"] : found[0]["end"]].endswith(b"</record>")
    assert found[0]["fields"][0] == {"name": "n", "attributes": {"name": "n", "eval": "1"}, "content": "x & y", "children": False} and found[0]["fields"][1]["children"]
    df = spark.createDataFrame([("f", bytearray(XML)), ("g", bytearray(XML)), ("bad", bytearray(b"<!DOCTYPE x [<!ENTITY a 'b'>]><x/>")), ("cut", bytearray(b"<a>")), ("n", None)], "path string, content binary")
    got = xmlconfig.configuration(df)
    assert got.where("error is not null").count() == 2 and got.where("path = 'f'").count() == 3
    assert {r.record_id: r.records for r in xmlconfig.duplicate_ids(got).collect()} == {"a": 2, "b": 2}


def test_generations(spark, tmp_path):
    s = generations.Store(spark, f"file://{tmp_path}/s")
    with pytest.raises(LookupError):
        s.read("t")
    one, two = spark.range(1), spark.range(2)
    g = s.write({"t": one})
    assert s.current() == 0 and s.publish(g, 0) and s.current() == 1
    a, b = generations.Store(spark, s.folder), generations.Store(spark, s.folder)
    ga = a.write({"t": two})
    assert a.publish(ga, 1) and not b.publish(ga, 1) and s.read("t").count() == 2 and s.read("t", 1).count() == 1
    assert generations.lifecycle(s, "x", lambda: {"t": one}) == 3 and s.attempt_state("x")["state"] == "ready"
    with pytest.raises(ValueError):
        s.attempt("x", "updating")

    def fails():
        raise KeyError("z")

    with pytest.raises(KeyError):
        generations.lifecycle(s, "y", fails)
    assert s.current() == 3 and s.attempt_state("y") == {"attempt": "y", "state": "failed", "error": "KeyError"} and s.tables() == ["t"]


def test_a_writer_that_loses_leaves_the_winner_alone(spark, tmp_path):
    a, b = (generations.Store(spark, f"file://{tmp_path}/s") for _ in range(2))
    expected = a.current(), b.current()
    ga = a.write({"t": spark.range(3)})
    assert a.publish(ga, expected[0])
    gb = b.write({"t": spark.range(7)})
    assert not b.publish(gb, expected[1])
    assert a.current() == 1 and a.read("t").count() == 3 and a.generation_of(gb) is None and a.generation_of(ga) == 1


def test_publication_that_cannot_be_told(spark, tmp_path, monkeypatch):
    s = generations.Store(spark, f"file://{tmp_path}/s")

    def lost(*_):
        raise OSError("no answer")

    with monkeypatch.context() as m:
        m.setattr(s.files, "claim", lost)
        with pytest.raises(OSError):
            generations.lifecycle(s, "u", lambda: {"t": spark.range(1)})
        assert s.attempt_state("u")["state"] == "failed"
        m.setattr(s, "generation_of", lost)
        with pytest.raises(OSError):
            generations.lifecycle(s, "v", lambda: {"t": spark.range(1)})
    assert s.attempt_state("v")["state"] == "publication_uncertain" and s.current() == 0


PY = """import helper
from pkg.util import tool as t

def leaf(x):
    return x

def outer(cb):
    def inner():
        return leaf(1)
    inner()
    t(2)
    helper.run()
    cb()
    later = leaf
    return obj.m().n()

class A:
    def leaf(self):
        return leaf(3)
"""
FILES = [("main.py", PY), ("helper.py", "def run():\n    pass\n"), ("pkg/util.py", "def tool(a):\n    return a\n"), ("bad.py", "def f(:\n"), ("e.py", ""), ("n.py", None), ("x.md", "call()"),
         ("s/a.go", 'package s\n\n// f(1)\ntype T struct{}\n\nfunc (t *T) Do(x int) int {\n\treturn Help("g(2)")\n}\n\nfunc Help(s string) int { return 1 }\n'),
         ("w/a.ts", "export function go(a: number) {\n  return stop(`f(${a})`);\n}\nexport class K {\n  run(x) {\n    go(1);\n  }\n}\nconst stop = (x: string) => x;\n")]


def test_facts_and_resolution(spark):
    f = facts.collect(spark.createDataFrame(FILES, "path string, body string"))
    names = {(r.path, r.name, r.kind) for r in facts.symbols(f).collect()}
    assert {("main.py", "leaf", "function"), ("main.py", "outer.inner", "function"), ("main.py", "A", "class"), ("main.py", "A.leaf", "method"), ("s/a.go", "T.Do", "method"), ("s/a.go", "Help", "function"), ("w/a.ts", "K.run", "method"), ("w/a.ts", "stop", "function_value")} <= names
    calls = facts.resolve(f).where("role = 'call'")
    got = {(r.path, r.name): (r.certainty, r.target_id and r.target_id.split("#")[0] + "#" + r.target_id.split("#")[1].split("@")[0], r.reason) for r in calls.collect()}
    assert got[("main.py", "leaf")] == ("resolved", "main.py#leaf", None) and got[("main.py", "inner")] == ("resolved", "main.py#outer.inner", None)
    assert got[("main.py", "t")] == ("candidate", "pkg/util.py#tool", None) and got[("main.py", "helper.run")] == ("candidate", "helper.py#run", None)
    assert got[("main.py", "cb")] == ("unresolved", None, "not_callable") and got[("main.py", None)][2] == "computed"
    assert got[("s/a.go", "Help")] == ("resolved", "s/a.go#Help", None) and got[("w/a.ts", "stop")][0] == "resolved" and got[("w/a.ts", "go")][0] == "resolved"
    assert not any(p == "bad.py" for p, _ in got) and f.where("fact = 'error'").count() == 1
    text = PY.encode()
    for r in facts.symbols(f).where("path = 'main.py' and kind = 'function'").collect():
        assert text[r.start_byte : r.end_byte].startswith(b"def ")
    assert facts.resolve(facts.collect(spark.createDataFrame([], "path string, body string"))).count() == 0


MORE = [
    ("p/a.py", "import os\nfrom p.b import make as build\nfrom p import b\n\ndef top(x):\n    late()\n    def late():\n        return 1\n    again = build\n    once = again\n    once(1)\n    loop1 = loop2\n    loop2 = loop1\n    loop1()\n    b.make(2)\n    keep = [top, build]\n    return os.getcwd\n\nif x:\n    from p.b import other\nother()\n\n@build\nclass C(b.Base, metaclass=M):\n    pass\n"),
    ("p/b.py", "def make(v):\n    return v\n\ndef _own():\n    return make\n\nclass Base:\n    pass\n\nhelper, (second, *rest) = 1, (2, 3)\n"),
    ("g/one/a.go", 'package one\n\nimport (\n\t"g/two"\n\tt "g/two" // again\n\t"fmt"\n)\n\nfunc Run() {\n\ttwo.Make()\n\tt.Lost()\n\tfmt.Println()\n\tshared()\n}\n'), ("g/one/b.go", "package one\n\nfunc shared() int { return 1 }\n"), ("g/two/c.go", "package two\n\nfunc Make() {}\n"),
    ("w/x.ts", "import dflt, { one as uno } from './lib/y';\nimport * as all from './lib/y';\nconst { two } = require('./lib/y');\n// import { no } from './no';\nconst same = uno;\nexport function go() {\n  dflt();\n  uno();\n  all.two();\n  two();\n  same();\n  missing();\n}\n"), ("w/lib/y.ts", "export function one() {}\nexport function two() {}\nexport default function main() {}\nfunction hidden() {}\n"),
]


def test_names_across_files(spark):
    f = facts.collect(spark.createDataFrame(MORE, "path string, body string"))
    short = lambda t: t and t.split("#")[0].rsplit("/", 1)[-1] + "#" + t.split("#")[1].split("@")[0]
    rows = facts.resolve(f).collect()
    got = {(r.path.rsplit("/", 1)[-1], r.name): (short(r.target_id) or r.reason, r.certainty) for r in rows if r.role == "call"}
    assert got[("a.py", "late")] == ("use_before_declaration", "unresolved") and got[("a.py", "once")] == ("b.py#make", "candidate") and got[("a.py", "b.make")] == ("b.py#make", "candidate")
    assert got[("a.py", "loop1")][0] in ("alias_cycle", "use_before_declaration") and got[("a.py", "other")] == ("not_callable", "unresolved")
    assert got[("a.go", "two.Make")] == ("c.go#Make", "candidate") and got[("a.go", "t.Lost")][0] == "member_missing" and got[("a.go", "fmt.Println")][0] == "import_missing" and got[("a.go", "shared")] == ("b.go#shared", "candidate")
    assert {n: got[("x.ts", n)][0] for n in ("dflt", "uno", "all.two", "two", "same", "missing")} == {"dflt": "y.ts#main", "uno": "y.ts#one", "all.two": "y.ts#two", "two": "y.ts#two", "same": "y.ts#one", "missing": "unbound"}
    refs = {(r.path.rsplit("/", 1)[-1], r.name): short(r.target_id) or r.reason for r in rows if r.role == "reference"}
    assert refs[("a.py", "top")] == "a.py#top" and refs[("b.py", "make")] == "b.py#make" and refs[("a.py", "os.getcwd")] == "import_missing"
    assert {(r.kind, r.value) for r in f.where("fact = 'syntax'").collect()} == {("decorator", "build"), ("base", "b.Base")}
    assert {r.name for r in f.where("path = 'p/b.py' and fact = 'binding' and kind = 'unknown' and value = 'assignment'").collect()} == {"helper", "second", "rest"}
    e = {r.path: r.exports for r in facts.exports(f).collect()}
    assert e["p/b.py"] == 2 and e["g/two/c.go"] == 1 and e["w/lib/y.ts"] == 3 and "g/one/b.go" not in e


def test_facade(spark, tmp_path, monkeypatch):
    ix = Index(spark, f"file://{tmp_path}/ix")
    assert ix.status()["state"] == "not_indexed"
    ix.analyze(spark.createDataFrame([f for f in FILES if f[1] is not None], "path string, body string"), "first")
    assert ix.status()["generation"] == 1 and ix.map()["tree"].where("directory = ''").first().files == 8
    assert ix.search("tool", limit=2).first().path in ("main.py", "pkg/util.py")
    rows, cur = ix.query("symbol", limit=3)
    seen = [r["id"] for r in rows]
    while cur:
        rows, cur = ix.query("symbol", limit=3, cursor=cur)
        seen += [r["id"] for r in rows]
    assert len(seen) == len(set(seen)) == facts.symbols(facts.collect(spark.createDataFrame(FILES, "path string, body string"))).count()
    _, cur = ix.query("symbol", limit=3)
    with pytest.raises(ValueError):
        ix.query("symbol", limit=3, scope="main", cursor=cur)
    leaf = next(s for s in seen if s.startswith("main.py#leaf@"))
    callers, _ = ix.query("callers", seed=leaf)
    assert len(callers) == 2
    reach, _ = ix.query("impact", seed=leaf, depth=3)
    assert len(reach) >= 2 and ix.impact("main.py").count() > 3
    # the second analysis collects what changed only, and knows the same as a clean one
    later = [f if f[0] != "helper.py" else ("helper.py", "def run():\n    return other()\n") for f in FILES if f[1] is not None and f[0] != "e.py"]
    read = []
    real = facts.collect

    def collect(files):
        read.extend(r.path for r in files.select("path").collect())
        return real(files)

    monkeypatch.setattr(facts, "collect", collect)
    ix.analyze(spark.createDataFrame(later, "path string, body string"), "second")
    assert read == ["helper.py"]
    clean = facts.resolve(real(spark.createDataFrame(later, "path string, body string")))
    key = lambda df: sorted(map(str, df.select("site_id", "target_id", "reason").collect()))
    assert key(ix.store.read("sites")) == key(clean)
    for bad in ({"query": ""}, {"query": "x", "limit": 51}, {"query": "x", "mode": "other"}, {"query": "x", "mode": "semantic"}):
        with pytest.raises(ValueError):
            ix.search(**bad)


IDENTITY = ", ".join(f"{f} string" for f in contracts.FIELDS)
B_SCHEMA = f"id string, service_id string, role string, contract_id string, {IDENTITY}, endpoint_reason string, claimed_generated boolean, expected_sha256 string"
C_SCHEMA = f"id string, {IDENTITY}, artifact_sha256 string, contract_reason string"
HTTP = dict(protocol="http", contract_service_id="api", namespace="n", method="GET", path="/x", operation="op", operation_ref="o", request_schema="s", response_schema="r")
RPC = dict(protocol="rpc", contract_service_id="api", namespace="n", rpc_service="S", operation="Get", request_schema="s", response_schema="r")
QUEUE = dict(protocol="queue", contract_service_id="bus", namespace="n", topic="t", schema="s")


def frame(spark, rows, schema):
    names = [c.split(" ")[0] for c in schema.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def test_contract_cascade(spark):
    c = [dict(HTTP, id="h", artifact_sha256="a"), dict(RPC, id="r", artifact_sha256="a"), dict(QUEUE, id="q", artifact_sha256="a"), dict(HTTP, id="gone"), dict(HTTP, id="dup", artifact_sha256="a"), dict(HTTP, id="old", artifact_sha256="a", contract_reason="stale_artifact_digest"), dict(HTTP, id="bad", artifact_sha256="a")]
    b = [dict(HTTP, id="srv", service_id="api", role="server", contract_id="h"), dict(QUEUE, id="con", service_id="any", role="consumer", contract_id="q"), *[dict(HTTP, id=f"d{k}", service_id="api", role="server", contract_id="dup") for k in (1, 2)], dict(HTTP, id="foreign", service_id="other", role="server", contract_id="h"), dict(HTTP, id="sb", service_id="api", role="server", contract_id="bad", endpoint_reason="missing_binding_source")]
    web, sender = dict(HTTP, role="client", contract_id="h", service_id="web"), dict(QUEUE, role="producer", contract_id="q", service_id="web")
    caller = dict(RPC, role="client", contract_id="r", service_id="web")
    cases = {
        "ok": web, "origin_source_affinity_unqualified": dict(web, endpoint_reason="x"), "computed_service": dict(web, contract_service_id=None), "missing_service": dict(web, contract_service_id=""), "computed_route": dict(web, path=None), "missing_route": dict(web, path=""),
        "missing_contract": dict(web, contract_id="zz"), "missing_artifact_source": dict(web, contract_id="gone"), "unqualified_generated_claim": dict(web, claimed_generated=True), "stale_artifact": dict(web, expected_sha256="b"), "schema_mismatch": dict(web, request_schema="t"), "binding_contract_identity_mismatch": dict(web, method="PUT"),
        "stale_artifact_digest": dict(web, contract_id="old"), "duplicate_endpoint_bindings": dict(web, contract_id="dup"), "missing_operation": dict(caller, operation="None"), "rpc_service_and_operation_not_matched": dict(caller, operation="op"), "missing_server_binding": caller, "missing_binding_source": dict(web, contract_id="bad"),
        "queue_ok": sender, "computed_topic": dict(sender, topic=None), "namespace_mismatch": dict(sender, namespace="o"),
    }
    df = frame(spark, b + [dict(v, id=k) for k, v in cases.items()], B_SCHEMA)
    got = {r.binding_id: r for r in contracts.matches(df, frame(spark, c, C_SCHEMA)).collect()}
    assert got.keys() == cases.keys()
    assert {i: r.reason for i, r in got.items() if i not in ("ok", "queue_ok")} == {i: i for i in cases if i not in ("ok", "queue_ok")}
    assert got["ok"].target_binding_id == "srv" and got["queue_ok"].target_binding_id == "con"
    assert {r for r in got if got[r].reason} <= {*contracts.REASONS, "missing_binding_source"}
    assert contracts.matches(df.limit(0), frame(spark, c, C_SCHEMA)).count() == 0 and contracts.matches(df, frame(spark, [], C_SCHEMA)).where("certainty = 'resolved'").count() == 0
    wrong = [dict(HTTP, id="a"), dict(HTTP, id="b", topic="t"), dict(QUEUE, id="c", topic=""), dict(RPC, id="d", operation="x" * 2000), dict(HTTP, id="e", protocol="mail")]
    assert {r.id: r.reason for r in contracts.invalid(frame(spark, wrong, C_SCHEMA)).collect()} == {"b": "foreign_field", "c": "incomplete_identity", "d": "field_too_long", "e": "unknown_protocol"}


def test_function_evidence(spark, tmp_path):
    body = "def alpha(x):\n    return 'AKIA" + "Q" * 16 + "' + beta(x)  # gamma ray\n"
    s = [("m.py:0:1", "m.py", "alpha", "function", True, 0, 1, body), ("m.py:9:1", "m.py", "Box.beta", "method", True, 900, 40, "def beta(self):\n    return 'gamma'\n" * 3), ("m.py:5:5", "m.py", "C", "class", False, 300, 20, "class C: pass"), ("k.py:0:1", "k.py", "key", "function", True, 0, 1, "def key():\n    # -----BEGIN PRIVATE KEY-----"), ("m.py:7:7", "m.py", "nul", "function", True, 0, 1, None)]
    symbols = spark.createDataFrame(s, "id string, path string, name string, kind string, callable boolean, start_byte bigint, start_line int, text string")
    files = spark.createDataFrame([("m.py", "python", "parsed", "S", 5000), ("k.py", "python", "partial_parse", "K", 400)], "path string, language string, status string, sha256 string, bytes bigint")
    chunks = evidence.function_chunks(symbols, files, 40).persist()
    rows = chunks.orderBy("path", "start_byte").collect()
    assert {r.name for r in rows} == {"alpha", "Box.beta"} and "AKIA" not in "".join(r.body for r in rows) and any(r.redacted for r in rows)
    alpha = [r for r in rows if r.name == "alpha"]
    assert [(r.start_byte, r.end_byte) for r in alpha] == [(k, min(k + 40, len(body))) for k in range(0, len(body), 40)] and alpha[0].start_line == 1 and len({r.chunk_key for r in rows}) == len(rows)
    c = evidence.projection_counters(symbols, files, chunks).first()
    assert (c.symbols, c.partial_symbols, c.excluded_private_keys, c.excluded_kinds, c.chunks) == (4, 1, 1, 1, len(rows))
    assert evidence.broken_chunks(chunks, files).count() == 0
    bad = chunks.withColumn("body", F.when(F.col("name") == "alpha", F.lit("x")).otherwise(F.col("body")))
    assert {r.reason for r in evidence.broken_chunks(bad, files).collect()} == {"body_differs"}
    assert {r.reason for r in evidence.broken_chunks(chunks, files.withColumn("sha256", F.lit("T"))).collect()} == {"stale_source"}
    store = generations.Store(spark, f"file://{tmp_path}/e")
    evidence.index(chunks, store)
    hits = evidence.function_search(store, "alpha").collect()
    assert hits[0].start_byte == 0 and hits[0].members == ["m.py:0:1"] and [r.score for r in hits] == sorted((r.score for r in hits), reverse=True)
    gamma = evidence.function_search(store, "gamma").collect()
    assert {m for r in gamma for m in r.members} == {"m.py:0:1", "m.py:9:1"}
    cut = evidence.function_search(store, "gamma", budget=Budget(work=None, edges=None, excerpt_bytes=60)).collect()
    assert cut[-1].stop == "excerpt_budget_exceeded" and evidence.function_search(store, "unknown words").count() == 0
    handle = {"id": "m.py:0:1", "path": "m.py", "start_byte": 0, "end_byte": 99, "sha256": "S"}
    known = symbols.withColumn("end_byte", F.lit(99).cast("bigint"))
    assert "[redacted]" in evidence.excerpt_at(known, files, handle).first().text and evidence.excerpt_at(known, files, handle | {"sha256": "T"}).count() == 0
    with pytest.raises(ValueError):
        evidence.excerpt_at(known, files, {"id": "x"})


def test_bounded_answers(spark):
    rows = spark.createDataFrame([(i, f"e{i // 3}", "x" * 10) for i in range(20)], "k int, e string, t string")
    stop = lambda **b: answers.bounded(rows, ["k"], Budget(**({"work": None, "edges": None, "entities": None, "response_bytes": None} | b)), ["e"], "t").collect()
    assert len(stop()) == 20 and stop()[-1].stop is None
    assert [r.stop for r in stop(edges=4)] == [None] * 4 + ["edge_budget_exceeded"]
    assert [r.stop for r in stop(entities=2)] == [None] * 6 + ["entity_budget_exceeded"] and len(stop(excerpt_bytes=35)) == 4
    assert stop(work=5)[-1].stop == "work_budget_exceeded" and stop(response_bytes=70)[-1].stop == "response_byte_budget_exceeded"
    for bad in (0, -1, True, 1.5):
        with pytest.raises(ValueError):
            Budget(edges=bad)
    assert answers.bounded(rows.limit(0), ["k"], Budget()).count() == 0
    one, two = rows.where("k < 3").select("k", "e"), rows.where("k between 2 and 5").select("k", "e")
    assert answers.merged_scene(one, two, "k", ["k"], 4).count() == 4
    with pytest.raises(ValueError):
        answers.merged_scene(one, two.withColumn("e", F.lit("other")), "k", ["k"])
    assert coverage.receipt_faults({"a": 3, "b": 1, "c": 2}, {"a": int, "b": int, "c": int}, {"a": ["b", "c"]}) == []
    assert coverage.receipt_faults({"a": 4, "b": 1, "c": 2}, {"a": int, "b": int, "c": int}, {"a": ["b", "c"]}) == ["total:a"]
    assert coverage.receipt_faults({"a": "x", "d": 1, "c": -1}, {"a": int, "b": int, "c": int}) == ["missing:b", "negative:c", "type:a", "unknown:d"]


def test_page_holds_no_markup(spark, tmp_path):
    sinks.page(spark, f"file://{tmp_path}/map.html", "a <b>", {"x": "</script><b>&"})
    text = (tmp_path / "map.html").read_text()
    assert "</script><b>" not in text and "a &lt;b&gt;" in text and json.loads(text.split('id="data">')[1].split("</script>")[0]) == {"x": "</script><b>&"}
    sinks.page(spark, f"file://{tmp_path}/map.html", "again", [])
    assert "again" in (tmp_path / "map.html").read_text()


def test_stream_counts_each_record_once(spark, tmp_path):
    at, schema = tmp_path / "in", "path string, stamp string, digest string"
    write = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{at}/t.parquet")
    write([("a", "1:1", "x"), ("b", "5:1", "y")])
    store = generations.Store(spark, f"file://{tmp_path}/state")
    go = lambda: refresh.refresh(refresh.source(spark, f"file://{at}", "t"), store, f"file://{tmp_path}/cp")
    assert go() == 1
    write([("a", "3:1", "x3"), ("b", "4:1", "late")])
    assert go() == 2 and go() == 2
    assert {r.path: r.digest for r in store.read("state").collect()} == {"a": "x3", "b": "y"}


def test_windowed_counts_schema(spark, tmp_path):
    spark.sql("select timestamp'2025-01-01 00:10:00' as ts, 'a' as event_type, 1.0d as value").write.parquet(f"file://{tmp_path}/e.parquet")
    q = refresh.windowed_counts(refresh.source(spark, f"file://{tmp_path}", "e")).writeStream.outputMode("complete").format("memory").queryName("wc").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.event_type, r.n) for r in spark.table("wc").collect()] == [("a", 1)]


def test_cut_reads_back(spark):
    assert shared_folder(spark) and cut(spark.range(3)).agg(F.sum("id")).first()[0] == 3
