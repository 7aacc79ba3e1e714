import random

import pytest
from pyspark.sql import functions as F

from stratalode.operators import facts, graph, models, retrieval
from stratalode.sources import inventory, sinks
from stratalode.sources.pointers import Folder


@pytest.mark.parametrize("seed", range(2))
def test_walk_against_memory(spark, seed):
    r = random.Random(seed)
    edges = list({(f"n{r.randrange(12)}", r.choice(["", f"n{r.randrange(12)}"])) for _ in range(25)})
    df = spark.createDataFrame(edges, "caller_id string, target_id string")
    seeds = spark.createDataFrame([("n0",), ("n1",), ("",), (None,)], "node string")
    for reverse in (False, True):
        got = sorted((x.level, x.from_id, x.to_id) for x in graph.walk(df, seeds, 3, reverse).collect())
        assert got == sorted(graph.local_walk(edges, ["n0", "n1", ""], 3, reverse))


def test_handles(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("",), (None,), ("gone",)], "target_id string")
    symbols = spark.createDataFrame([("a", "p", 0, 5), ("b", "p", 3, 50)], "id string, path string, start_byte bigint, end_byte bigint")
    files = spark.createDataFrame([("p", "S", 10)], "path string, sha256 string, bytes bigint")
    got = {r.target_id: (r.handle and r.handle.sha256, r.fault) for r in graph.handles(rows, symbols, files).collect()}
    assert got == {"a": ("S", None), "b": (None, "range_outside_source"), "": (None, None), None: (None, None), "gone": (None, "missing_declaration")}


def test_stored_facts_are_checked(spark):
    f = facts.collect(spark.createDataFrame([("a.py", "import os\n\ndef f(x):\n    def g():\n        return x\n    return g\n"), ("b.go", "package b\n\nfunc F() { F() }\n")], "path string, body string"))
    assert facts.faults(f).count() == 0
    bad = f.where("not (fact = 'scope' and ordinal = 1)").withColumn("end_byte", F.when(F.col("fact") == "import", F.lit(10_000)).otherwise(F.col("end_byte")))
    assert {(r.path, r.fault) for r in facts.faults(bad).collect()} == {("a.py", "unknown_scope"), ("a.py", "unknown_parent"), ("a.py", "range_outside_source")}
    assert {r.fault for r in facts.faults(f.union(f.where("fact = 'scope'"))).collect()} == {"repeated_scope"}


def test_response_cache_keeps_the_newest(spark, tmp_path):
    c = models.ResponseCache(spark, f"file://{tmp_path}/c", 3)
    assert c.get({"q": 1}) is None
    for i in range(5):
        c.put({"q": i}, {"a": i})
    assert [c.get({"q": i}) for i in range(5)] == [None, None, {"a": 2}, {"a": 3}, {"a": 4}]
    c.put({"q": 4}, "new")
    assert c.get({"q": 4}) == "new" and retrieval.shortlist_for(10) == 32 and retrieval.shortlist_for(40) == 40


def test_sure_roles(spark):
    df = spark.createDataFrame([("a", "tests", 0.9), ("a", "library", 0.95), ("b", "tests", 0.59), ("c", "other", 0.99), ("d", "runtime", 1.0), ("e", "tests", None), ("f", "tests", 1.2)], "directory string, role string, confidence double")
    assert {r.directory: r.role for r in models.sure_roles(df).collect()} == {"a": "library", "d": "runtime"}


def test_revision(spark, tmp_path):
    root = f"file://{tmp_path}/r"
    assert inventory.revision(spark, root) == {"revision": None, "dirty": None}
    git = Folder(spark, f"{root}/.git")
    git.write("HEAD", "ref: refs/heads/main\n")
    git.write("packed-refs", "# pack\nabc refs/heads/main\n")
    assert inventory.revision(spark, root)["revision"] == "abc"
    Folder(spark, f"{root}/.git/refs/heads").write("main", "def\n")
    assert inventory.revision(spark, root)["revision"] == "def"
    git.write("HEAD", "0123\n")
    assert inventory.revision(spark, root)["revision"] == "0123"


def test_offline_status_and_bookmarks():
    s = {"state": "ready", "secret": "x", "receipt": {"files": 3, "path": "/home"}}
    assert sinks.offline_status(s, {"state": True, "receipt": {"files": True}, "none": True}) == '{"state":"ready","receipt":{"files":3}}'
    with pytest.raises(ValueError):
        sinks.offline_status({"state": "x" * 70_000}, {"state": True})
    fields = {"seed": str, "depth": int}
    text = sinks.bookmark({"seed": "a/ü", "depth": 2})
    assert sinks.opened(text, fields) == {"seed": "a/ü", "depth": 2}
    for bad in (text[:-2] + ("AA" if text[-2:] != "AA" else "BB"), sinks.bookmark({"other": 1}), sinks.bookmark({"depth": "2"})):
        with pytest.raises(ValueError):
            sinks.opened(bad, fields)
    with pytest.raises(ValueError):
        sinks.bookmark({"seed": "x" * 40_000})
