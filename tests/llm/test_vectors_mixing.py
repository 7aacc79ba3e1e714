import numpy as np
import pytest

from stratalode.llm import mixing, neighbors


def brute(v, ids, k=5, least=-2.0):
    u = v / np.linalg.norm(v, axis=1)[:, None]
    s = np.round(u @ u.T, neighbors.PLACES)
    out = {}
    for i in range(len(v)):
        c = sorted((-s[i, j], ids[j]) for j in range(len(v)) if j != i and s[i, j] >= least)
        out[ids[i]] = [x[1] for x in c[:k]]
    return out


def frame(spark, v, ids):
    return spark.createDataFrame([(int(i), [float(x) for x in r]) for i, r in zip(ids, v)], "id bigint, vector array<float>")


def test_codes_favour_the_parallel_part():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    ours = neighbors.AnisotropicCodes.fit(x, 32)
    plain = neighbors.AnisotropicCodes.fit(x, 32, threshold=0.0)
    plain.eta = 1.0
    along = lambda c: np.mean(((x - c.decode(c.encode(x))) * x).sum(1) ** 2)
    assert along(ours) < along(plain)
    codes = ours.encode(x)
    assert codes.max() < 16 and (neighbors.unpack(neighbors.pack(codes), 32) == codes).all()


def test_small_collections_are_exact(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 16)).astype(np.float32)
    ids = list(range(100, 160))
    got = {}
    for r in neighbors.neighbors(frame(spark, v, ids), probes=8).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.neighbor)
    assert got == brute(v.astype(np.float64), ids)


def test_copies_and_dirty_rows(spark):
    v = np.array([[1, 0]] * 9 + [[0.99, 0.1], [0, 1]], np.float32)
    ids = list(range(11))
    extra = spark.createDataFrame([(50, None), (51, [0.0, 0.0]), (52, [float("nan"), 1.0]), (53, [1.0, 2.0, 3.0]), (54, [None, 1.0])], "id bigint, vector array<float>")
    df = frame(spark, v, ids).union(extra)
    got = {}
    for r in neighbors.neighbors(df, least=0.9).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.neighbor)
    assert got == {i: n for i, n in brute(v.astype(np.float64), ids, least=0.9).items() if n}
    pairs = {tuple(r) for r in neighbors.similar_pairs(df).collect()}
    assert all(a < b for a, b in pairs) and {(min(i, n), max(i, n)) for i, ns in got.items() for n in ns} == pairs
    assert neighbors.neighbors(df.limit(0)).count() == 0 and neighbors.similar_pairs(extra.where("id < 53")).count() == 0


def test_crowd_of_near_copies_is_scored_whole(spark):
    """A third of all rows in one dense group: one cell, far more near-copies than are reranked."""
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(1, 64))
    centre /= np.linalg.norm(centre)
    group = centre + 0.2 / 8 * rng.normal(size=(300, 64))
    v = np.concatenate([group, rng.normal(size=(600, 64))]).astype(np.float32)
    ids = list(range(len(v)))
    df = frame(spark, v, ids)
    got = {}
    for r in neighbors.neighbors(df, least=0.9).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.neighbor)
    want = brute(v.astype(np.float64), ids, least=0.9)
    assert len(want[0]) == 5 and got == {i: n for i, n in want.items() if n}
    found = {}
    for r in neighbors.search(df, df.where("id < 100")).orderBy("id", "rank").collect():
        found.setdefault(r.id, []).append(r.neighbor)
    assert found == {i: n for i, n in brute(v.astype(np.float64), ids).items() if i < 100}


def test_recall_of_cells_and_search(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "CELL", 100)
    monkeypatch.setattr(neighbors, "BLOCK", 64)
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(300, 32))
    v = np.concatenate([centre + 0.1 * rng.normal(size=centre.shape) for _ in range(5)]).astype(np.float32)
    ids = list(range(len(v)))
    df = frame(spark, v, ids)
    want = brute(v.astype(np.float64), ids, least=0.9)
    got = {}
    for r in neighbors.neighbors(df, least=0.9).collect():
        got.setdefault(r.id, set()).add(r.neighbor)
    hit, tot = sum(len(got.get(i, set()) & set(n)) for i, n in want.items()), sum(map(len, want.values()))
    assert hit / tot > 0.95
    full = brute(v.astype(np.float64), ids)
    found = {}
    for r in neighbors.search(df, df.where("id % 50 = 0")).collect():
        found.setdefault(r.id, set()).add(r.neighbor)
    asked = [i for i in ids if i % 50 == 0]
    assert sum(len(found[i] & set(full[i])) for i in asked) / (5 * len(asked)) >= 0.9


@pytest.mark.parametrize("cell, one_level", [(400, 4096), (100, 4096), (30, 4096), (30, 16)])
def test_recall_of_five_of_every_row(spark, monkeypatch, cell, one_level):
    """Neighbours far apart, at several numbers of cells and with two levels: the measured probes hold the recall."""
    monkeypatch.setattr(neighbors, "CELL", cell)
    monkeypatch.setattr(neighbors, "ONE_LEVEL", one_level)
    monkeypatch.setattr(neighbors, "BLOCK", 150)
    rng = np.random.default_rng(6)
    centre = rng.normal(size=(60, 24))
    v = (centre[rng.integers(0, 60, 3000)] + 1.2 * rng.normal(size=(3000, 24))).astype(np.float32)
    ids = list(range(len(v)))
    got = {}
    for r in neighbors.neighbors(frame(spark, v, ids)).collect():
        got.setdefault(r.id, set()).add(r.neighbor)
    want = brute(v.astype(np.float64), ids)
    assert all(len(got[i]) == 5 for i in ids)
    assert sum(len(got[i] & set(want[i])) for i in ids) / (5 * len(ids)) >= 0.9


def test_lengths_are_collections_of_their_own(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [1.0, 0.0, 0.0]), (4, [1.0, 0.0, 0.1]), (5, [])], "id bigint, vector array<float>")
    got = {(r.id, r.neighbor) for r in neighbors.neighbors(df).collect()}
    assert got == {(1, 2), (2, 1), (3, 4), (4, 3)}
    assert {(r.id, r.neighbor) for r in neighbors.search(df, df.where("id in (2, 3)")).collect()} == {(2, 1), (3, 4)}


DOC = "doc_id bigint, text string, source string, tokens int"


def world(spark):
    docs = [(i, f"alpha text {i} " * 10, "a", 0) for i in range(200)] + [(1000 + i, f"beta words {i} " * 10, "b", 0) for i in range(40)] + [(2000, "gamma", "c", 0), (2001, None, "a", 0), (2002, "free text", None, 0), (2003, "other", "unlisted", 0), (2004, "", "a", 0), (None, "beta words none", "b", 0)]
    return spark.createDataFrame(docs, DOC)


def test_mixture_reaches_feasible_targets(spark):
    targets = spark.createDataFrame([("a", 0.3, 2), ("b", 0.4, 4), ("c", 0.2, 3), ("none", 0.1, 2)], "source string, target_share double, max_repeats int")
    chosen, report = mixing.mixture(world(spark), targets)
    r = {x.source: x for x in report.collect()}
    rows = chosen.collect()
    assert all(1 <= x.repeats <= {"a": 2, "b": 4, "c": 3}[x.source] for x in rows) and len({x.doc_id for x in rows}) == len(rows)
    assert abs(r["a"].reached_share - 0.3) < 0.01 and abs(r["b"].reached_share - 0.4) < 0.01
    assert r["c"].chosen_rows == 3 and r["c"].short and r["none"].chosen_tokens == 0 and r["none"].documents == 0
    per = {}
    for x in rows:
        per[x.source] = per.get(x.source, 0) + x.tokens * x.repeats
    assert per == {s: x.chosen_tokens for s, x in r.items() if x.chosen_tokens}
    assert abs(sum(x.share_of_mixture for x in r.values()) - 1) < 1e-9


def test_mixture_of_empty_tables(spark):
    targets = spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int")
    none = world(spark).limit(0)
    chosen, report = mixing.mixture(none, targets)
    assert chosen.count() == 0 and report.first().chosen_tokens == 0
    chosen, report = mixing.mixture(world(spark), targets.limit(0))
    assert chosen.count() == 0 and report.count() == 0


def test_rates_meet_sources_domains_and_caps():
    one = np.array([1.0, 2.0])
    got = mixing.fit_rates(np.array([10.0, 10.0]), np.eye(2) * 10, np.array([0, 1]), one, np.array([50.0, 5.0]), np.array([0, 1]))
    assert np.allclose(got, [1.0, 0.5], atol=1e-4)
    # the second group of source 0 reads like domain 1: it gives way where that domain has too much
    expected = np.array([[100.0, 0.0], [0.0, 100.0], [0.0, 100.0]])
    got = mixing.fit_rates(np.array([100.0, 100.0, 100.0]), expected, np.array([0, 0, 1]), np.array([2.0, 2.0]), np.array([100.0, 100.0]), np.array([0, 1]))
    assert np.allclose(got, [1.0, 0.0, 1.0], atol=1e-3)


def test_classifier_never_sees_a_rows_own_label():
    """Sources a and b read alike and c doesn't: they form one domain, though every label is in the table."""
    rng = np.random.default_rng(3)
    rows = [(i, str(rng.choice(["a", "b"])), "same kind of words", "docs") for i in range(400)] + [(1000 + i, "c", "another matter altogether", "chat") for i in range(200)]
    models, domains = mixing.fit_classifier(["a", "b", "c", "none"], rows)
    assert sorted(map(sorted, domains)) == [[0, 1], [2], [3]]
    p = models[mixing.fold_of(0)].of("same kind of words", ("docs",))
    assert abs(p[0] - p[1]) < 0.2 and p[2] < 0.01


@pytest.mark.parametrize("text,n", [("", 0), ("hello world", 2)])
def test_token_counts(text, n):
    with open(mixing.RANKS, "rb") as f:
        assert mixing.token_counter(f.read())(text) == n
