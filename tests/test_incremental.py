import random

import pytest
from pyspark.sql import functions as F

from stratalode.operators import incremental as inc


def spans(df):
    return sorted((r.lo, r.hi) for r in df.collect())


def numbers(pairs):
    return {x for lo, hi in pairs for x in range(lo, hi + 1)}


def test_intervals_are_disjoint_and_cut_at_blocks(spark):
    edge = inc.BLOCK
    df = spark.createDataFrame([(x,) for x in [1, 2, 2, 3, 7, edge - 1, edge, edge + 1, None]], "s bigint")
    assert spans(inc.to_intervals(df, "s")) == [(1, 3), (7, 7), (edge - 1, edge - 1), (edge, edge + 1)]


@pytest.mark.parametrize("seed", range(4))
def test_subtract_and_merge_against_sets(spark, seed):
    r = random.Random(seed)
    a, b = ({r.randrange(200) + (inc.BLOCK - 100) for _ in range(r.randrange(1, 150))} for _ in range(2))
    make = lambda s: inc.to_intervals(spark.createDataFrame([(x,) for x in s], "s bigint"), "s")
    gaps, both = spans(inc.subtract(make(a), make(b))), spans(inc.merge(make(a), make(b)))
    assert numbers(gaps) == a - b and numbers(both) == a | b
    assert all(x[1] < y[0] for x, y in zip(both, both[1:]))


def test_empty_sides(spark):
    none = spark.createDataFrame([], "block bigint, lo bigint, hi bigint")
    some = inc.to_intervals(spark.range(5), "id")
    assert spans(inc.subtract(none, some)) == [] and spans(inc.subtract(some, none)) == [(0, 4)] and spans(inc.merge(none, none)) == []


def test_rows_in_keeps_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a", 9), (2, "b", 8), (None, "c", 7)], "id bigint, block string, _lo int")
    got = inc.rows_in(df, "id", inc.to_intervals(df.where("id = 2"), "id"))
    assert got.columns == ["id", "block", "_lo"] and [tuple(r) for r in got.collect()] == [(2, "b", 8)]


def test_ledger_survives_failure_and_late_commits(spark, tmp_path):
    src = lambda ids: spark.createDataFrame([(i, f"v{i}") for i in ids], "id bigint, v string")
    ledger = inc.IntervalLedger(spark, f"file://{tmp_path}/ledger")
    assert ledger.generation() == 0 and ledger.output() is None
    assert ledger.run(src([1, 2, 5]), "id", lambda d: d) == 1

    def broken(d):
        d.count()
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        ledger.run(src([1, 2, 3, 5, 6]), "id", broken)
    assert ledger.generation() == 1
    ledger.run(src([1, 2, 3, 5, 6]), "id", lambda d: d)  # 3 came late, below the maximum
    ledger.run(src([1, 2, 3, 5, 6]), "id", lambda d: d)  # nothing new
    assert sorted(r.id for r in ledger.output().collect()) == [1, 2, 3, 5, 6]
    assert numbers(spans(ledger.intervals())) == {1, 2, 3, 5, 6}


def test_two_runs_from_the_same_generation(spark, tmp_path):
    """A run that is slow and loses neither touches nor hides what the other committed, and can be repeated."""
    src = spark.range(20).withColumn("v", F.col("id") * 2)
    at = f"file://{tmp_path}/ledger"
    slow, quick = inc.IntervalLedger(spark, at), inc.IntervalLedger(spark, at)

    def process(d):
        assert quick.run(src, "id", lambda x: x) == 1
        return d.where("id < 5")

    with pytest.raises(RuntimeError):
        slow.run(src, "id", process)
    assert slow.generation() == 1 and sorted(r.id for r in slow.output().collect()) == list(range(20))
    slow.run(src.union(spark.createDataFrame([(30, 60)], "id bigint, v bigint")), "id", lambda x: x)
    assert sorted(r.id for r in quick.output().collect()) == [*range(20), 30]


@pytest.mark.parametrize("step", range(4))
def test_ledger_killed_at_each_step(spark, tmp_path, monkeypatch, step):
    """The run dies in its n-th write or when it commits; the next run takes the same records."""
    from pyspark.sql.readwriter import DataFrameWriter

    ledger = inc.IntervalLedger(spark, f"file://{tmp_path}/ledger")
    ledger.run(spark.range(10), "id", lambda d: d)
    writes, real = [], DataFrameWriter.parquet

    def write(self, path, *a, **k):
        writes.append(path)
        if len(writes) > step:
            raise KeyboardInterrupt
        return real(self, path, *a, **k)

    def claim(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(DataFrameWriter, "parquet", write)
        m.setattr(ledger.files, "claim", claim)
        with pytest.raises(KeyboardInterrupt):
            ledger.run(spark.range(15), "id", lambda d: d)
    assert ledger.generation() == 1
    ledger.run(spark.range(15), "id", lambda d: d)
    assert sorted(r.id for r in ledger.output().collect()) == list(range(15))
    assert numbers(spans(ledger.intervals())) == set(range(15))


def test_adopted_intervals_have_no_output(spark, tmp_path):
    ledger = inc.IntervalLedger(spark, f"file://{tmp_path}/ledger")
    ledger.adopt(inc.to_intervals(spark.range(5), "id"))
    assert ledger.generation() == 1 and ledger.output() is None
    ledger.run(spark.range(8), "id", lambda d: d)
    assert sorted(r.id for r in ledger.output().collect()) == [5, 6, 7]


def test_rows_that_share_a_number(spark):
    df = spark.createDataFrame([(1, x) for x in range(50)] + [(2, 0), (3, 0)], "id bigint, v int")
    got = inc.rows_in(df, "id", inc.to_intervals(df.where("id in (1, 3)"), "id"))
    assert got.count() == 51 and got.where("id = 2").count() == 0


DOCS = "id bigint, path string, stamp string, digest string, extra int, _v string"
LOG = "log_id bigint, run_no int, path string, digest string, action string"


def test_changed_paths(spark):
    docs = [
        (1, "same", "10:1", "AB", 0, ""), (2, "other", "10:1", "cd", 0, ""), (3, "new", "10:1", "ef", 0, ""), (4, "gone", "10:1", "aa", 0, ""), (5, "failed", "10:1", "bb", 0, ""),
        (6, "late", "20:1", "x2", 0, ""), (7, "late", "10:1", "x1", 0, ""), (8, "back", "5:1", "y1", 0, ""), (8, "back", "5:1", "y1", 0, ""), (9, None, "1:1", "z", 0, ""), (10, "nodigest", "1:1", None, 0, ""), (11, "badstamp", "zz", "q", 0, ""), (None, "nonumber", "1:1", "n", 0, ""), (None, "knownnonumber", "1:1", "k", 0, ""),
    ]
    log = [
        (1, 1, "same", "sha256:ab", "scanned"), (2, 1, "same", "sha256:ab", "scanned"), (3, 1, "other", "cc", "scanned"), (4, 1, "gone", "aa", "scanned"), (5, 2, "gone", "aa", "deleted"),
        (6, 3, "failed", "bb", "scanned"), (7, 1, "late", "x1", "scanned"), (8, 2, "late", "X2", "scanned"), (9, 2, "back", "y1", "scanned"), (10, 1, "back", "y0", "scanned"), (11, None, "new", "ef", "scanned"), (12, 1, None, "z", "scanned"), (13, 1, "badstamp", "Q", "scanned"), (14, 1, "knownnonumber", "K", "scanned"),
    ]
    runs = spark.createDataFrame([(1, "ready"), (2, "ready"), (3, "failed"), (None, "ready")], "run_no int, state string")
    got = inc.changed_paths(spark.createDataFrame(docs, DOCS), spark.createDataFrame(log, LOG), runs)
    assert sorted(r.path for r in got.collect()) == ["failed", "gone", "new", "nodigest", "nonumber", "other"]


def test_changed_paths_with_a_lasting_ledger(spark, tmp_path):
    at = f"file://{tmp_path}/ledger"
    docs = [(1, "a", "1:1", "x", 0, ""), (2, "b", "1:1", "y", 0, "")]
    log = spark.createDataFrame([(1, 1, "a", "x", "scanned")], LOG)
    runs = spark.createDataFrame([(1, "ready")], "run_no int, state string")
    call = lambda rows: sorted(r.path for r in inc.changed_paths(spark.createDataFrame(rows, DOCS), log, runs, at).collect())
    assert call(docs) == ["b"]
    assert call(docs) == []
    assert call([*docs, (3, "b", "2:1", "z", 0, ""), (4, "c", "1:1", "w", 0, "")]) == ["b", "c"]


def test_changed_paths_of_empty_tables(spark):
    docs, log = spark.createDataFrame([], DOCS), spark.createDataFrame([], LOG)
    runs = spark.createDataFrame([], "run_no int, state string")
    assert inc.changed_paths(docs, log, runs).count() == 0
    one = spark.createDataFrame([(1, "p", "1:1", "d", 0, "")], DOCS)
    assert [r.path for r in inc.changed_paths(one, log, runs).collect()] == ["p"]


def test_plain_digest(spark):
    df = spark.createDataFrame([(" SHA256:AB ",), ("sha-256=ab",), ("ab",), (None,)], "d string")
    assert [r[0] for r in df.select(inc.plain_digest(F.col("d"))).collect()] == ["ab", "ab", "ab", None]
