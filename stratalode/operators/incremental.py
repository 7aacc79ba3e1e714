"""Processing only new or changed records (problem 5).

Records carry sequence numbers.  What has been processed is kept as disjoint
intervals of them; a run subtracts these from the available ranges, processes
the gaps (late commits fall into gaps below the maximum) and commits the merged
intervals together with its output, so that a failure at any point leaves the
last committed generation in force: nothing is skipped or repeated.

Intervals never cross a block of ``BLOCK`` sequence numbers.  Blocks are the
shuffle key of every step, hold at most ``BLOCK`` distinct numbers whatever the
data looks like, and let whole tables of intervals be merged or subtracted in
parallel, without an ordered pass over all of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.pointers import Folder, fresh
from ..sources.shared import cut, shared_folder
from .current import latest, stamp_ns

BLOCK, SALTS = 1 << 12, 4
INTERVALS = "block bigint, lo bigint, hi bigint"


def to_intervals(df: DataFrame, seq: str) -> DataFrame:
    """``block, lo, hi`` of the distinct sequence numbers in ``df``; null numbers are dropped."""
    s = F.col(seq).cast("bigint")
    numbers = df.where(s.isNotNull()).select(F.shiftright(s, BLOCK.bit_length() - 1).alias("block"), s.alias("s")).distinct()
    w = Window.partitionBy("block").orderBy("s")
    return numbers.withColumn("island", F.col("s") - F.row_number().over(w)).groupBy("block", "island").agg(F.min("s").alias("lo"), F.max("s").alias("hi")).drop("island")


def _sweep(parts: list[DataFrame], keep: Column, joined: bool) -> DataFrame:
    """Elementary stretches between interval ends where ``keep`` (over the cover counts a, b) holds; ``joined`` where they touch."""
    events = None
    for i, p in enumerate(parts):
        a, b = (F.lit(1), F.lit(0)) if i == 0 else (F.lit(0), F.lit(1))
        ends = p.select("block", F.col("lo").alias("at"), a.alias("a"), b.alias("b")).union(p.select("block", (F.col("hi") + 1).alias("at"), (-a).alias("a"), (-b).alias("b")))
        events = ends if events is None else events.union(ends)
    w = Window.partitionBy("block").orderBy("at")
    steps = (
        events.repartition("block").groupBy("block", "at").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        .select("block", F.col("at").alias("lo"), (F.lead("at").over(w) - 1).alias("hi"), F.sum("a").over(w).alias("a"), F.sum("b").over(w).alias("b"))
        .where(F.col("hi").isNotNull() & keep).select("block", "lo", "hi")
    )
    if not joined:
        return steps
    new = (F.coalesce(F.lag("hi").over(Window.partitionBy("block").orderBy("lo")), F.lit(-(2**62))) + 1 < F.col("lo")).cast("int")
    steps = steps.withColumn("new", new).withColumn("island", F.sum("new").over(Window.partitionBy("block").orderBy("lo")))
    return steps.groupBy("block", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("island")


def subtract(available: DataFrame, processed: DataFrame) -> DataFrame:
    """The gaps: stretches of ``available`` that no interval of ``processed`` covers."""
    return _sweep([available, processed], (F.col("a") > 0) & (F.col("b") <= 0), False)


def merge(processed: DataFrame, done: DataFrame) -> DataFrame:
    """Union of two interval tables, disjoint again."""
    return _sweep([processed, done], (F.col("a") > 0) | (F.col("b") > 0), True)


def rows_in(df: DataFrame, seq: str, gaps: DataFrame, salts: int = SALTS) -> DataFrame:
    """Rows of ``df`` whose sequence number lies in an interval; each row comes out once, as intervals are disjoint.

    Interval starts and rows of a block are read in one order, so a row sees the
    last interval that begins before it: no row meets more than one.  Rows of one
    block are spread over ``salts`` tasks, in case many share a number; the
    intervals are repeated for each.
    """
    s = F.col(seq).cast("bigint")
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    left = df.select(row.alias("_r"), F.shiftright(s, BLOCK.bit_length() - 1).alias("_block"), F.pmod(F.xxhash64(seq, F.monotonically_increasing_id()), F.lit(salts)).cast("int").alias("_salt"), s.alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("bigint").alias("_hi"))
    kind = left.schema["_r"].dataType
    starts = gaps.select(F.lit(None).cast(kind).alias("_r"), F.col("block").alias("_block"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"), F.col("lo").alias("_at"), F.lit(0).alias("_kind"), F.col("hi").alias("_hi"))
    w = Window.partitionBy("_block", "_salt").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    both = left.where("_at is not null").unionByName(starts).withColumn("_reach", F.last("_hi", True).over(w))
    return both.where("_kind = 1 and _at <= _reach").select("_r.*")


class IntervalLedger:
    """Committed generations under a folder of the shared file system.

    Every run writes its output and the merged intervals to a folder of its own;
    a pointer ``_COMMITTED-<n>`` that names the folder commits both at once.  Of two
    runs that started from the same generation one commits and the other raises:
    nothing it wrote is looked at, and nothing of the first is touched.  A run that
    dies leaves the last committed generation in force.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.files = Folder(spark, self.folder)

    def generation(self) -> int:
        """Number of the last committed generation, 0 before the first."""
        return max([0, *(int(n.split("-")[1]) for n in self.files.names("_COMMITTED-"))])

    def _at(self, generation: int) -> str:
        return f"{self.folder}/{self.files.read(f'_COMMITTED-{generation}')}"

    def intervals(self, generation: int | None = None) -> DataFrame:
        g = self.generation() if generation is None else generation
        if not g:
            return self.spark.createDataFrame([], INTERVALS)
        return self.spark.read.schema(INTERVALS).parquet(f"{self._at(g)}/intervals")

    def output(self) -> DataFrame | None:
        """The output of all committed runs; None before the first that had any."""
        runs = [self.files.read(f"_COMMITTED-{i}") for i in range(1, self.generation() + 1)]
        folders = [f"{self.folder}/{n}/output" for n in runs if n.startswith("run-")]
        return self.spark.read.parquet(*folders) if folders else None

    def _commit(self, name: str, generation: int) -> int:
        if not self.files.claim(f"_COMMITTED-{generation}", name):
            raise RuntimeError(f"generation {generation} was committed by another run")
        return generation

    def adopt(self, done: DataFrame) -> int:
        """Commits intervals that something else has processed, without output."""
        g = self.generation()
        name = fresh("adopted")
        (merge(self.intervals(g), done) if g else done).write.parquet(f"{self.folder}/{name}/intervals")
        return self._commit(name, g + 1)

    def run(self, source: DataFrame, seq: str, process: Callable[[DataFrame], DataFrame]) -> int:
        """Process what is not covered yet and commit; returns the committed generation.

        ``source`` must name a fixed snapshot: a record that arrives while the run
        reads is either in this snapshot or in a later gap.
        """
        g = self.generation()
        name = fresh("run")
        at = f"{self.folder}/{name}"
        processed = self.intervals(g)
        subtract(to_intervals(source, seq), processed).write.parquet(f"{at}/todo")
        todo = self.spark.read.schema(INTERVALS).parquet(f"{at}/todo")  # the same gaps for rows and for the commit
        process(rows_in(source, seq, todo)).write.parquet(f"{at}/output")
        merge(processed, todo).write.parquet(f"{at}/intervals")
        return self._commit(name, g + 1)


def plain_digest(digest: Column) -> Column:
    """A digest without its notation: no algorithm prefix, lower case."""
    return F.lower(F.regexp_replace(F.trim(digest), r"(?i)^sha-?256[:=\s]+", ""))


def last_logged(log: DataFrame, runs: DataFrame) -> DataFrame:
    """``path, action, digest`` logged by the ready run with the greatest number among those that logged the path."""
    ready = F.broadcast(runs.where(F.col("state") == "ready").select("run_no").distinct())  # one row per run, not per record
    rows = log.join(ready, "run_no").select("path", "run_no", "log_id", "action", plain_digest(F.col("digest")).alias("digest"))
    return latest(rows, "path", ["run_no", "log_id"], ["action", "digest"])


def changed_paths(docs: DataFrame, log: DataFrame, runs: DataFrame, folder: str | None = None) -> DataFrame:
    """Paths of ``docs`` that are new or changed since the last successful run that saw them.

    The sequence number is ``docs.id``.  A fresh ledger adopts as processed the ids
    of the current rows whose digest a ready run logged last (what failed runs
    wrote is not among them); the ledger's run takes the gaps, late ids below the
    maximum included, and commits the paths together with the merged intervals.
    With a ``folder`` the ledger lives on and the next call yields only what came
    since; without one it is used once.  A null digest on either side counts as a
    change, except null on both sides.
    """
    spark = docs.sparkSession
    ledger = IntervalLedger(spark, folder or f"{shared_folder(spark)}/{fresh('ledger')}")
    now = latest(docs.select("path", "id", "digest", stamp_ns("stamp").alias("stamp")), "path", ["stamp", "id"], ["id", "digest"])
    # a row without a number of its own gets one below all others that its path determines
    now = now.withColumn("id", F.coalesce("id", -F.pmod(F.xxhash64("path"), F.lit(1 << 61)) - 1))
    now = cut(now.withColumn("digest", plain_digest(F.col("digest"))))  # one narrow snapshot for the ranges, what is done, and the rows
    if not ledger.generation():
        seen = last_logged(log, runs).where(F.col("action") != "deleted").drop("action")
        done = now.join(seen.withColumnRenamed("digest", "_logged"), "path").where(F.col("digest").eqNullSafe(F.col("_logged"))).select("id")
        ledger.adopt(to_intervals(done, "id"))
    before = ledger.generation()
    ledger.run(now.select("id", "path"), "id", lambda rows: rows.select("path"))
    return spark.read.schema("path string").parquet(f"{ledger._at(before + 1)}/output")
