"""Incremental refresh as a stream: what arrives since the last checkpoint is folded into the latest state per path."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.current import latest, stamp_ns
from ..sources.generations import Store
from ..sources.shared import shared_folder


def source(spark: SparkSession, folder: str, table: str, columns: list[str] | None = None) -> DataFrame:
    """A table of a folder as a stream of its files, whether it is one file or a folder of them."""
    at = f"{folder}/{table}.parquet"
    schema = spark.read.parquet(at).schema
    one = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    single = one.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(one).isFile()
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", 8)
    s = r.option("pathGlobFilter", os.path.basename(at)).parquet(folder) if single else r.parquet(at)
    return s.select(*columns) if columns else s


def refresh(stream: DataFrame, store: Store, checkpoint: str, key: str = "path", order: str = "stamp", value: str = "digest") -> int:
    """Processes all that is available and returns the generation in force.

    Each batch is merged with the state of the generation before it and published
    with its batch number; a batch that is replayed after a failure finds its
    number already there and is skipped, so each record counts once.
    """

    def fold(batch: DataFrame, number: int) -> None:
        done = store.current()
        known = None
        if done:
            known = store.read("state")
            if store.read("batches").where(F.col("batch") == number).count():
                return
        new = batch.select(key, stamp_ns(order).alias("_order"), value)
        rows = new if known is None else new.unionByName(known)
        state = latest(rows, key, ["_order", value] if dict(batch.dtypes)[value] == "bigint" else ["_order"], ["_order", value])
        batches = batch.sparkSession.createDataFrame([(number,)], "batch bigint")
        batches = batches if not done else batches.union(store.read("batches"))
        g = store.write({"state": state, "batches": batches})
        if not store.publish(g, done):
            raise RuntimeError("another writer published first")

    q = stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return store.current()


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """``start, event_type, n, total`` per tumbling window, with a watermark for late rows."""
    w = F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def latest_state(spark: SparkSession, folder: str, table: str = "docs") -> DataFrame:
    """The state after all files of a table went through the stream once."""
    base = f"{shared_folder(spark)}/refresh-{spark._jvm.java.util.UUID.randomUUID()}"
    store = Store(spark, f"{base}/state")
    refresh(source(spark, folder, table, ["path", "stamp", "digest"]), store, f"{base}/checkpoint")
    return store.read("state")
