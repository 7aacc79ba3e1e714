"""Coverage of an inventory, and checks that its totals agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST_LANGUAGES = 32


def by_language(files: DataFrame) -> DataFrame:
    """``language, status, files``; languages beyond the 32 most frequent fall into ``(other)``, null is ``(unknown)``."""
    per = files.groupBy(F.coalesce("language", F.lit("(unknown)")).alias("language"), F.coalesce("status", F.lit("(none)")).alias("status")).agg(F.count("*").alias("files"))
    size = per.groupBy("language").agg(F.sum("files").alias("_n"))
    # one row per language
    rank = size.withColumn("_r", F.row_number().over(Window.orderBy(F.desc("_n"), "language"))).select("language", "_r")
    name = F.when(F.col("_r") > MOST_LANGUAGES, "(other)").otherwise(F.col("language"))
    return per.join(rank, "language").groupBy(name.alias("language"), "status").agg(F.sum("files").alias("files"))


def cross_counts(rows: DataFrame, a: str, b: str) -> DataFrame:
    return rows.groupBy(F.col(a), F.col(b)).agg(F.count("*").alias("count"))


def violations(total: DataFrame, *parts: tuple[str, DataFrame, str]) -> DataFrame:
    """``rule, expected, actual`` of every partition whose counts do not add up to the total (one row, column ``n``)."""
    out = None
    for rule, df, column in parts:
        one = df.agg(F.coalesce(F.sum(column), F.lit(0)).alias("actual")).select(F.lit(rule).alias("rule"), "actual")
        out = one if out is None else out.union(one)
    return out.crossJoin(total.select(F.col("n").alias("expected"))).where("expected <> actual")  # one row each


def parser_errors(errors: DataFrame, samples: int = 16, most_bytes: int = 4096) -> DataFrame:
    """One row: all parser errors, and the first ones in order of path, line and message as long as their bytes fit.

    ``errors``: path, line, message.  Ranks are cut per task, so only ``samples`` rows are ordered in one place.
    """
    first = errors.select("path", "line", "message").orderBy("path", "line", "message").limit(samples)
    size = F.octet_length(F.to_json(F.struct("path", "line", "message")).cast("binary"))
    w = Window.orderBy("path", "line", "message").rowsBetween(Window.unboundedPreceding, 0)  # at most ``samples`` rows
    kept = first.withColumn("_n", F.sum(size).over(w)).where(F.col("_n") <= most_bytes)
    s = kept.agg(F.count("*").alias("samples"), F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "path", F.col("line").cast("string")))), "\n").alias("first"))
    total = errors.agg(F.count("*").alias("errors"))
    return total.crossJoin(s).withColumn("truncated", F.col("samples") < F.col("errors"))  # one row each


def receipt_faults(receipt: dict, schema: dict[str, type | tuple], totals: dict[str, list[str]] = {}) -> list[str]:  # noqa: B006
    """What is wrong with a receipt: missing, unknown or mistyped fields, negative counts, and totals that their parts don't add up to."""
    out = [f"missing:{k}" for k in schema if k not in receipt] + [f"unknown:{k}" for k in receipt if k not in schema]
    for k, t in schema.items():
        v = receipt.get(k)
        if k in receipt and (not isinstance(v, t) or isinstance(v, bool) and t is int):
            out.append(f"type:{k}")
        elif isinstance(v, int) and not isinstance(v, bool) and v < 0:
            out.append(f"negative:{k}")
    if not out:
        out = [f"total:{k}" for k, parts in totals.items() if receipt[k] != sum(receipt[p] for p in parts)]
    return sorted(out)


def resources(batches: DataFrame, group: list[str]) -> DataFrame:
    """Per group: peaks of memory and time, sums of files, nodes and bytes over its batches."""
    return batches.groupBy(*group).agg(F.max("memory").alias("peak_memory"), F.max("seconds").alias("longest"), F.sum("files").alias("files"), F.sum("nodes").alias("nodes"), F.sum("bytes").alias("bytes"))
