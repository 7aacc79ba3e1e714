"""Files of a tree as a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .pointers import Folder

from ..functions.paths import visible

READ_LIMIT = 64 * 1024


def relative(path: Column, root: str) -> Column:
    """``path`` without the scheme and the root; the reader gives paths unescaped."""
    base = "/" + root.split("://", 1)[-1].strip("/") + "/"
    plain = F.regexp_replace(path, "^[a-z0-9]+:/+", "/")
    return F.when(plain.startswith(base), F.substring(plain, F.lit(len(base) + 1), F.length(plain))).otherwise(plain)


def scan(spark: SparkSession, root: str) -> DataFrame:
    """``path, bytes, modified`` of the visible files below a folder; contents are not read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return df.select(relative(F.col("path"), root).alias("path"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified")).where(visible("path"))


def read(spark: SparkSession, root: str, limit: int = READ_LIMIT, most: int | None = None) -> DataFrame:
    """``path, bytes, sha256, head``: the digest of the whole file and its first ``limit`` bytes; larger files than ``most`` are skipped before they are read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    if most is not None:
        df = df.where(F.col("length") <= most)
    path = relative(F.col("path"), root)
    return df.select(path.alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.substring("content", 1, limit).alias("head")).where(visible("path"))


def revision(spark: SparkSession, root: str) -> dict:
    """``revision, dirty`` of a checkout: the commit its HEAD names; whether files differ from it is not looked at, so dirty is None."""
    git = Folder(spark, f"{root.rstrip('/')}/.git")
    if not git.exists("HEAD"):
        return {"revision": None, "dirty": None}
    head = git.read("HEAD").strip()
    if head.startswith("ref: "):
        ref = head[5:]
        packed = [line.split(" ")[0] for line in (git.read("packed-refs").splitlines() if git.exists("packed-refs") else []) if line.endswith(f" {ref}")]
        head = git.read(ref).strip() if git.exists(ref) else packed[0] if packed else None
    return {"revision": head, "dirty": None}
