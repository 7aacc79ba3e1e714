"""Joins whose keys may be hot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 16


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], spread: Column, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """``left`` joined to ``right`` (one narrow row per key) with each key spread over ``salts`` partitions.

    ``spread`` is any expression that differs between the rows of a key.  The
    right side is repeated per salt, so a key that holds a third of the left
    rows fills ``salts`` tasks instead of one.  ``how``: inner, left, left_semi or left_anti.
    """
    a = left.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    b = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return a.join(b, [*keys, "_salt"], how).drop("_salt")
