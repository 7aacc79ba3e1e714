"""Bounded samples for fitting models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_RANGE = 1 << 40


def hashed_sample(df: DataFrame, key: Column, most: int, rows: int) -> DataFrame:
    """About ``most`` of ``rows`` rows, chosen by the hash of a key: the same rows whatever the partitioning.

    The threshold is applied in the scan, so only the sample itself moves; its size
    varies by about the square root of ``most``.  All rows if there are no more than ``most``.
    """
    if rows <= most:
        return df
    return df.where(F.pmod(F.xxhash64(key), F.lit(_RANGE)) < F.lit(int(_RANGE * (most / rows))))
