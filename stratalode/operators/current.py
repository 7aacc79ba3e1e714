"""Which observation of a file is the current one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stamp_ns(stamp: Column | str) -> Column:
    """File time in nanoseconds, the part of a stamp before its colon; null where that is no number."""
    return F.expr("try_cast(substring_index(%s, ':', 1) as bigint)" % stamp) if isinstance(stamp, str) else F.substring_index(stamp, ":", 1).try_cast("bigint")


def latest(df: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """One row per ``key`` with the ``values`` of its greatest ``order``.

    A partial aggregation keeps one row per key and task before the shuffle, so
    a key with many observations is no hot spot.  Exact repeats collapse; a null
    order loses against any other; rows whose key is null are dropped, as they
    name nothing.  Keep ``values`` narrow: they travel.
    """
    agg = F.max_by(F.struct(*values), F.struct(*[F.coalesce(F.col(o), F.lit(-(2**62))) for o in order])).alias("_v")
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(agg).select(key, *[F.col(f"_v.{v}").alias(v) for v in values])
