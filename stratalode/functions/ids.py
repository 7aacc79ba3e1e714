"""Content-derived identifiers and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical(**fields: Column) -> Column:
    """Compact JSON with keys in order; nulls are written."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def typed_id(kind: str, value: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.sha2(value.cast("string"), 256))


def fingerprint(df: DataFrame, group: list[str], item: Column, order: Column, limit_note: str = "") -> DataFrame:
    """``sha256`` per group over its items in order.

    A group's items are gathered in one place, so groups must be bounded (a
    directory, a dependency key); totals over a whole table are fingerprints of
    group fingerprints.
    """
    parts = df.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), item.alias("v")))).alias("p"))
    return parts.select(*group, F.sha2(F.array_join(F.transform("p", lambda x: x["v"]), "\n"), 256).alias("fingerprint"), F.size("p").alias("items"))
