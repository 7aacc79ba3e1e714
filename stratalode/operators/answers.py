"""Bounded answers: what stops a result, how exact its total is, and merged views of several pages.

A result is cut by the first of its budgets that a row would break, in the order
in which the rows come; the reason is named, and rows behind it are not given.
All of these work on one bounded result (a page, a shortlist), never on a table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Budget:
    """Limits of one answer; None is no limit."""

    work: int | None = 10_000
    edges: int | None = 100
    entities: int | None = 50
    response_bytes: int | None = 32 * 1024
    excerpt_bytes: int | None = None

    def __post_init__(self):
        for name, v in self.__dict__.items():
            if v is not None and (type(v) is not int or v < 1):
                raise ValueError(f"{name} must be a positive number")


# The names under which a stop is reported.
STOPS = {"work": "work_budget_exceeded", "edges": "edge_budget_exceeded", "entities": "entity_budget_exceeded", "response_bytes": "response_byte_budget_exceeded", "excerpt_bytes": "excerpt_budget_exceeded"}


def bounded(rows: DataFrame, order: list[str], budget: Budget, entities: list[str] = (), excerpt: str | None = None) -> DataFrame:
    """The rows within a budget and, after them, one row with the ``stop`` that ended it, if any.

    Adds ``place`` (1-based) and ``stop`` (null for rows that are given).  ``entities``:
    columns that name them; ``excerpt``: a text whose bytes count; the response's
    bytes are those of the rows as JSON.
    """
    if budget.work is not None:
        rows = rows.orderBy(*order).limit(budget.work + 1)
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)  # one result of at most ``work`` rows
    size = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])).cast("binary"))
    named = F.filter(F.array(*[F.col(c).cast("string") for c in entities]), lambda x: x.isNotNull() & (x != "")) if entities else F.array().cast("array<string>")
    r = rows.withColumn("place", F.row_number().over(Window.orderBy(*order)))
    r = r.withColumn("_entities", F.size(F.array_distinct(F.flatten(F.collect_list(named).over(w))))).withColumn("_bytes", F.sum(size).over(w))
    r = r.withColumn("_excerpt", F.sum(F.coalesce(F.octet_length(F.col(excerpt).cast("binary")), F.lit(0))).over(w) if excerpt else F.lit(0))
    broken = F.coalesce(*[
        F.when(value > limit, STOPS[name])
        for name, value, limit in (("work", F.col("place"), budget.work), ("edges", F.col("place"), budget.edges), ("entities", F.col("_entities"), budget.entities), ("excerpt_bytes", F.col("_excerpt"), budget.excerpt_bytes), ("response_bytes", F.col("_bytes"), budget.response_bytes))
        if limit is not None
    ], F.lit(None).cast("string"))
    r = r.withColumn("stop", broken)
    first = F.min(F.when(F.col("stop").isNotNull(), F.col("place"))).over(Window.partitionBy(F.lit(0)))
    return r.withColumn("_first", first).where(F.col("_first").isNull() | (F.col("place") <= F.col("_first"))).drop("_first", "_entities", "_bytes", "_excerpt")


def total_count(answer: DataFrame, available: bool = True) -> DataFrame:
    """One row ``value, kind`` of a bounded answer: exact, a lower bound if something stopped it, unavailable (null) if nothing was indexed."""
    if not available:
        return answer.sparkSession.createDataFrame([(None, "unavailable")], "value bigint, kind string")
    return answer.agg(F.count(F.when(F.col("stop").isNull(), 1)).alias("value"), F.when(F.max("stop").isNotNull(), "lower_bound").otherwise("exact").alias("kind"))


def filtered(rows: DataFrame, *, role: str = "all", scope: str = "", prefix: str = "", on: str = "target_name", families: tuple[str, ...] = (), kinds: tuple[str, ...] = (), services: tuple[str, ...] = (), protocols: tuple[str, ...] = (), namespaces: tuple[str, ...] = ()) -> DataFrame:
    """Rows of a listing: role (call, reference, framework, contract or all), raw path prefix, a prefix of the declaration's name on one side, and the lists' own filters.

    Rows of contracts are hidden from any listing that doesn't ask for them; ``all``
    means calls and references.  An empty list of families, kinds, services, protocols
    or namespaces lets all pass; null never matches a list.
    """
    if role not in ("call", "reference", "framework", "contract", "all"):
        raise ValueError("role is call, reference, framework, contract or all")
    wanted = {"all": ("call", "reference"), "framework": ("framework", "framework_boundary"), "contract": ("contract", "contract_boundary")}.get(role, (role,))
    keep: Column = F.col("role").isin(*wanted)
    if scope:
        keep = keep & F.col("path").startswith(scope)
    if prefix:
        keep = keep & F.col(on).startswith(prefix)
    for column, values in (("family", families), ("kind", kinds), ("service_id", services), ("protocol", protocols), ("namespace", namespaces)):
        if values:
            keep = keep & F.col(column).isin(*values)
    return rows.where(keep)


def merged_scene(prior: DataFrame, page: DataFrame, key: str, order: list[str], most: int = 24) -> DataFrame:
    """Two pages as one view: elements known by ``key`` once, at most ``most`` in order; raises where both pages hold a key with different evidence."""
    columns = [c for c in prior.columns if c != key]
    both = prior.select(key, *columns).unionByName(page.select(key, *columns))
    per = both.groupBy(key).agg(F.count_distinct(F.struct(*columns)).alias("_n"), F.min(F.struct(*columns)).alias("_v"))
    clash = per.where("_n > 1").limit(1).collect()
    if clash:
        raise ValueError(f"conflicting evidence for {clash[0][key]}")
    return per.select(key, *[F.col(f"_v.{c}").alias(c) for c in columns]).orderBy(*order).limit(most)


def ordered(nodes: DataFrame, by: str = "files") -> DataFrame:
    """Nodes of a map in a viewer's order: by files or imports (most first, then name) or by name."""
    if by not in ("files", "imports", "name"):
        raise ValueError("order is by files, imports or name")
    return nodes.orderBy("directory") if by == "name" else nodes.orderBy(F.desc(by), "directory")


def treemap(nodes: DataFrame, name: str, weight: str, width: float = 1.0, height: float = 1.0) -> DataFrame:
    """``name, x, y, w, h``: rectangles whose areas are in proportion to weights, split in two halves of near weight again and again along the longer side.

    For one drawn map of at most a few hundred rows.
    """
    rows = sorted(((r[0], float(r[1])) for r in nodes.where(F.col(weight) > 0).select(name, weight).collect()), key=lambda r: (-r[1], r[0]))
    out: list[tuple] = []

    def split(part, x, y, w, h):
        if len(part) == 1:
            out.append((part[0][0], x, y, w, h))
            return
        total, run, at = sum(v for _, v in part), 0.0, 0
        while at < len(part) - 1 and (at == 0 or run + part[at][1] / 2 <= total / 2):
            run += part[at][1]
            at += 1
        share = run / total
        if w >= h:
            split(part[:at], x, y, w * share, h)
            split(part[at:], x + w * share, y, w * (1 - share), h)
        else:
            split(part[:at], x, y, w, h * share)
            split(part[at:], x, y + h * share, w, h * (1 - share))

    if rows:
        split(rows, 0.0, 0.0, width, height)
    return nodes.sparkSession.createDataFrame(out, "name string, x double, y double, w double, h double")
