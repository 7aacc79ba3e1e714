"""Small outputs for people: a graph as JSON, a flowchart, guarded CSV."""

from __future__ import annotations

import base64
import hashlib
import html
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import csv_guard, mermaid_label
from .pointers import Folder

MOST_NODES, MOST_ELEMENTS = 24, 40


def graph_json(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """Nodes and edges as JSON lines, written by the executors; ``<``, ``>`` and ``&`` are escaped, so a page can embed them."""
    for name, df in (("nodes", nodes), ("edges", edges)):
        line = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))
        for sign, code in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026")):
            line = F.replace(line, F.lit(sign), F.lit(code))
        df.select(line.alias("value")).write.mode("overwrite").text(f"{folder}/{name}")


def flowchart(tree: DataFrame, edges: DataFrame) -> str:
    """Mermaid text of the root with its first 23 children and the strongest edges between them, at most forty elements."""
    top = tree.where("directory <> '' and not directory like '%/%'").orderBy("directory").limit(MOST_NODES - 1).select("directory", mermaid_label("directory").alias("label"), "files").collect()
    ids = {r.directory: f"n{i + 1}" for i, r in enumerate(top)}
    lines = ["flowchart LR", '  n0["root"]'] + [f'  {ids[r.directory]}["{r.label} ({r.files})"]' for r in top]
    e = edges.where(F.col("source").isin(list(ids)) & F.col("target").isin(list(ids))).orderBy(F.desc("count"), "source", "target").limit(max(0, MOST_ELEMENTS - len(top) - 1)).collect()
    return "\n".join(lines + [f"  {ids[r.source]} -->|{r['count']}| {ids[r.target]}" for r in e]) + "\n"


def guarded_csv(df: DataFrame, folder: str) -> None:
    """CSV with every cell quoted and formulas defused."""
    cells = [csv_guard(F.col(f"`{c}`").cast("string")).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in df.dtypes]
    df.select(*cells).write.mode("overwrite").option("header", True).option("quoteAll", True).csv(folder)


def system_overview(groups: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: groups, files, relations, and how many relations a drawing of forty leaves out."""
    g = groups.agg(F.count("*").alias("groups"), F.coalesce(F.sum("files"), F.lit(0)).alias("files"))
    e = edges.agg(F.count("*").alias("relations"), F.coalesce(F.sum("count"), F.lit(0)).alias("imports"))
    return g.crossJoin(e).withColumn("omitted", F.greatest(F.col("relations") - 40, F.lit(0)))  # one row each


PAGE = """<!doctype html><html><head><meta charset="utf-8"><title>%s</title></head><body><script type="application/json" id="data">%s</script></body></html>"""


def escaped(payload) -> str:
    """JSON that a page can hold: ``<``, ``>`` and ``&`` are written as escapes."""
    text = json.dumps(payload, ensure_ascii=False, separators=(",", ":"))
    return text.replace("&", "\\u0026").replace("<", "\\u003c").replace(">", "\\u003e")


def page(spark: SparkSession, at: str, title: str, payload) -> None:
    """One HTML page with a bounded payload, put in place as a whole."""
    folder, _, name = at.rpartition("/")
    Folder(spark, folder).replace(name, PAGE % (html.escape(title), escaped(payload)))


def scan_cache(imports: DataFrame, folder: str) -> None:
    """``path, digest, imports`` of scanned files, for the next scan."""
    imports.select("path", "digest", "imports").write.mode("overwrite").parquet(folder)


def cached_scan(spark: SparkSession, folder: str, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a cache knows of files as they are (``path, digest``), and the files it doesn't know so."""
    if not Folder(spark, folder).exists(""):
        return files.select("path", "digest").withColumn("imports", F.lit(None).cast("array<string>")).limit(0), files
    known = spark.read.parquet(folder).dropDuplicates(["path", "digest"])
    return files.select("path", "digest").join(known, ["path", "digest"]), files.join(known.select("path", "digest"), ["path", "digest"], "left_anti")


def collection_receipt(facts: DataFrame) -> DataFrame:
    """``path, facts, errors``: one line per collected file."""
    return facts.groupBy("path").agg(F.count("*").alias("facts"), F.count(F.when(F.col("fact") == "error", 1)).alias("errors"))


def requests(lines: DataFrame, schema: str, most: int = 8192) -> DataFrame:
    """Requests of JSON lines (``value``) with ``fault``: too long, no JSON object of these fields, or null."""
    v = F.from_json("value", schema, {"mode": "PERMISSIVE"})
    long = F.octet_length(F.col("value").cast("binary")) > most
    fault = F.when(long, "too_long").when(F.col("value").isNull() | F.get_json_object("value", "$").isNull() | ~F.trim("value").startswith("{"), "not_an_object")
    return lines.withColumn("_v", F.when(fault.isNull(), v)).withColumn("fault", fault).select("value", "_v.*", "fault")


def offline_status(status: dict, allowed: dict, most: int = 64 * 1024) -> str:
    """A status as JSON for a page without a server: only fields that are allowed, at every level; raises beyond ``most`` bytes.

    ``allowed``: field -> True for a plain value, or the fields allowed below it.
    """

    def take(value, rule):
        if rule is True:
            return value if not isinstance(value, dict) else None
        return {k: take(value[k], r) for k, r in rule.items() if k in value} if isinstance(value, dict) else None

    text = escaped(take(status, allowed))
    if len(text.encode()) > most:
        raise ValueError(f"the status takes more than {most} bytes")
    return text


def bookmark(view: dict, most: int = 32 * 1024) -> str:
    """A view as a short text for an address, with its own digest."""
    body = json.dumps(view, sort_keys=True, separators=(",", ":")).encode()
    if len(body) > most:
        raise ValueError(f"a view takes at most {most} bytes")
    return base64.urlsafe_b64encode(hashlib.sha256(body).digest()[:8] + body).decode().rstrip("=")


def opened(text: str, fields: dict[str, type | tuple], most: int = 32 * 1024) -> dict:
    """The view of a bookmark; raises if it was changed, is too long, or holds other fields than these."""
    raw = base64.urlsafe_b64decode(text + "=" * (-len(text) % 4))
    mark, body = raw[:8], raw[8:]
    if len(body) > most or hashlib.sha256(body).digest()[:8] != mark:
        raise ValueError("not a bookmark of this program")
    view = json.loads(body)
    if not isinstance(view, dict) or set(view) - set(fields) or any(not isinstance(v, fields[k]) for k, v in view.items()):
        raise ValueError("a bookmark with unknown fields")
    return view
