"""One object per published index: map, search, query, status."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import selected, under
from ..operators import facts, graph, retrieval, rollup, snapshot
from ..sources import postings
from ..sources.generations import Store, lifecycle
from ..sources.shared import cut

OPERATIONS = ("symbol", "call", "callees", "callers", "reachable", "impact")
MOST_QUERY, MOST_LIMIT, PAGE = 1000, 50, 25
#: Seconds a cursor is good for.
LIFETIME = 60


class Index:
    def __init__(self, spark: SparkSession, folder: str, secret: bytes = b""):
        self.spark, self.store = spark, Store(spark, folder)
        self.secret = secret or hashlib.sha256(folder.encode()).digest()

    def analyze(self, files: DataFrame, attempt: str) -> int:
        """Collects and resolves the facts of ``path, body`` and publishes them as a generation.

        Files whose digest the generation before holds, collected by the same rules,
        are not read again; all facts are resolved anew, as any of them may have
        changed what others mean.
        """

        def build():
            now = files.where("path is not null and body is not null").select("path", F.sha2("body", 256).alias("digest"))
            if not self.store.current():
                f = facts.collect(files)
            else:
                same = snapshot.reusable(self.store.read("collected"), now, "path", "digest", facts.RULES).select("path")
                kept = self.store.read("facts").join(same, "path", "left_semi")
                f = cut(facts.collect(files.join(same, "path", "left_anti")).unionByName(kept))
            return {"facts": f, "collected": now.withColumn("analyzer", F.lit(facts.RULES)), "files": files.select("path").distinct(), "symbols": facts.symbols(f), "sites": facts.resolve(f), "docs": files, "postings": postings.postings(files, "path", "body"), "totals": postings.totals(files, "body")}

        return lifecycle(self.store, attempt, build)

    def map(self) -> dict[str, DataFrame]:
        paths = rollup.inventory(self.store.read("files"))
        groups, owners = rollup.system_partition(paths)
        return {"tree": rollup.tree_nodes(paths), "system": groups, "owners": owners}

    def search(self, query: str, *, mode: str = "keyword", limit: int = 10, prefix: str = "", vector: list[float] | None = None) -> DataFrame:
        """``path, score``; mode is keyword, semantic or hybrid (the last two need a query vector and a vector column)."""
        if not 1 <= len(query) <= MOST_QUERY or not 1 <= limit <= MOST_LIMIT:
            raise ValueError(f"a query has 1 to {MOST_QUERY} characters, a result 1 to {MOST_LIMIT} rows")
        if mode not in ("keyword", "semantic", "hybrid") or mode != "keyword" and vector is None:
            raise ValueError("mode is keyword, semantic or hybrid; all but keyword need a vector")
        docs = self.store.read("docs").where(under("path", prefix))
        n = retrieval.depth_for(limit)
        lists = []
        if mode != "semantic":
            lists.append(retrieval.top(postings.bm25(self.store, query).where(under("id", prefix)), n))
        if mode != "keyword":
            if docs.where(F.col("vector").isNull()).limit(1).count():
                raise ValueError("the vector index is stale")
            lists.append(retrieval.top(retrieval.cosine_scores(docs, vector, "path"), n, True))
        found = lists[0].orderBy("rank").limit(limit) if len(lists) == 1 else retrieval.fuse(*lists, limit=limit)
        return found.select(F.col("id").alias("path"), "score")

    def query(self, operation: str, *, seed: str | None = None, depth: int = 1, scope: str = "", prefix: str = "", cursor: str | None = None, limit: int = PAGE) -> tuple[list[dict], str | None]:
        """One page of rows and the cursor of the next; a cursor is bound to the generation and to every filter."""
        if operation not in OPERATIONS:
            raise ValueError(f"operation is one of {', '.join(OPERATIONS)}")
        if type(depth) is not int or not 1 <= depth <= graph.MOST_DEPTH or type(limit) is not int or not 1 <= limit <= 500:
            raise ValueError(f"depth is 1 to {graph.MOST_DEPTH}, a page has 1 to 500 rows")
        if any(len(x or "") > MOST_QUERY for x in (seed, scope, prefix)):
            raise ValueError(f"seed, scope and prefix have at most {MOST_QUERY} characters")
        if operation not in ("symbol", "call") and not seed:
            raise ValueError("this operation needs a seed")
        g = self.store.current()
        bound = [g, operation, seed, depth, scope, prefix, limit]
        at = self._open(cursor, bound) if cursor else None
        if operation == "symbol":
            df = self.store.read("symbols", g).where(F.col("path").startswith(scope) & F.col("name").startswith(prefix))
            df = df.where(F.col("id") == seed) if seed else df
            keys = ["path", "start_byte", "end_byte", "id"]
            df = df.select(*keys, "name", "kind")
        else:
            rel = self.store.read("sites", g).where((F.col("role") == "call") & F.col("path").startswith(scope)).select("path", "site_id", F.coalesce("caller", F.lit("")).alias("caller_id"), F.coalesce("target_id", F.lit("")).alias("target_id"), "certainty", F.coalesce("reason", F.lit("")).alias("reason"))
            ident = self.store.read("symbols", g).where("callable").select("path", F.substring_index("name", ".", -1).alias("caller_id"), F.col("id").alias("_id"))
            rel = rel.join(ident.groupBy("path", "caller_id").agg(F.min("_id").alias("_id")), ["path", "caller_id"], "left").withColumn("caller_id", F.coalesce("_id", F.lit(""))).drop("_id")
            keys = ["path", "site_id", "target_id"]
            if operation == "callees":
                df = graph.outgoing(rel, seed)
            elif operation == "callers":
                df = graph.incoming(rel, seed)
            elif operation == "call":
                df = rel.where(F.col("caller_id") == seed) if seed else rel
            else:
                seeds = self.spark.createDataFrame([(seed,)], "node string")
                df = graph.walk(rel, seeds, depth, reverse=operation == "impact")
                keys = ["level", "path", "site_id", "from_id", "to_id"]
        page = graph.after(df, keys, at, limit + 1) if at else df.orderBy(*keys).limit(limit + 1)
        rows = [r.asDict() for r in page.collect()]  # at most one page
        more = rows[limit:]
        rows = rows[:limit]
        return rows, self._seal([rows[-1][k] for k in keys], bound) if more else None

    def impact(self, area: str, depth: int = 2) -> DataFrame:
        """``node, level`` of everything that reaches a symbol of the selected files."""
        rel = self.store.read("sites").where("role = 'call'")
        syms = self.store.read("symbols")
        ident = syms.where("callable").groupBy("path", F.substring_index("name", ".", -1).alias("caller")).agg(F.min("id").alias("caller_id"))
        edges = rel.join(ident, ["path", "caller"]).where("target_id is not null").select("caller_id", "target_id").distinct()
        return graph.reached(edges, syms.where(selected("path", area)).select("id"), depth, reverse=True)

    def status(self, files: DataFrame | None = None) -> dict:
        """Generation, tables, readiness and, against ``path, body`` as they are now, freshness: current or stale, unknown without them."""
        g = self.store.current()
        if not g:
            return {"generation": 0, "state": "not_indexed"}
        docs = self.store.read("docs")
        out = {"generation": g, "tables": self.store.tables(g), "files": self.store.read("files").count(), "state": "ready"}
        out["freshness"] = "unknown"
        if files is not None:
            now = files.where("path is not null and body is not null").select("path", F.sha2("body", 256).alias("digest"))
            out["freshness"] = "current" if snapshot.changes(self.store.read("collected"), now, "path", "digest").isEmpty() else "stale"
        if "vector" in docs.columns:
            out["vectors"] = snapshot.index_state(docs).first().state
        return out

    def _seal(self, values: list, bound: list) -> str:
        body = json.dumps([time.time(), values]).encode()
        mark = hmac.new(self.secret, body + json.dumps(bound).encode(), "sha256").digest()[:16]
        return base64.urlsafe_b64encode(mark + body).decode()

    def _open(self, cursor: str, bound: list) -> list:
        raw = base64.urlsafe_b64decode(cursor.encode())
        mark, body = raw[:16], raw[16:]
        if not hmac.compare_digest(mark, hmac.new(self.secret, body + json.dumps(bound).encode(), "sha256").digest()[:16]):
            raise ValueError("the cursor belongs to another query or generation")
        issued, values = json.loads(body)
        if time.time() - issued > LIFETIME:
            raise ValueError("the cursor has expired")
        return values
