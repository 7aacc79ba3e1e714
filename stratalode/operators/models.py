"""Places where a model is plugged in: embedding of texts, reranking of hits.

An embedder is any object with ``name``, ``width`` and ``passages(list of texts) -> list
of vectors``; a reranker has ``name`` and ``rank(query, list of texts) -> list of scores``.
They are made once per task by a factory, so a model is loaded where it runs.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Callable
from zlib import crc32

import pyarrow as pa
from pyspark.errors import PythonException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.pointers import Folder
from ..sources.ship import ship

BATCH, SHORTLIST, EVIDENCE_BYTES = 256, 32, 900


class HashedTerms:
    """Embedder without a model: signed hashed term counts, scaled to unit length.  A stand-in for tests and for boxes without models."""

    name = "hashed-terms"

    def __init__(self, width: int = 256):
        self.width = width

    def passages(self, texts: list[str]) -> list[list[float] | None]:
        out = []
        for t in texts:
            v = [0.0] * self.width
            for w in re.findall(r"\w+", (t or "").lower()):
                h = crc32(w.encode())
                v[h % self.width] += 1.0 if h & 0x80000000 else -1.0
            n = math.sqrt(sum(x * x for x in v))
            out.append([x / n for x in v] if n else None)
        return out


def embed(docs: DataFrame, ident: str, text: str, make: Callable[[], object], vector: str = "vector") -> DataFrame:
    """``id, vector``: vectors of the rows whose ``vector`` is null; others keep theirs without being sent to the model.

    Vectors are checked to be finite and are stored in unit length; a text the model
    cannot embed stays null.
    """
    has = vector in docs.columns
    src = docs.select(F.col(ident).alias("id"), F.col(text).alias("text"), (F.col(vector).cast("array<float>") if has else F.lit(None).cast("array<float>")).alias("vector"))
    spec = T.StructType.fromDDL("id bigint, vector array<float>")
    arrow = to_arrow_schema(spec)

    def run(batches):
        model = make()
        for b in batches:
            for s in range(0, b.num_rows, BATCH):
                part = b.slice(s, BATCH)
                got = model.passages([t or "" for t in part.column(1).to_pylist()])
                rows = []
                for v in got:
                    n = math.sqrt(sum(x * x for x in v)) if v is not None else 0.0
                    rows.append([x / n for x in v] if n and math.isfinite(n) else None)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, type=arrow.field("vector").type)], schema=arrow)

    ship(docs.sparkSession)
    todo = src.where("vector is null and text is not null").select("id", "text").mapInArrow(run, spec)
    return src.where("vector is not null or text is null").select("id", "vector").unionByName(todo)


class ModelError(Exception):
    """A model that is away, too slow or answers nonsense; anything else that goes wrong is an error of the program."""


#: What a model's own code may raise when it is away.
AWAY = (OSError, TimeoutError, RuntimeError)


def _ranked(model, query: str, texts: list[str]) -> list[float]:
    try:
        scores = [float(x) for x in model.rank(query, texts)]
    except AWAY as e:
        raise ModelError(type(e).__name__) from e
    if len(scores) != len(texts) or not all(map(math.isfinite, scores)):
        raise ModelError("a finite score for every text")
    return scores


def rerank_scores(hits: DataFrame, query: str, make: Callable[[], object], text: str = "evidence") -> DataFrame:
    """``id, score`` of the first ``SHORTLIST`` hits (``id, rank`` and a text) by another model; texts are cut to ``EVIDENCE_BYTES`` bytes at a character."""
    spec = T.StructType.fromDDL("id string, score double")
    arrow = to_arrow_schema(spec)

    def run(batches):
        model = make()
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            cut = [(t or "").encode()[:EVIDENCE_BYTES].decode("utf-8", "ignore") for t in texts]
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(_ranked(model, query, cut))], schema=arrow)

    ship(hits.sparkSession)
    short = hits.where(F.col("rank") <= SHORTLIST).select(F.col("id").cast("string").alias("id"), F.col(text).alias("t"))
    return short.mapInArrow(run, spec)


def rerank_or_keep(ranked: DataFrame, hits: DataFrame, query: str, make: Callable[[], object], text: str = "evidence") -> tuple[DataFrame, str]:
    """Reranked order and ``ranked``; if the model fails (``ModelError``), the order as it was and ``fallback``.  A result list, so it is evaluated here."""
    from .retrieval import rerank

    try:
        scores = rerank_scores(hits, query, make, text).collect()
        df = ranked.sparkSession.createDataFrame(scores, "id string, score double")
        return rerank(ranked.withColumn("id", F.col("id").cast("string")), df), "ranked"
    except PythonException as e:
        raised = f"{ModelError.__module__}.{ModelError.__qualname__}"
        if not any(line.startswith(raised) for line in str(e).splitlines()):
            raise
        return ranked.withColumn("position", F.col("rank")), "fallback"


class ResponseCache:
    """Answers of a remote model under the hash of what was asked, the newest ``most`` kept."""

    def __init__(self, spark, folder: str, most: int = 512):
        self.files, self.most = Folder(spark, folder), most

    @staticmethod
    def key(request: dict) -> str:
        return hashlib.sha256(json.dumps(request, sort_keys=True, separators=(",", ":")).encode()).hexdigest()

    def get(self, request: dict) -> object | None:
        found = [n for n in self.files.names() if n.endswith(self.key(request))]
        return json.loads(self.files.read(found[-1])) if found else None

    def put(self, request: dict, answer: object) -> None:
        known = [n for n in self.files.names() if n[:1].isdigit()]
        self.files.replace(f"{int(known[-1].split('-')[0]) + 1 if known else 0:012d}-{self.key(request)}", json.dumps(answer))
        known = [n for n in self.files.names() if n[:1].isdigit()]
        for n in known[: max(0, len(known) - self.most)]:
            self.files.remove(n)


#: Roles that a classifier may give a directory, and how sure it must be (fixed values).
ROLES, SURE = ("runtime", "application", "library", "tooling", "infrastructure", "tests", "documentation", "examples"), (0.6, 1.0)


def sure_roles(answers: DataFrame) -> DataFrame:
    """``directory, role`` of answers (``directory, role, confidence``) that name a known role surely enough; of several the surest."""
    ok = answers.where(F.col("role").isin(*ROLES) & F.col("confidence").between(*SURE))
    return ok.groupBy("directory").agg(F.max_by("role", F.struct("confidence", "role")).alias("role"))
