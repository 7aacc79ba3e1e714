"""Mixing sources to target weights (problem 9).

1. Tokens of every document are counted with a public tokenizer.
2. A naive Bayes classifier over the labelled table (hashed words of the text and
   the values of ``columns``) is fitted on a bounded sample of labelled rows (about
   ``TRAIN_ROWS``, chosen by hash), in two halves: a row is judged by the half it
   isn't in, so its own label never speaks for it.  How much the words count
   against the columns is what predicts the other half best.
3. Sources that the classifier can't tell apart form one domain; a document's
   posterior over sources becomes one over domains.
4. Documents of one source, most likely domain and tenth of its probability share
   a rate, between 0 and the source's ``max_repeats``.  One distributed pass sums
   their tokens and expected domain tokens; projected gradient on these sums fits
   the rates by least squares, so that expected domain totals meet the targets of
   their sources, over the rates that give every source its own.  Within a source,
   documents that read like another domain thereby give way to those that don't.
5. Rates become whole repeats: the integer part for every document, one more for
   the documents below a hash threshold chosen so that the source's counted
   tokens come as near to its target as whole documents allow.

A source's target is its share of all tokens of the documents table (``total``
can set another size).  A source that cannot reach it, because even all its
documents ``max_repeats`` times are too few, is taken in full and reported as
short; a source without documents reports 0.  Rows with null source belong to no
target; null texts have no tokens and are not chosen.
"""

from __future__ import annotations

import base64
import math
import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.rowmap import map_rows
from ..operators.sample import hashed_sample
from ..sources.shared import cut

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Split pattern that belongs to the byte-level vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TRAIN_ROWS, HASHES, STEPS = 20_000, 1 << 13, 300
#: Columns of the table the classifier may look at, where there are such.
COLUMNS = ("genre", "repository", "lang")
#: Sources, and groups of documents that share a rate, that the driver holds.
MOST_SOURCES, MOST_GROUPS = 1000, 200_000
#: Two sources are one domain if a document of one is given at least this share of what the other's own documents are given.
SAME = 0.5
#: Posterior entries below this are left out.
LEAST = 1e-3
BUCKETS = 4096
_WORD = re.compile(r"[^\W\d_]+")


def _words(text: str) -> list[int]:
    return [xxhash.xxh32_intdigest(w) % HASHES for w in set(_WORD.findall(text.lower()))]


class Posterior:
    """Log probabilities of hashed words and of column values per source."""

    def __init__(self, sources: list[str], rows: list[tuple], smooth: float = 0.05):
        """``rows``: source, text, values of the columns."""
        self.sources, n = sources, len(sources)
        at = {s: k for k, s in enumerate(sources)}
        counts, per = np.full((n, HASHES), smooth, np.float64), np.full(n, 0.5)
        width = len(rows[0]) - 2 if rows else 0
        seen: list[dict] = [{} for _ in range(width)]
        for source, text, *values in rows:
            k = at[source]
            counts[k, _words(text or "")] += 1
            per[k] += 1
            for column, v in zip(seen, values):
                column.setdefault(v, np.full(n, smooth))[k] += 1
        self.log = np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32).T.copy()
        self.prior = np.log(per / per.sum())
        self.columns = [{v: np.log(c / (per + smooth * (len(column) + 1))) for v, c in column.items()} for column in seen]
        self.other = [np.log(smooth / (per + smooth * (len(column) + 1))) for column in seen]
        self.weight = 0.0

    def parts(self, text: str, values: tuple) -> tuple[np.ndarray, np.ndarray]:
        f = _words(text or "")
        table = self.prior + sum((c.get(v, o) for c, o, v in zip(self.columns, self.other, values)), np.zeros(len(self.sources)))
        return table, self.log[f].sum(0) if f else np.zeros(len(self.sources))

    def of(self, text: str, values: tuple) -> np.ndarray:
        table, words = self.parts(text, values)
        return _normal(table + self.weight * words)


def _normal(score: np.ndarray) -> np.ndarray:
    p = np.exp(score - score.max())
    return p / p.sum()


def fold_of(ident: int) -> int:
    """The half of the sample a document belongs to."""
    return xxhash.xxh32_intdigest(str(ident)) & 1


def fit_classifier(sources: list[str], rows: list[tuple]) -> tuple[list[Posterior], list[list[int]]]:
    """Two models, each for the documents of its number's fold, and the domains as lists of source numbers.

    ``rows``: doc_id, source, text, values of the columns.
    """
    halves = [[r[1:] for r in rows if fold_of(r[0]) == f] for f in (0, 1)]
    models = [Posterior(sources, halves[1]), Posterior(sources, halves[0])]
    at = {s: k for k, s in enumerate(sources)}
    judged = [(f, at[r[0]], models[f].parts(r[1], tuple(r[2:]))) for f in (0, 1) for r in halves[f][:2000]]
    weights = (0.0, 0.01, 0.03, 0.1, 0.3, 1.0)
    fit = {w: sum(math.log(max(_normal(t + w * x)[k], 1e-12)) for _, k, (t, x) in judged) for w in weights}
    best = max(weights, key=lambda w: (fit[w], -w))
    for m in models:
        m.weight = best
    n = len(sources)
    given, seen = np.zeros((n, n)), np.zeros(n)
    for _, k, (t, x) in judged:
        given[k] += _normal(t + best * x)
        seen[k] += 1
    given /= np.maximum(seen, 1)[:, None]
    own = np.maximum(np.diag(given), 1e-12)
    like = given / own[None, :]
    group = list(range(n))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(n):
        for j in range(i):
            if seen[i] and seen[j] and like[i, j] >= SAME and like[j, i] >= SAME:
                a, b = sorted((top(i), top(j)))
                group[b] = a
    domains: dict[int, list[int]] = {}
    for i in range(n):
        domains.setdefault(top(i), []).append(i)
    return models, list(domains.values())


def read_bytes(spark: SparkSession, path: str) -> bytes:
    """A file of any file system Spark reads; a plain path is looked up on the driver's machine."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path if "://" in path else f"file://{path}")
    f = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(at)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(f))
    finally:
        f.close()


def token_counter(ranks: bytes):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return lambda text: len(encoding.encode_ordinary(text))


def _scored(documents: DataFrame, columns: list[str], models: list[Posterior], domains: list[list[int]], ranks: bytes) -> DataFrame:
    """Tokens, most likely domain, tenth of its probability, and the domains' posterior (``domain, p``) of every readable document."""
    shared = documents.sparkSession.sparkContext.broadcast((models, domains, ranks))

    def make():
        models, domains, raw = shared.value
        count = token_counter(raw)
        known = set(models[0].sources)

        def row(i, source, text, *values):
            if source not in known:
                return [(i, None, count(text), None, None, None)]
            p = models[fold_of(i)].of(text, values)
            d = [(k, float(p[m].sum())) for k, m in enumerate(domains)]
            d = [x for x in d if x[1] >= LEAST]
            total = sum(v for _, v in d)
            k, v = max(d, key=lambda x: x[1])
            return [(i, source, count(text), k, min(9, int(10 * v / total)), [{"domain": a, "p": b / total} for a, b in d])]

        return row

    src = documents.where(F.col("text").isNotNull()).select("doc_id", "source", "text", *columns)
    return map_rows(src, make, "doc_id bigint, source string, tokens bigint, top int, tenth int, posterior array<struct<domain: int, p: float>>")


def fit_rates(tokens: np.ndarray, expected: np.ndarray, source: np.ndarray, caps: np.ndarray, budget: np.ndarray, domain_of: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """A rate per group of documents: projected gradient on the squared relative gaps of expected domain totals.

    Every step is projected onto the rates between 0 and the source's cap that
    give each source its budget (or all it has), so source totals hold exactly.
    ``tokens``: of each group; ``expected``: its expected tokens per domain; ``source``:
    its source; ``caps``, ``budget``, ``domain_of``: per source.
    """
    n, d = len(caps), expected.shape[1]
    weight = np.maximum(tokens, 1e-9)
    cap = caps[source]
    goal = np.minimum(budget, np.bincount(source, weight, n) * caps)

    def project(v):
        """The nearest rates, by tokens, that meet the sources' budgets: all of a source move by the same amount, found by bisection."""
        low, high = np.full(n, -1.0 - np.abs(v).max()), np.full(n, 1.0 + np.abs(v).max() + caps.max(initial=0.0))
        for _ in range(50):
            mid = (low + high) / 2
            over = np.bincount(source, weight * np.clip(v + mid[source], 0.0, cap), n) > goal
            low, high = np.where(over, low, mid), np.where(over, mid, high)
        return np.clip(v + ((low + high) / 2)[source], 0.0, cap)

    scale = np.maximum(expected.sum(0), 1.0)
    a = (expected / scale).T
    b = np.bincount(domain_of, goal, d) / scale
    step = 1.0 / max(np.linalg.norm(a / np.sqrt(weight), 2) ** 2, 1e-12)
    rate = project(np.zeros(len(tokens)))
    for _ in range(steps):
        new = project(rate - step * (a.T @ (a @ rate - b)) / weight)
        moved = float(np.abs(new - rate).max(initial=0.0))
        rate = new
        if moved < 1e-7:
            break
    return rate


def mixture(documents: DataFrame, targets: DataFrame, total: int | None = None, ranks_path: str = RANKS, columns: tuple[str, ...] = COLUMNS) -> tuple[DataFrame, DataFrame]:
    """``doc_id, source, tokens, repeats`` of the chosen rows, and a row per target source with what it reached."""
    spark = documents.sparkSession
    wanted = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).orderBy("source").limit(MOST_SOURCES + 1).collect()
    if len(wanted) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    sources = [r.source for r in wanted]
    share = np.array([r.target_share or 0.0 for r in wanted])
    caps = np.array([float(max(r.max_repeats or 0, 0)) for r in wanted])
    looked = [c for c in columns if c in documents.columns]
    sample = []
    if sources:
        labelled = documents.where(F.col("source").isin(sources))
        sample = sorted(hashed_sample(labelled, F.col("doc_id"), TRAIN_ROWS, labelled.count()).where(F.col("text").isNotNull()).select("doc_id", "source", "text", *looked).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    ranks = read_bytes(spark, ranks_path)
    models, domains = fit_classifier(sources, [tuple(r) for r in sample])
    # counted and classified once; everything below reads it back
    scored = cut(_scored(documents, looked, models, domains, ranks))
    all_tokens = total if total is not None else int(scored.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0])
    known = scored.where(F.col("source").isNotNull())
    key = ["source", "top", "tenth"]
    sums = known.groupBy(*key).agg(F.sum("tokens").alias("tokens")).limit(MOST_GROUPS + 1).collect()
    if len(sums) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups of source, domain and probability")
    soft = known.select(*key, "tokens", F.explode("posterior").alias("x")).groupBy(*key, F.col("x.domain").alias("domain")).agg(F.sum(F.col("tokens") * F.col("x.p")).alias("t")).collect()
    at, place = {s: k for k, s in enumerate(sources)}, {(r.source, r.top, r.tenth): g for g, r in enumerate(sums)}
    expected = np.zeros((len(sums), max(1, len(domains))))
    for r in soft:
        expected[place[r.source, r.top, r.tenth], r.domain] = r.t
    domain_of = np.zeros(len(sources), int)
    for k, members in enumerate(domains):
        domain_of[members] = k
    rate = fit_rates(np.array([float(r.tokens) for r in sums]), expected, np.array([at[r.source] for r in sums], int), caps, share * all_tokens, domain_of) if sums else []
    rated = spark.createDataFrame([(r.source, r.top, r.tenth, float(x)) for r, x in zip(sums, rate)], "source string, top int, tenth int, rate double")
    rates = known.select("doc_id", "tokens", *key).join(F.broadcast(rated), key).select("doc_id", "source", "tokens", "rate")  # at most MOST_GROUPS rows
    limits = spark.createDataFrame([(s, float(x * all_tokens), int(c), float(x)) for s, x, c in zip(sources, share, caps)], "source string, budget double, max_repeats int, target_share double")
    limits = F.broadcast(limits)  # one row per source, at most MOST_SOURCES
    # whole repeats: the integer part of the rate for everyone, one more in the order of (hash / fraction), as in priority sampling
    rows = rates.join(limits.select("source", "max_repeats"), "source").withColumn("base", F.least(F.floor(F.col("rate") + 1e-6).cast("int"), F.col("max_repeats")))
    fraction = F.greatest(F.col("rate") - F.col("base"), F.lit(0.0)) + 1e-6
    order = F.when(F.col("base") < F.col("max_repeats"), F.least(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40) / fraction, F.lit(1e6)))
    rows = rows.withColumn("place", order).withColumn("bucket", F.least((F.col("place") * (BUCKETS / 4)).cast("int"), F.lit(BUCKETS)))
    per = rows.groupBy("source").agg(F.sum("tokens").alias("available"), F.sum(F.col("tokens") * F.col("base")).alias("given"), F.count("*").alias("documents")).join(limits, "source")
    goal = F.least(F.col("budget"), F.col("available") * F.col("max_repeats"))
    per = F.broadcast(cut(per.select("source", "documents", "available", (goal - F.col("given")).alias("open"))))
    buckets = rows.where(F.col("place").isNotNull()).groupBy("source", "bucket").agg(F.sum("tokens").alias("t"))
    before = F.sum("t").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    ladder = F.broadcast(cut(buckets.select("source", "bucket", F.coalesce(before, F.lit(0)).alias("before"), "t")))  # at most BUCKETS + 1 rows per source
    rows = rows.join(per.select("source", "open"), "source").join(ladder, ["source", "bucket"], "left")
    inside = F.coalesce((F.col("before") < F.col("open")) & (F.col("before") + F.col("t") > F.col("open")), F.lit(False))
    whole = rows.where(~inside).withColumn("extra", F.coalesce(F.col("before") + F.col("t") <= F.col("open"), F.lit(False)).cast("int"))
    # only the bucket in which the budget runs out is ordered document by document
    edge = rows.where(inside).withColumn("run", F.col("before") + F.sum("tokens").over(Window.partitionBy("source", "bucket").orderBy("place", "doc_id")))
    edge = edge.withColumn("extra", (F.col("run") - F.col("tokens") / 2 <= F.col("open")).cast("int")).drop("run")
    chosen = whole.unionByName(edge).withColumn("repeats", (F.col("base") + F.col("extra")).cast("int")).where("repeats > 0").select("doc_id", "source", "tokens", "repeats")

    got = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("chosen_tokens"), F.sum("repeats").alias("chosen_rows"))
    report = limits.join(per.select("source", "documents", "available"), "source", "left").join(got, "source", "left").na.fill(0, ["documents", "available", "chosen_tokens", "chosen_rows"])
    mixed = F.sum("chosen_tokens").over(Window.partitionBy(F.lit(0)))  # one row per source
    report = report.select(
        "source", "target_share", "max_repeats", "documents", F.col("available").alias("available_tokens"), "chosen_rows", "chosen_tokens",
        (F.col("chosen_tokens") / F.lit(float(max(all_tokens, 1)))).alias("reached_share"),
        F.when(mixed > 0, F.col("chosen_tokens") / mixed).otherwise(F.lit(0.0)).alias("share_of_mixture"),
        (F.col("available") * F.col("max_repeats") < F.col("budget")).alias("short"),
    )
    return chosen, report
