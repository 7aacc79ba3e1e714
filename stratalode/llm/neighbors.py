"""Most similar vectors for every vector (problem 7).

Vectors are scaled to unit length, so inner product is cosine.  Exact copies
form one class with its smallest ids; a class is indexed once, whatever its size.
Cells come from spherical k-means on a bounded sample, in two levels where there
are many, so their number grows with the collection and their size doesn't; every
class is stored in its nearest cell and asks in its ``probes`` nearest cells.
How many that are is measured: for about ``ASKED`` classes the true nearest are
found by a scan of all rows, and as many cells are asked as hold ``RECALL`` of them.

Within a cell, targets are scanned by four-bit product codes whose codebooks
minimise the score-aware loss: the part of a residual parallel to its vector,
which changes large inner products, weighs ``eta`` times the orthogonal part.  The
best ``rerank`` targets of every query are then scored exactly in float64.  Where
the error of the codes leaves open whether these hold its nearest, as in a crowd
of near-copies, the query is scored exactly against the whole block.

The sixteen-entry tables are applied as one matrix product over the decoded
codes, which gives the same sums as adding table entries subspace by subspace:
without byte shuffles at hand, gathers from tables take several times as long as
the product.  Vectors travel beside their codes, as fetching those of 64
candidates per query afterwards would move many times as much.

Defined results: null, zero, non-finite or empty vectors take no part; vectors of
different lengths are not compared, each length is a collection of its own; ties
(to ``PLACES`` decimals) are broken by the smaller id; a row is not its own neighbour, its copies are.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..operators.sample import hashed_sample
from ..operators.skew import salted_join
from ..sources.shared import cut
from ..sources.ship import ship

K = 5
#: Classes per cell, sampled classes per cell, and the least sample.
CELL, PER_CELL, LEAST_SAMPLE = 2000, 32, 8192
#: Beyond so many cells there are two levels; no level of one cell is fitted on more than ``MOST_SAMPLE`` classes, codebooks on ``CODE_SAMPLE``.
ONE_LEVEL, MOST_SAMPLE, CODE_SAMPLE = 4096, 131_072, 16_384
#: Coarse cells whose fine cells a class looks at, beyond twice its probes.
WIDER = 8
#: Classes whose true nearest are found to measure how many cells must be asked, the share of these that the asked cells must hold, and that share where only near ones count.
ASKED, RECALL, RECALL_NEAR = 512, 0.96, 0.999
LEAST_PROBES, RERANK = 2, 64
#: More than products of unit vectors in float32 and the rounding of scores are off by.
SLACK = 1e-5
#: Decimals of a cosine that float32 vectors carry; scores that agree in them are equal.
PLACES = 7
#: Targets, and queries, of one cell that one task scans; a larger cell is split on both sides.
BLOCK, ASK_BLOCK = 8192, 32_768
SUBSPACES, CODES, THRESHOLD = 32, 16, 0.2
#: Queries of one pass of the search over all rows, and lengths of vectors told apart.
PASS, MOST_LENGTHS = 65_536, 16


class AnisotropicCodes:
    """Product codes of 4 bits per subspace under the score-aware loss |r|^2 + (eta - 1) <r, x>^2."""

    def __init__(self, books: np.ndarray, eta: float):
        self.books, self.eta = books, eta  # (subspaces, 16, width)

    @classmethod
    def fit(cls, x: np.ndarray, subspaces: int = SUBSPACES, threshold: float = THRESHOLD, rounds: int = 4, seed: int = 7) -> AnisotropicCodes:
        n, d = x.shape
        subspaces = math.gcd(subspaces, d)
        w = d // subspaces
        eta = max(1.0, (d - 1) * threshold**2 / (1 - threshold**2))
        rng = np.random.default_rng(seed)
        parts = x.reshape(n, subspaces, w)
        start = rng.choice(n, CODES, replace=n < CODES)
        self = cls(np.ascontiguousarray(parts[start].transpose(1, 0, 2)).astype(np.float32), eta)
        for _ in range(rounds):
            codes = self.encode(x)
            # least squares over all codewords at once: (N + (eta - 1) U'U) c = eta * sum B'x, with u = B'x per vector
            size = subspaces * CODES * w
            u = np.zeros((n, subspaces, CODES, w), np.float32)
            rows = np.arange(n)[:, None]
            u[rows, np.arange(subspaces)[None, :], codes] = parts
            u = u.reshape(n, size)
            counts = np.stack([np.bincount(codes[:, m], minlength=CODES) for m in range(subspaces)]).astype(np.float64)
            a = (eta - 1) * (u.T @ u).astype(np.float64)
            a[np.diag_indices(size)] += np.repeat(counts.reshape(-1), w) + 1e-3
            b = eta * u.sum(0).astype(np.float64) + 1e-3 * self.books.reshape(-1)
            self.books = np.linalg.solve(a, b).reshape(subspaces, CODES, w).astype(np.float32)
        return self

    def encode(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes by coordinate descent from the nearest codewords."""
        n, d = x.shape
        m_all, _, w = self.books.shape
        parts = x.reshape(n, m_all, w)
        codes = np.empty((n, m_all), np.uint8)
        along = np.empty((n, m_all), np.float32)  # <x_m, r_m>
        for m in range(m_all):
            dots = parts[:, m] @ self.books[m].T
            norm = (self.books[m] ** 2).sum(1)
            codes[:, m] = (norm - 2 * dots).argmin(1)
            along[:, m] = (parts[:, m] ** 2).sum(1) - dots[np.arange(n), codes[:, m]]
        total = along.sum(1)
        for _ in range(sweeps):
            for m in range(m_all):
                p = parts[:, m]
                dots = p @ self.books[m].T
                own = (p**2).sum(1, keepdims=True)
                square = own - 2 * dots + (self.books[m] ** 2).sum(1)
                r = own - dots
                rest = (total - along[:, m])[:, None]
                best = (square + (self.eta - 1) * (rest + r) ** 2).argmin(1)
                codes[:, m] = best
                now = r[np.arange(n), best]
                total += now - along[:, m]
                along[:, m] = now
        return codes

    def decode(self, codes: np.ndarray) -> np.ndarray:
        m = np.arange(self.books.shape[0])
        return self.books[m, codes].reshape(len(codes), -1)


def pack(codes: np.ndarray) -> np.ndarray:
    """Two codes per byte."""
    if codes.shape[1] % 2:
        codes = np.concatenate([codes, np.zeros((len(codes), 1), np.uint8)], 1)
    return codes[:, ::2] | (codes[:, 1::2] << 4)


def unpack(packed: np.ndarray, subspaces: int) -> np.ndarray:
    out = np.empty((len(packed), packed.shape[1] * 2), np.uint8)
    out[:, ::2], out[:, 1::2] = packed & 15, packed >> 4
    return out[:, :subspaces]


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([(x[s : s + 4096] @ c.T).argmax(1) for s in range(0, len(x), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        norm = np.linalg.norm(total, axis=1)
        full = norm > 0
        c[full] = total[full] / norm[full, None]
    return c


def unit_rows(df: DataFrame, ident: str, vector: str) -> DataFrame:
    """``id, key, unit``: float32 unit vectors as bytes, and a key equal for exact copies only."""
    spec = T.StructType.fromDDL("id bigint, key binary, unit binary")
    arrow = to_arrow_schema(spec)

    def run(batches):
        for b in batches:
            lists = b.column(1)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
            sizes = np.diff(lists.offsets.to_numpy())
            ids = b.column(0).to_numpy()
            starts = np.concatenate([[0], np.cumsum(sizes)])
            for n in np.unique(sizes):  # vectors of one length form a matrix
                at = np.flatnonzero(sizes == n)
                if not n:
                    continue
                x = flat[starts[at][:, None] + np.arange(n)]
                with np.errstate(over="ignore", invalid="ignore"):
                    norm = np.linalg.norm(x.astype(np.float64), axis=1)
                ok = np.isfinite(norm) & (norm > 0)
                x, norm = x[ok], norm[ok]
                yield _table({"id": ids[at[ok]], "key": [xxhash.xxh3_128_digest(r.tobytes()) for r in x], "unit": _bytes((x / norm[:, None]).astype(np.float32))}, arrow)

    src = df.where(F.col(vector).isNotNull() & F.col(ident).isNotNull() & ~F.exists(F.col(vector), lambda x: x.isNull())).select(F.col(ident).cast("bigint").alias("id"), F.col(vector).cast("array<float>").alias("v"))
    ship(df.sparkSession)
    return src.mapInArrow(run, spec)


class Index:
    """Cells and codebooks.  Sent to every task: one centroid per ``CELL`` classes, a five-hundredth of the vectors' own size at 64 numbers, and 16 codewords per subspace."""

    def __init__(self, centroids: np.ndarray, codes: AnisotropicCodes, coarse: np.ndarray | None = None, of: np.ndarray | None = None):
        self.centroids, self.codes, self.width = centroids, codes, centroids.shape[1]
        self.coarse, self.of = coarse, of  # coarse centroids, and for each of them where its fine cells begin (sorted by coarse cell)

    @classmethod
    def fit(cls, units: DataFrame) -> Index | None:
        """Fitted on a sample chosen by hash: ``PER_CELL`` classes per cell; units must be of one length."""
        n = units.count()
        if not n:
            return None
        cells = math.ceil(n / CELL)
        two = cells > ONE_LEVEL
        first = math.ceil(math.sqrt(cells)) if two else cells
        rows = hashed_sample(units, F.col("id"), max(LEAST_SAMPLE, min(MOST_SAMPLE, first * PER_CELL * (8 if two else 1))), n).select("id", "unit").collect()
        rows.sort(key=lambda r: r.id)
        x = np.stack([np.frombuffer(u, np.float32) for u in dict.fromkeys(r.unit for r in rows)])  # copies count once
        part = np.random.default_rng(5).permutation(len(x))[:CODE_SAMPLE]
        codes = AnisotropicCodes.fit(x[part])
        top = spherical_kmeans(x, min(first, len(x)))
        if not two:
            return cls(top, codes)
        fine = cls._fine(hashed_sample(units, F.col("id"), cells * PER_CELL, n), top)
        order = sorted(fine)
        at = np.searchsorted(np.repeat(order, [len(fine[c]) for c in order]), np.arange(len(top) + 1))
        return cls(np.concatenate([fine[c] for c in order]), codes, top, at)

    @staticmethod
    def _fine(sample: DataFrame, top: np.ndarray) -> dict[int, np.ndarray]:
        """Fine centroids per coarse cell, each fitted in a task of its own on at most ``MOST_SAMPLE`` sampled classes."""
        shared = sample.sparkSession.sparkContext.broadcast(top)
        spec, out = T.StructType.fromDDL("coarse int, place bigint, unit binary"), T.StructType.fromDDL("coarse int, centroids binary")

        def near(batches):
            for b in batches:
                raw = b.column(1).to_pylist()
                if raw:
                    x = np.frombuffer(b"".join(raw), np.float32).reshape(len(raw), -1)
                    yield _table({"coarse": (x @ shared.value.T).argmax(1).astype(np.int32), "place": [xxhash.xxh64_intdigest(r) >> 1 for r in raw], "unit": raw}, to_arrow_schema(spec))

        placed = sample.select("id", "unit").mapInArrow(near, spec)
        sizes = {r.coarse: r["count"] for r in placed.groupBy("coarse").count().collect()}  # one row per coarse cell
        share = F.coalesce(F.create_map(*[F.lit(v) for c, m in sizes.items() for v in (c, min(1.0, MOST_SAMPLE / m))])[F.col("coarse")], F.lit(1.0))
        kept = placed.where(F.pmod(F.col("place"), F.lit(1 << 20)) < share * (1 << 20))

        def fit(group: pa.Table) -> pa.Table:
            raw = sorted(set(group.column("unit").to_pylist()))
            c = group.column("coarse")[0].as_py()
            x = np.frombuffer(b"".join(raw), np.float32).reshape(len(raw), -1)
            k = max(1, min(len(x), round(sizes[c] / PER_CELL), ONE_LEVEL))
            return pa.Table.from_batches([_table({"coarse": [c], "centroids": [spherical_kmeans(x, k).tobytes()]}, to_arrow_schema(out))])

        rows = kept.groupBy("coarse").applyInArrow(fit, out).collect()  # one centroid per CELL classes
        return {r.coarse: np.frombuffer(r.centroids, np.float32).reshape(-1, top.shape[1]) for r in rows}

    def nearest(self, x: np.ndarray, probes: int) -> np.ndarray:
        """The ``probes`` nearest cells of each row, nearest first; -1 where a row looks at fewer."""
        p = min(probes, len(self.centroids))
        if self.coarse is None:
            score = x @ self.centroids.T
            near = np.argpartition(-score, p - 1, axis=1)[:, :p]
            return np.take_along_axis(near, np.argsort(-np.take_along_axis(score, near, 1), axis=1, kind="stable"), 1)
        first = x @ self.coarse.T
        first[:, self.of[1:] == self.of[:-1]] = -9.0
        c = min(2 * p + WIDER, len(self.coarse))
        look = np.argpartition(-first, c - 1, axis=1)[:, :c]
        best, who = np.full((len(x), p), -9.0, np.float32), np.full((len(x), p), -1, np.int64)
        for cell in np.unique(look):
            lo, hi = self.of[cell], self.of[cell + 1]
            rows = np.flatnonzero((look == cell).any(1))
            if hi == lo or not len(rows):
                continue
            score = x[rows] @ self.centroids[lo:hi].T
            m = min(p, hi - lo)
            at = np.argpartition(-score, m - 1, axis=1)[:, :m]
            both = np.concatenate([best[rows], np.take_along_axis(score, at, 1)], 1)
            names = np.concatenate([who[rows], at + lo], 1)
            order = np.argsort(-both, axis=1, kind="stable")[:, :p]
            best[rows], who[rows] = np.take_along_axis(both, order, 1), np.take_along_axis(names, order, 1)
        return who


def _table(rows: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[f.name], type=f.type) for f in schema], schema=schema)


def _bytes(a: np.ndarray) -> list[bytes]:
    return [r.tobytes() for r in a]


def place(units: DataFrame, index: Index, probes: int) -> DataFrame:
    """Each class once as a target (with codes) and ``probes`` times as a query."""
    shared = units.sparkSession.sparkContext.broadcast(index)
    spec = T.StructType.fromDDL("cell int, target boolean, key binary, unit binary, codes binary, ids array<bigint>")
    arrow = to_arrow_schema(spec)

    def run(batches):
        ix = shared.value
        for b in batches:
            for s in range(0, b.num_rows, 4096):
                part = b.slice(s, 4096)
                n = part.num_rows
                keys, raw, ids = part.column(0), part.column(1), part.column(2)
                x = np.frombuffer(b"".join(raw.to_pylist()), np.float32).reshape(n, ix.width)
                near = ix.nearest(x, probes).astype(np.int32)
                codes = _bytes(pack(ix.codes.encode(x)))
                yield pa.RecordBatch.from_arrays([pa.array(near[:, 0]), pa.array(np.ones(n, bool)), keys, raw, pa.array(codes, pa.binary()), ids.cast(arrow.field("ids").type)], schema=arrow)
                for j in range(near.shape[1]):
                    ask = pa.array(np.flatnonzero(near[:, j] >= 0))
                    m = len(ask)
                    yield pa.RecordBatch.from_arrays([pa.array(near[:, j]).take(ask), pa.array(np.zeros(m, bool)), keys.take(ask), raw.take(ask), pa.nulls(m, pa.binary()), pa.nulls(m, arrow.field("ids").type)], schema=arrow)

    ship(units.sparkSession)
    return units.select("key", "unit", "ids").mapInArrow(run, spec)


def probes_for(units: DataFrame, index: Index, total: int, k: int, least: float, recall: float) -> int:
    """How many cells must be asked so that they hold ``recall`` of the true nearest of about ``ASKED`` rows.

    The true nearest come from one exact scan of all rows for these few queries.
    """
    if len(index.centroids) == 1:
        return 1
    asked = hashed_sample(units, F.concat(F.lit("asked"), F.col("id").cast("string")), ASKED, total).select("unit").distinct().collect()
    q = np.stack([np.frombuffer(r.unit, np.float32) for r in sorted(asked)])
    shared = units.sparkSession.sparkContext.broadcast(q)
    spec = T.StructType.fromDDL("q int, score double, unit binary")
    arrow = to_arrow_schema(spec)

    def run(batches):
        q, best = shared.value, {}
        for b in batches:
            raw = b.column(0).to_pylist()
            for s in range(0, len(raw), 4096):
                part = raw[s : s + 4096]
                score = q @ np.frombuffer(b"".join(part), np.float32).reshape(len(part), -1).T
                m = min(2 * k + 1, len(part))
                at = np.argpartition(-score, m - 1, axis=1)[:, :m]
                for i in range(len(q)):
                    got = best.setdefault(i, {})
                    got.update((part[j], float(score[i, j])) for j in at[i])
                    if len(got) > 4 * k + 4:
                        best[i] = dict(sorted(got.items(), key=lambda x: -x[1])[: k + 1])
        rows = [(i, v, u) for i, got in best.items() for u, v in sorted(got.items(), key=lambda x: -x[1])[: k + 1]]
        if rows:
            a, v, u = zip(*rows)
            yield _table({"q": a, "score": v, "unit": u}, arrow)

    hits = units.select("unit").mapInArrow(run, spec).distinct()
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "unit"))
    rows = hits.withColumn("r", rank).where(F.col("r") <= k + 1).collect()  # ASKED * (k + 1) rows
    own = [x.tobytes() for x in q]
    rows = [r for r in rows if r.unit != own[r.q] and r.score >= least]
    if not rows:
        return LEAST_PROBES
    home = index.nearest(np.stack([np.frombuffer(r.unit, np.float32) for r in rows]), 1)[:, 0]
    p = LEAST_PROBES
    while True:
        near = index.nearest(q, p)
        held = np.mean([home[i] in near[r.q] for i, r in enumerate(rows)])
        if held >= recall or p >= len(index.centroids):
            return p
        p = p + max(1, p // 4)


def _exact(q: np.ndarray, t: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Scores in float64 of pairs of positions."""
    out = np.empty(len(rows))
    for s in range(0, len(rows), 65_536):
        out[s : s + 65_536] = np.einsum("nd,nd->n", q[rows[s : s + 65_536]].astype(np.float64), t[cols[s : s + 65_536]].astype(np.float64))
    return out


def best_of(index: Index, q: np.ndarray, t: np.ndarray, codes: np.ndarray, rerank: int, keep: int = K + 1, floor: np.ndarray | float = -2.0, certain: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Positions and exact scores, per query, of the ``rerank`` targets with the best coded scores.

    A coded score is off by at most the length of the target's residual, and seldom
    by more than three times what a direction of no relation to it would give, or
    a quarter more than the worst seen among the scored.  Where the first
    (``certain``) or the second leaves room for an unscored target beyond ``floor``
    and among the best ``keep`` (ties included), the query is scored against every
    target instead.
    Rows with fewer positions than others are filled up with scores of -9.
    """
    decoded = index.codes.decode(unpack(codes, index.codes.books.shape[0]))
    approx = q @ decoded.T
    r = min(rerank, len(t))
    if r == len(t):
        at = np.broadcast_to(np.arange(len(t)), (len(q), len(t)))
        return at, np.einsum("qd,qrd->qr", q.astype(np.float64), t[at].astype(np.float64))
    at = np.argpartition(-approx, r - 1, axis=1)[:, :r]
    score = np.einsum("qd,qrd->qr", q.astype(np.float64), t[at].astype(np.float64))
    kept = np.partition(score, r - keep, axis=1)[:, r - keep] if keep <= r else np.full(len(q), -2.0)
    floor = np.broadcast_to(floor, len(q))
    least = np.maximum(kept, floor) - SLACK
    off = np.linalg.norm(t.astype(np.float64) - decoded, axis=1).astype(np.float32)
    if not certain:
        worst = 1.25 * (score - np.take_along_axis(approx, at, 1)).max(1).astype(np.float32)
        off = np.minimum(off, np.maximum(3 / math.sqrt(q.shape[1]) * off, worst[:, None]))
    np.put_along_axis(approx, at, -9.0, 1)
    approx += off
    open_ = np.flatnonzero(approx.max(1) >= least)
    if not len(open_):
        return at, score
    # the whole block in float32, then in float64 what that cannot tell from the best ``keep``
    near = q[open_] @ t.T
    if keep <= len(t):
        least[open_] = np.maximum(np.partition(near, len(t) - keep, axis=1)[:, len(t) - keep], floor[open_]) - SLACK
    rows, cols = np.nonzero(near >= least[open_, None])
    exact = _exact(q[open_], t, rows, cols)
    slot = np.arange(len(rows)) - np.searchsorted(rows, rows)
    width = max(r, int(slot.max(initial=-1)) + 1)
    if width > r:
        at, score = np.pad(at, ((0, 0), (0, width - r))), np.pad(score, ((0, 0), (0, width - r)), constant_values=-9.0)
    at[open_], score[open_] = 0, -9.0
    at[open_[rows], slot], score[open_[rows], slot] = cols, exact
    return at, score


def class_neighbors(classes: DataFrame, index: Index, probes: int, rerank: int = RERANK, least: float = -2.0, k: int = K) -> DataFrame:
    """``key, near``: per class the best ``k + 1`` ``(score, id)`` of all classes it met, its own ids among them."""
    shared = classes.sparkSession.sparkContext.broadcast(index)
    placed = place(classes, index, probes)
    # a crowded cell is cut on both sides: every block of its targets meets every block of its queries once
    sizes = placed.groupBy("cell").agg(F.sum(F.col("target").cast("int")).alias("t"), F.count("*").alias("n"))
    crowded = sizes.where((F.col("t") > BLOCK) | (F.col("n") - F.col("t") > ASK_BLOCK)).select("cell", F.ceil(F.col("t") / BLOCK).cast("int").alias("tb"), F.ceil((F.col("n") - F.col("t")) / ASK_BLOCK).cast("int").alias("qb"))
    blocks = {r.cell: (max(1, r.tb), max(1, r.qb)) for r in crowded.collect()}  # at most one row per cell
    if blocks:
        of = lambda i: F.coalesce(F.create_map(*[F.lit(v) for c, b in blocks.items() for v in (c, b[i])])[F.col("cell")], F.lit(1))
        tb, qb, h = of(0), of(1), F.xxhash64("key")
        mine = F.when(F.col("target"), F.transform(F.sequence(F.lit(0), qb - 1), lambda j: F.pmod(h, tb).cast("int") * qb + j)).otherwise(F.transform(F.sequence(F.lit(0), tb - 1), lambda i: i * qb + F.pmod(h, qb).cast("int")))
        placed = placed.withColumn("block", F.explode(mine))
    else:
        placed = placed.withColumn("block", F.lit(0))
    # one group a task: what a task reads doesn't grow with the collection
    groups = len(index.centroids) - len(blocks) + sum(t * q for t, q in blocks.values())
    placed = placed.repartition(max(groups, int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "cell", "block")
    out = T.StructType.fromDDL("key binary, score double, id bigint")
    arrow = to_arrow_schema(out)

    def scan(group: pa.Table) -> pa.Table:
        ix = shared.value
        kind = group.column("target").to_numpy(zero_copy_only=False)
        empty = pa.Table.from_batches([], schema=arrow)
        ti, qi = np.flatnonzero(kind), np.flatnonzero(~kind)
        if not len(ti) or not len(qi):
            return empty

        def matrix(rows):
            return np.frombuffer(b"".join(group.column("unit").take(pa.array(rows)).to_pylist()), np.float32).reshape(len(rows), ix.width)

        t, targets = matrix(ti), group.take(pa.array(ti))
        codes = np.frombuffer(b"".join(targets.column("codes").to_pylist()), np.uint8).reshape(len(ti), -1)
        ids = targets.column("ids").to_pylist()
        keys = group.column("key").take(pa.array(qi)).to_pylist()
        q, found = matrix(qi), []
        for s in range(0, len(qi), 1024):
            at, score = best_of(ix, q[s : s + 1024], t, codes, rerank, k + 1, least, least > 0)
            rows, cols = np.nonzero(score >= least)
            if not len(rows):
                continue
            order = np.lexsort((-score[rows, cols], rows))
            rows, cols = rows[order], cols[order]
            starts = np.searchsorted(rows, np.arange(len(at)))
            ends = np.searchsorted(rows, np.arange(len(at)), "right")
            for r in range(len(at)):
                got, rank, last = [], 0, None
                for j in range(starts[r], ends[r]):
                    v = round(float(score[r, cols[j]]), PLACES)
                    if rank > k and v != last:
                        break
                    members = ids[at[r, cols[j]]]
                    got += [(v, m) for m in members]
                    rank += len(members)
                    last = v
                got.sort(key=lambda x: (-x[0], x[1]))
                found += [(keys[s + r], v, m) for v, m in got[: k + 1]]
        if not found:
            return empty
        a, b, c = zip(*found)
        return pa.Table.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.float64()), pa.array(c, pa.int64())], schema=arrow)

    ship(classes.sparkSession)
    hits = placed.groupBy("cell", "block").applyInArrow(scan, out)
    # at most probes * blocks * (k + 1) rows per class
    near = hits.groupBy("key").agg(F.collect_set(F.struct((-F.col("score")).alias("cost"), "id")).alias("near"))
    return near.select("key", F.slice(F.array_sort("near"), 1, k + 1).alias("near"))


def neighbors(df: DataFrame, ident: str = "id", vector: str = "vector", k: int = K, least: float = -2.0, probes: int | None = None, rerank: int = RERANK) -> DataFrame:
    """``id, rank, neighbor, cosine``: for every row with a vector its ``k`` most similar rows of at least ``least``.

    ``probes``: cells asked per class; measured (``probes_for``) if not given.
    """
    spark, spec = df.sparkSession, "id bigint, rank int, neighbor bigint, cosine double"
    scaled = cut(unit_rows(df, ident, vector))  # scaled once; classes, sample and rows read it back
    out = None
    for size in _lengths(scaled):
        units = scaled.where(F.octet_length("unit") == size)
        w = Window.partitionBy("key").orderBy("id")
        first = units.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k + 1)  # cut per task before the shuffle, so a crowd of copies doesn't travel
        classes = first.groupBy("key").agg(F.min("unit").alias("unit"), F.array_sort(F.collect_list("id")).alias("ids"))
        index = Index.fit(units)
        p = probes or probes_for(units, index, units.count(), k, least, RECALL_NEAR if least > 0 else RECALL)
        near = class_neighbors(classes, index, p, rerank, least, k)
        rows = salted_join(units.select("id", "key"), near, ["key"], F.col("id"))
        others = F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, k)
        got = rows.select("id", F.posexplode(others).alias("rank", "n")).select("id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("n.id").alias("neighbor"), (-F.col("n.cost")).alias("cosine"))
        out = got if out is None else out.unionByName(got)
    return spark.createDataFrame([], spec) if out is None else out


def _lengths(units: DataFrame) -> list[int]:
    """Sizes in bytes of the vectors."""
    sizes = [r.n for r in units.groupBy(F.octet_length("unit").alias("n")).count().orderBy(F.desc("count"), "n").limit(MOST_LENGTHS + 1).collect()]
    if len(sizes) > MOST_LENGTHS:
        raise ValueError(f"vectors of more than {MOST_LENGTHS} different lengths")
    return sizes


def similar_pairs(df: DataFrame, least: float = 0.9, k: int = K) -> DataFrame:
    """``id_a, id_b``: pairs of at least that cosine of which one is among the other's ``k`` most similar rows."""
    n = neighbors(df, k=k, least=least)
    return n.select(F.least("id", "neighbor").alias("id_a"), F.greatest("id", "neighbor").alias("id_b")).distinct()


def search(df: DataFrame, queries: DataFrame, ident: str = "id", vector: str = "vector", k: int = K, rerank: int = RERANK) -> DataFrame:
    """``id, rank, neighbor, cosine`` of the rows of ``queries`` against all rows of ``df``.

    No cells: each batch of rows is scanned by code for all queries of a pass and
    its best are scored exactly.  Queries go in passes of ``PASS`` (16 MB of
    64 numbers), so what a pass sends to the tasks is bounded however many there are.
    """
    none = "id bigint, rank int, neighbor bigint, cosine double"
    scaled, wanted = cut(unit_rows(df, ident, vector)), unit_rows(queries, ident, vector)
    result = None
    for size in _lengths(scaled):
        same = F.octet_length("unit") == size
        hits = _scan_all(scaled.where(same), wanted.where(same), k, rerank)
        if hits is not None:
            result = hits if result is None else result.union(hits)
    if result is None:
        return df.sparkSession.createDataFrame([], none)
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbor"))
    return result.withColumn("rank", rank).where(F.col("rank") <= k).select("id", "rank", "neighbor", "cosine")


def _scan_all(units: DataFrame, asked: DataFrame, k: int, rerank: int) -> DataFrame | None:
    """``id, cosine, neighbor``: the best ``k`` of every task for every query."""
    spec = T.StructType.fromDDL("id bigint, cosine double, neighbor bigint")
    arrow = to_arrow_schema(spec)
    total = asked.count()
    if not total:
        return None
    index = Index.fit(units)
    passes = math.ceil(total / PASS)
    spark = units.sparkSession
    ship(spark)
    result = None
    for p in range(passes):
        part = asked.where(F.pmod(F.xxhash64("id"), F.lit(passes)) == p).select("id", "unit").collect()
        if not part:
            continue
        shared = spark.sparkContext.broadcast((index, np.array([r.id for r in part]), np.stack([np.frombuffer(r.unit, np.float32) for r in part])))

        def run(batches, shared=shared):
            ix, ids, q = shared.value
            best = np.full((len(q), k), -9.0)
            who = np.full((len(q), k), -1, np.int64)
            for b in batches:
                for s in range(0, b.num_rows, 4096):
                    piece = b.slice(s, 4096)
                    raw, mine = piece.column(1).to_pylist(), piece.column(0).to_numpy()
                    t = np.frombuffer(b"".join(raw), np.float32).reshape(-1, ix.width)
                    codes = pack(ix.codes.encode(t))
                    for a in range(0, len(q), 1024):
                        at, score = best_of(ix, q[a : a + 1024], t, codes, rerank, k + 1, best[a : a + 1024, -1])
                        other = mine[at]
                        score = np.where(other == ids[a : a + 1024, None], -9.0, np.round(score, PLACES))
                        both, names = np.concatenate([best[a : a + 1024], score], 1), np.concatenate([who[a : a + 1024], other], 1)
                        order = np.lexsort((names, -both), axis=1)[:, :k]
                        best[a : a + 1024] = np.take_along_axis(both, order, 1)
                        who[a : a + 1024] = np.take_along_axis(names, order, 1)
            for a in range(0, len(q), 4096):
                r, c = np.nonzero(best[a : a + 4096] > -2)
                if len(r):
                    yield _table({"id": ids[a + r], "cosine": best[a + r, c], "neighbor": who[a + r, c]}, arrow)

        hits = units.select("id", "unit").mapInArrow(run, spec)
        result = hits if result is None else result.union(hits)
    return result
