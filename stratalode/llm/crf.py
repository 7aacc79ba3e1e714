"""Conditional random fields over sparse binary features: linear-chain and semi-Markov.

Weights live in plain dictionaries from feature name to a list with one number
per label, so a trained model is a small JSON file and scoring needs no matrix.
Both are trained by Adagrad on the conditional log-likelihood with an L2 term.
"""

from __future__ import annotations

import json
import math
import random
from bisect import bisect_left, bisect_right
from functools import lru_cache
from pathlib import Path


def logsumexp(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


class LinearChain:
    def __init__(self, labels: list[str], weights: dict[str, list[float]] | None = None, moves: list[list[float]] | None = None):
        self.labels = labels
        n = len(labels)
        self.weights = weights or {}
        self.moves = moves or [[0.0] * n for _ in range(n)]

    def emissions(self, features: list[list[str]]) -> list[list[float]]:
        w, n, out = self.weights, len(self.labels), []
        for token in features:
            score = [0.0] * n
            for f in token:
                v = w.get(f)
                if v is not None:
                    for y in range(n):
                        score[y] += v[y]
            out.append(score)
        return out

    def viterbi(self, features: list[list[str]], allowed: list[bool] | None = None) -> list[int]:
        """Best labels; where ``allowed`` is False only label 0 may stand."""
        if not features:
            return []
        if allowed is None:
            return self._best(self.emissions(features))
        # a label that is certain cuts the chain: the path through each run of open tokens depends on that run alone
        path, i, size = [0] * len(features), 0, len(features)
        while i < size:
            if not allowed[i]:
                i += 1
                continue
            j = i
            while j < size and allowed[j]:
                j += 1
            path[i:j] = self._best(self.emissions(features[i:j]), i > 0, j < size)
            i = j
        return path

    def _best(self, e: list[list[float]], after_plain: bool = False, before_plain: bool = False) -> list[int]:
        """Best labels of a run, which label 0 may precede or follow."""
        moves, n = self.moves, len(self.labels)
        best, back = [v + moves[0][y] for y, v in enumerate(e[0])] if after_plain else e[0], []
        for row in e[1:]:
            now, came = [], []
            for y in range(n):
                p = max(range(n), key=lambda x: best[x] + moves[x][y])
                came.append(p)
                now.append(best[p] + moves[p][y] + row[y])
            best = now
            back.append(came)
        if before_plain:
            best = [v + moves[y][0] for y, v in enumerate(best)]
        y = max(range(n), key=best.__getitem__)
        path = [y]
        for came in reversed(back):
            y = came[y]
            path.append(y)
        return path[::-1]

    def train(self, data: list[tuple[list[list[str]], list[int]]], rounds: int = 6, rate: float = 0.3, l2: float = 1e-5, seed: int = 1) -> None:
        n = len(self.labels)
        rng = random.Random(seed)
        seen: dict[str, list[float]] = {}
        seen_moves = [[1e-6] * n for _ in range(n)]
        data = list(data)
        for _ in range(rounds):
            rng.shuffle(data)
            for features, gold in data:
                if not features:
                    continue
                e, m, size = self.emissions(features), self.moves, len(features)
                alpha = [e[0]]
                for i in range(1, size):
                    alpha.append([logsumexp([alpha[-1][x] + m[x][y] for x in range(n)]) + e[i][y] for y in range(n)])
                beta = [[0.0] * n]
                for i in range(size - 2, -1, -1):
                    beta.append([logsumexp([m[x][y] + e[i + 1][y] + beta[-1][y] for y in range(n)]) for x in range(n)])
                beta.reverse()
                z = logsumexp(alpha[-1])
                for i in range(size):
                    g = [(1.0 if gold[i] == y else 0.0) - math.exp(alpha[i][y] + beta[i][y] - z) for y in range(n)]
                    if max(abs(v) for v in g) < 1e-4:
                        continue
                    for f in features[i]:
                        w = self.weights.setdefault(f, [0.0] * n)
                        s = seen.setdefault(f, [1e-6] * n)
                        for y in range(n):
                            d = g[y] - l2 * w[y]
                            s[y] += d * d
                            w[y] += rate * d / math.sqrt(s[y])
                for i in range(1, size):
                    for x in range(n):
                        for y in range(n):
                            p = math.exp(alpha[i - 1][x] + m[x][y] + e[i][y] + beta[i][y] - z)
                            d = (1.0 if gold[i - 1] == x and gold[i] == y else 0.0) - p - l2 * m[x][y]
                            seen_moves[x][y] += d * d
                            m[x][y] += rate * d / math.sqrt(seen_moves[x][y])

    def save(self, path: Path, least: float = 0.02) -> None:
        w = {f: [round(v, 3) for v in ws] for f, ws in sorted(self.weights.items()) if max(map(abs, ws)) >= least}
        path.write_text(json.dumps({"labels": self.labels, "moves": [[round(v, 3) for v in r] for r in self.moves], "weights": w}, indent=0, sort_keys=True))

    @classmethod
    def load(cls, text: str) -> LinearChain:
        d = json.loads(text)
        return cls(d["labels"], d["weights"], d["moves"])


#: Characters between two segments within which the earlier one speaks for the later.
NEAR = 40


@lru_cache(maxsize=65536)
def gap_class(gap: str) -> str:
    """What stands between two segments, as a feature of the plain segment there."""
    s = gap.strip(" \t")
    if not s:
        return "none" if not gap else "space"
    if not s.strip("\r\n"):
        return "blank" if s.count("\n") > 1 else "line"
    kind = "".join(dict.fromkeys("w" if c.isalpha() else "d" if c.isdigit() else "n" if c == "\n" else c if c in ",;:<(/@-|&" else "o" for c in s if not c.isspace()))
    return kind[:4]


class SemiMarkov:
    """Segments ``(start, end, type, features)`` and the plain segments between them.

    A text's segmentation is any set of candidate segments that do not overlap.
    Its score is the sum of theirs and of the plain segments of at most ``NEAR``
    characters between two of them, each scored by what it holds (``gap``) and by the
    types it parts; longer plain segments and those at the ends score 0.
    Candidates are bounded in length by their generator, so the sums run over
    candidates sorted by end, and over the few that end shortly before one begins.
    """

    def __init__(self, weights: dict[str, float] | None = None):
        self.weights = weights or {}

    def score(self, features: list[str]) -> float:
        w = self.weights
        return sum(w.get(f, 0.0) for f in features)

    @staticmethod
    def between(a: tuple, b: tuple, text: str) -> list[str]:
        """Features of the plain segment between two segments."""
        gap = gap_class(text[a[1] : b[0]])
        return [f"gap={gap}", f"{a[2]}>{b[2]}", f"{a[2]}>{b[2]}|{gap}"]

    @staticmethod
    def _before(spans: list[tuple]) -> list[tuple[int, int]]:
        """For each span (sorted by end): how many end more than ``NEAR`` before its start, and how many end before it."""
        ends = [s[1] for s in spans]
        return [(bisect_left(ends, s[0] - NEAR), bisect_right(ends, s[0])) for s in spans]

    def decode(self, spans: list[tuple], text: str) -> list[tuple]:
        if not spans:
            return []
        spans = sorted(spans, key=lambda s: (s[1], s[0], s[2]))
        best: list[float] = []  # of a segmentation that ends with this span
        upto = [(0.0, -1)]  # best of the first k spans, and which it ends with
        came = []
        for k, (s, (far, near)) in enumerate(zip(spans, self._before(spans))):
            v, p = upto[far]
            for j in range(far, near):
                x = best[j] + self.score(self.between(spans[j], s, text))
                if x > v:
                    v, p = x, j
            v += self.score(s[3])
            best.append(v)
            came.append(p)
            upto.append((v, k) if v > upto[-1][0] else upto[-1])
        out, k = [], upto[-1][1]
        while k >= 0:
            out.append(spans[k])
            k = came[k]
        return out[::-1]

    def train(self, data: list[tuple[list[tuple], set[tuple[int, int, str]], str]], rounds: int = 6, rate: float = 0.3, l2: float = 1e-5, seed: int = 1) -> None:
        """``data``: candidate spans of a text, the true ones, and the text."""
        rng = random.Random(seed)
        seen: dict[str, float] = {}
        data = [(sorted(spans, key=lambda s: (s[1], s[0], s[2])), gold, text) for spans, gold, text in data if spans]
        for _ in range(rounds):
            rng.shuffle(data)
            for spans, gold, text in data:
                n, before = len(spans), self._before(spans)
                own = [self.score(s[3]) for s in spans]
                pairs = {(j, k): self.between(spans[j], spans[k], text) for k in range(n) for j in range(*before[k])}
                move = {jk: self.score(f) for jk, f in pairs.items()}
                alpha, upto = [], [0.0]
                for k in range(n):
                    far, near = before[k]
                    alpha.append(own[k] + logsumexp([upto[far], *(alpha[j] + move[j, k] for j in range(far, near))]))
                    upto.append(logsumexp([upto[-1], alpha[k]]))
                z = upto[-1]
                beta = [0.0] * n  # of all that may follow this span
                for j in range(n - 1, -1, -1):
                    after = [k for k in range(j + 1, n) if spans[k][0] >= spans[j][1]]
                    beta[j] = logsumexp([0.0, *(own[k] + beta[k] + move.get((j, k), 0.0) for k in after)])
                real = [(s[0], s[1], s[2]) in gold for s in spans]
                true = sorted((k for k in range(n) if real[k]), key=lambda k: spans[k][0])
                follows = set(zip(true, true[1:]))
                changes = [(s[3], real[k] - math.exp(min(0.0, alpha[k] + beta[k] - z))) for k, s in enumerate(spans)]
                changes += [(f, ((j, k) in follows) - math.exp(min(0.0, alpha[j] + move[j, k] + own[k] + beta[k] - z))) for (j, k), f in pairs.items()]
                for features, g in changes:
                    if abs(g) < 1e-4:
                        continue
                    for f in features:
                        w = self.weights.get(f, 0.0)
                        d = g - l2 * w
                        seen[f] = seen.get(f, 1e-6) + d * d
                        self.weights[f] = w + rate * d / math.sqrt(seen[f])

    def save(self, path: Path, least: float = 0.02) -> None:
        path.write_text(json.dumps({f: round(v, 3) for f, v in sorted(self.weights.items()) if abs(v) >= least}, indent=0))

    @classmethod
    def load(cls, text: str) -> SemiMarkov:
        return cls(json.loads(text))
