"""Ranking of one small corpus in memory: what grouped functions run on each group of a table.

A corpus here is a list of sentences or passages of one document or conversation. Large corpora
take the relational forms in ``operators.index`` and ``operators.graph``.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np

K1, B = 1.5, 0.75
DAMPING, ROUNDS, EPSILON, COVERAGE, FRAGMENT = 0.85, 50, 1e-6, 0.5, 10
_WORD = re.compile(r"\w+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def rational(x: float) -> float:
    x = max(-8.0, min(8.0, x))
    return (x**3 + 6 * x + 12) / (x**3 + 12 * x + 48)


def sentences(text: str, least: int = FRAGMENT) -> list[str]:
    """Lines, split behind sentence ends; a fragment under ``least`` characters takes the next to itself."""
    raw = [p.strip() for line in text.split("\n") if line.strip() for p in re.split(r"(?<=[.!?])\s+(?=[A-Z\"])", line.strip()) if p.strip()]
    out: list[str] = []
    for part in raw:
        if out and len(out[-1]) < least:
            out[-1] += " " + part
        else:
            out.append(part)
    return out


@dataclass
class Corpus:
    """Term statistics of a list of texts."""

    texts: list[str]
    tf: list[Counter] = field(init=False)
    weight: dict[str, float] = field(init=False)

    def __post_init__(self) -> None:
        self.tf = [Counter(words(t)) for t in self.texts]
        self.length = np.array([sum(c.values()) for c in self.tf], float)
        self.average = float(self.length.mean()) if len(self.length) else 0.0
        self.postings: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for i, counts in enumerate(self.tf):
            for t, c in counts.items():
                self.postings[t].append((i, c))
        n = len(self.texts)
        self.idf = {t: math.log((n - len(p) + 0.5) / (len(p) + 0.5) + 1) for t, p in self.postings.items()}
        top = max(self.idf.values(), default=1.0) or 1.0
        self.gamma = {t: v / top for t, v in self.idf.items()}
        self.info = {t: self._info([c for _, c in p], n) for t, p in self.postings.items()}
        self.weight = {t: v * (1 + self.gamma[t] * self.info[t]) for t, v in self.idf.items()}

    @staticmethod
    def _info(counts: list[int], n: int) -> float:
        df = len(counts)
        if df < 2:
            return 1.0
        plain, spread = 1 - df / n, float(np.var(counts))
        alpha = spread / (spread + 1)
        if alpha < 0.001:
            return plain
        m = np.array([rational(c) for c in counts])
        p = m / m.sum()
        even = max(1 - min(float(-(p * np.log(p)).sum()) / math.log(df), 1.0), 0.0)
        return alpha * even + (1 - alpha) * plain

    def saturation(self, i: int, tf: int) -> float:
        if self.average <= 0:
            return float(tf)
        return tf * (K1 + 1) / (tf + K1 * (1 - B + B * self.length[i] / self.average))

    def vector(self, i: int) -> dict[str, float]:
        return {t: self.weight[t] * self.saturation(i, c) for t, c in self.tf[i].items() if self.weight[t] > 0}

    def search(self, query: str) -> dict[int, float]:
        asked = Counter(words(query))
        base, cover, known = defaultdict(float), defaultdict(float), defaultdict(float)
        for t, q in asked.items():
            for i, c in self.postings.get(t, ()):
                part = self.weight[t] * self.saturation(i, c) * q
                base[i] += part
                cover[i] += math.tanh(part)
                known[i] += self.gamma[t] * self.info[t] * q
        return {i: base[i] + cover[i] / len(asked) * known[i] for i in base}

    def query_scores(self, query: str) -> np.ndarray:
        out = np.zeros(len(self.texts))
        for t, q in Counter(words(query)).items():
            for i, c in self.postings.get(t, ()):
                out[i] += self.weight[t] * self.saturation(i, c) * q
        return out

    def similarity(self) -> np.ndarray:
        """Symmetric matrix of kept edges: cosines over all terms' norms, sums over terms neither faint nor common."""
        n = len(self.texts)
        top = max(self.weight.values(), default=0.0)
        faint, most = (0.05, n // 10) if n > 5000 else (0.02, n // 5) if n > 1000 else (0.005, max(n // 2, 10))
        vectors = [self.vector(i) for i in range(n)]
        norms = np.array([math.sqrt(sum(v * v for v in x.values())) or 1.0 for x in vectors])
        kept = {t: k for k, t in enumerate(t for t, p in self.postings.items() if 2 <= len(p) <= most and self.weight[t] >= faint * top)}
        m = np.zeros((n, len(kept)))
        for i, x in enumerate(vectors):
            for t, v in x.items():
                if t in kept:
                    m[i, kept[t]] = v
        sim = (m @ m.T) / np.outer(norms, norms)
        np.fill_diagonal(sim, 0)
        sim[sim < 0.01 * sim.max(initial=0.0)] = 0
        return np.maximum(sim, 0)


def position_prior(degree: np.ndarray) -> np.ndarray:
    n = len(degree)
    if n <= 1:
        return np.ones(n)
    lead = max(3, n // 10)
    mean = degree.mean()
    strength = min(1.0, max(0.0, (degree[:lead].sum() / lead / mean - 1) * 2.5)) if mean > 0 else 0.0
    i = np.arange(n)
    return 1 + strength * np.exp(-i / max(0.1 * n, 1)) + 0.3 * np.exp(-(n - 1 - i) / max(0.05 * n, 1))


def page_rank(sim: np.ndarray, prior: np.ndarray, rounds: int = ROUNDS, epsilon: float | None = EPSILON) -> np.ndarray:
    p = prior / prior.sum()
    degree = sim.sum(axis=1)
    step = np.divide(sim, degree[:, None], out=np.zeros_like(sim), where=degree[:, None] > 0)
    rank = p.copy()
    for _ in range(rounds):
        new = (1 - DAMPING) * p + DAMPING * (rank[degree == 0].sum() * p + rank @ step)
        moved = np.abs(new - rank).sum()
        rank = new
        if epsilon is not None and moved < epsilon:
            break
    return rank


def covering(corpus: Corpus, scores: np.ndarray, top_k: int) -> list[int]:
    """Places in order of choice: the score times how much of the text's weight is not yet covered; ties to the first."""
    weights = [{t: w for t in c if (w := corpus.weight[t]) > 0} for c in corpus.tf]
    totals = [sum(w.values()) for w in weights]
    covered: set[str] = set()
    left, chosen = list(range(len(weights))), []
    while left and len(chosen) < top_k:
        gains = [scores[i] * (COVERAGE + (1 - COVERAGE) * (sum(w for t, w in weights[i].items() if t not in covered) / totals[i] if totals[i] else 0.0)) for i in left]
        best = left.pop(int(np.argmax(gains)))
        chosen.append(best)
        covered |= weights[best].keys()
    return chosen


@dataclass
class Ranking:
    scores: np.ndarray
    selected: list[int]
    keywords: list[tuple[str, float]]

    def top(self, k: int) -> list[tuple[int, float]]:
        """The ``k`` best places with their scores, ties to the first."""
        return [(int(i), float(self.scores[i])) for i in np.argsort(-self.scores, kind="stable")[:k]]


def rank(texts: list[str], top_k: int = 5, query: str | None = None) -> Ranking:
    """Centrality of each text (the largest is 1), a covering choice of ``top_k`` and keywords."""
    n = len(texts)
    if n == 0:
        return Ranking(np.zeros(0), [], [])
    corpus = Corpus(texts)
    terms = sorted(((w * math.sqrt(len(corpus.postings[t])), t) for t, w in corpus.weight.items() if w > 0), key=lambda x: (-x[0], x[1]))
    keys = [(t, w) for w, t in terms[:10]]
    if n == 1:
        return Ranking(np.ones(1), [0], keys)
    sim = corpus.similarity()
    prior = position_prior(sim.sum(axis=1))
    if query:
        asked = corpus.query_scores(query)
        if (asked > 0).any():
            prior = prior * (asked + 0.01)
    scores = page_rank(sim, prior)
    scores = scores / scores.max() if scores.max() > 0 else scores
    return Ranking(scores, covering(corpus, scores, top_k), keys)


def summarize(text: str, ratio: float = 0.3, query: str | None = None) -> str:
    parts = sentences(text)
    got = rank(parts, max(1, int(len(parts) * ratio)), query)
    return " ".join(parts[i] for i in sorted(got.selected))
