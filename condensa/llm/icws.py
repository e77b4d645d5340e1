"""Improved consistent weighted sampling over TF-IDF shingles.

A text is the multiset of its runs of five words. A shingle weighs its count times its inverse
document frequency, 1 + ln(1 + min(N / df, 1 / idf_share)), where N counts all documents. A group
of near copies would make what its members share common by their number alone, and their few
differences heavy; so df counts texts, not copies: documents with the shingle that have the same
least hash of all their shingles (which near copies of similarity s have with probability s, and
texts that merely share a passage hardly ever) count once.

Weights are exact for every shingle. The table holds those in at least ``idf_share`` of the
documents, which are at most 1 / idf_share times the mean number of shingles a document, whatever
N is; the df of any other shingle is below that share too, so its weight is the one bound.

For weight S of shingle x and sample k, with r and c from Gamma(2, 1) and b uniform, all fixed by
(x, k): t = floor(ln S / r + b) and ln a = ln c - r (t - b) - r. The sample is the shingle with
the least a; two texts get the same one with probability equal to their weighted Jaccard
similarity. The least ln a itself names shingle and t, so it is the sample.
"""

from __future__ import annotations

import math

import numpy as np

from .common import mix64, shingle_hashes, word_hashes

SHINGLE = 5
_BITS = 16


def _gamma2() -> np.ndarray:
    """Quantiles of Gamma(2, 1) at the middles of 2**16 equal parts, by bisection of 1 - (1 + x) e**-x."""
    u = (np.arange(1 << _BITS) + 0.5) / (1 << _BITS)
    low, high = np.zeros_like(u), np.full_like(u, 40.0)
    for _ in range(60):
        middle = (low + high) / 2
        below = 1 - (1 + middle) * np.exp(-middle) < u
        low, high = np.where(below, middle, low), np.where(below, high, middle)
    return (low + high) / 2


_GAMMA = _gamma2()
_LN_GAMMA = np.log(_GAMMA)


class Idf:
    """Weights of shingles: those of a sorted table, and one for all others."""

    def __init__(self, shingles: np.ndarray, df: np.ndarray, n: int, idf_share: float):
        order = np.argsort(shingles, kind="stable")
        self.shingles = shingles[order].astype(np.uint64)
        self.rare = 1 + math.log1p(1 / idf_share)
        self.weight = 1 + np.log1p(np.minimum(n / np.maximum(df[order], 1), 1 / idf_share))
        self._filter()

    def _filter(self) -> None:
        self.may = np.zeros(1 << 20, dtype=bool)
        self.may[(self.shingles >> np.uint64(44)).astype(np.int64)] = True

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "may"}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._filter()

    def find(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``shingles`` of those in the table, and their places there."""
        near = np.flatnonzero(self.may[(shingles >> np.uint64(44)).astype(np.int64)])
        if not len(near):
            return near, near
        at = np.searchsorted(self.shingles, shingles[near])
        at[at == len(self.shingles)] = 0
        hit = self.shingles[at] == shingles[near]
        return near[hit], at[hit]

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        out = np.full(len(shingles), self.rare)
        places, at = self.find(shingles)
        out[places] = self.weight[at]
        return out


def counted(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a whole text, ascending, and their counts."""
    return np.unique(shingle_hashes(word_hashes(text or ""), SHINGLE), return_counts=True)


def origin(shingles: np.ndarray) -> int:
    """The least hash of a text's shingles; 0 without shingles. Near copies mostly have the same."""
    return int(mix64(shingles ^ np.uint64(0x2545F4914F6CDD1D)).min()) if len(shingles) else 0


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two sorted arrays of shingles with their weights."""
    (x, v), (y, w) = a, b
    if not len(x) or not len(y):
        return 0.0
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    both = y[at] == x
    least = np.minimum(v[both], w[at[both]]).sum()
    return float(least / (v.sum() + w.sum() - least))


def samples(shingles: np.ndarray, weights: np.ndarray, starts: np.ndarray, n_samples: int, seed: int = 1) -> np.ndarray:
    """(n_samples, texts) samples as uint64; ``starts`` are where each text (none empty) begins."""
    out = np.empty((n_samples, len(starts)), dtype=np.uint64)
    seeds = mix64(np.arange(1, n_samples + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019) + np.uint64(seed))
    ln_s = np.log(weights)
    low, part = np.uint64((1 << _BITS) - 1), np.uint64(_BITS)
    scale = 1.0 / (1 << 32)
    for k in range(n_samples):
        x = mix64(shingles ^ seeds[k])
        r = _GAMMA[(x & low).astype(np.int64)]
        ln_c = _LN_GAMMA[(x >> part & low).astype(np.int64)]
        b = (x >> np.uint64(32)).astype(np.float64) * scale
        t = np.floor(ln_s / r + b)
        t -= b
        t += 1.0
        t *= r
        ln_c -= t
        # The sum with 0.0 makes one zero of two; equal samples are equal bits.
        out[k] = (np.minimum.reduceat(ln_c, starts) + 0.0).view(np.uint64)
    return out
