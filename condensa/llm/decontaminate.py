"""Benchmark passages in documents by latent semantic retrieval.

Terms are the words of the benchmark (others add nothing to a product with one of its items). A
document is cut into passages of ``2 * half`` words, each overlapping the next by half.

1. Document frequencies of the terms over all disjoint passages, exact; terms in more than
   ``max_share`` of them are left out.
2. Randomised SVD of the TF-IDF matrix A in one pass: tasks sum their rows' part of
   Y = A'A O for a random O, and Y(O'Y)^-1 Y' stands for A'A (Nystroem). The benchmark's own rows
   are weighed to hold as much as the corpus, so the leading directions span them.
3. Passages and items are compared by cosine in that space. A passage near an item is verified
   with the words around it: the longest common subsequence must hold ``verbatim`` of the item's
   words, or ``paraphrase`` of them and all of its answer. The answer is what follows the last
   "answer:" of the item or, without one, its five rarest terms.
4. Beside the cosine, every run of three words that a document shares with an item (the whole
   item, if it is shorter) leads to the same check, at the place where the two would lie upon each
   other. An item of ``short`` words or more of which ``verbatim`` is left in place has such a
   run between its changes, so copies with words replaced or left out don't depend on the rank.

Scale: three passes of map-side work; shuffled are a count a term and task and, of a sketch a task, the rows of terms it met.
What reaches the driver and is broadcast has (terms) x (rank) numbers, and terms are hashed to at
most 2**16. The benchmark goes in blocks of ``block_items`` items, each with a space of its own:
four items a direction by default, for a fixed rank spans a larger block worse. The passes grow
with the blocks.

Defined cases: null and empty texts hold nothing; items without words match nothing; items of
under ``short`` words must be there whole. Rows with a null doc_id or item_id are left out. Rows
that repeat an id are searched each and reported once. Either table may be empty. Other columns
are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLOCKS, cut, many_word_hashes, map_arrow, shingle_hashes, summed_blocks, table, touched_blocks, word_hashes

_TERM_BITS = 16
_SLOT_BITS = 20
_FOUND = "doc_id long, item_id long, lcs double, cosine double, first_word long"
_ANSWER = re.compile(r"(?is).*\banswer\s*:(.*)$")


def common_subsequence(item: np.ndarray, region: np.ndarray) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    where: dict[int, int] = {}
    for j, w in enumerate(item.tolist()):
        where[w] = where.get(w, 0) | 1 << j
    mask = (1 << len(item)) - 1
    row = mask
    for w in region.tolist():
        if met := row & where.get(w, 0):
            row = (row + met | row - met) & mask
    return len(item) - row.bit_count()


class Terms:
    """The benchmark's words as columns of the matrix."""

    def __init__(self, words: np.ndarray):
        self.words = np.unique(words)
        # Columns are hashed only where there are more words than columns.
        many = len(self.words) > 1 << _TERM_BITS
        self.column = (self.words >> np.uint64(64 - _TERM_BITS)).astype(np.int64) if many else np.arange(len(self.words))
        self.n = 1 << _TERM_BITS if many else len(self.words)
        self.column = self.column.astype(np.int32)
        self._slots()

    def _slots(self) -> None:
        at = (self.words >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        self.slot = np.full(1 << _SLOT_BITS, -1, dtype=np.int32)
        self.slot[at] = np.arange(len(at), dtype=np.int32)
        slots, counts = np.unique(at, return_counts=True)
        self.slot[slots[counts > 1]] = -2

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "slot"}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._slots()

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of terms in ``words`` and their columns."""
        got = self.slot[(words >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)]
        if not len(self.words):
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        if (shared := np.flatnonzero(got == -2)).size:
            got[shared] = np.minimum(np.searchsorted(self.words, words[shared]), len(self.words) - 1)
        near = np.flatnonzero(got >= 0)
        near = near[self.words[got[near]] == words[near]]
        return near, self.column[got[near]]


class Runs:
    """Runs of ``length`` words of the items (whole items, where those are shorter) and where they are."""

    def __init__(self, items: list[np.ndarray], length: int = 3):
        self.tables: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        for k in sorted({min(length, len(w)) for w in items}):
            own = [(i, shingle_hashes(w, k)) for i, w in enumerate(items) if min(length, len(w)) == k]
            runs = np.concatenate([x for _, x in own])
            item = np.repeat([i for i, _ in own], [len(x) for _, x in own])
            place = np.concatenate([np.arange(len(x)) for _, x in own])
            order = np.argsort(runs, kind="stable")
            self.tables.append((k, runs[order], item[order], place[order]))
        self._filters()

    def _filters(self) -> None:
        self.may = []
        for _, runs, _, _ in self.tables:
            self.may.append(np.zeros(1 << _SLOT_BITS, dtype=bool))
            self.may[-1][(runs >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)] = True

    def __getstate__(self):
        return {"tables": self.tables}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._filters()

    def find(self, words: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Texts, items, and the places in the texts where the items would begin (below 0: before them), for each shared run."""
        for (k, runs, item, place), may in zip(self.tables, self.may):
            if len(words) < k:
                continue
            own = shingle_hashes(words, k)
            near = np.flatnonzero(may[(own >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)])
            low, high = np.searchsorted(runs, own[near]), np.searchsorted(runs, own[near], side="right")
            text = np.searchsorted(at, near, side="right") - 1
            keep = (high > low) & (near + k <= at[text + 1])
            near, low, count, text = near[keep], low[keep], (high - low)[keep], text[keep]
            entry = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
            yield np.repeat(text, count), item[entry], np.repeat(near - at[text], count) - place[entry]


def _laid_out(words: np.ndarray, at: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words, the number of each word's passage, and each text's first passage and the end."""
    lengths = np.diff(at)
    first = np.concatenate([[0], np.cumsum(-(-lengths // step))])
    place = np.arange(len(words)) - np.repeat(at[:-1], lengths)
    return words, np.repeat(first[:-1], lengths) + place // step, first


def _groups(batch: pa.RecordBatch, column: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    return many_word_hashes((t.as_py() for t in batch.column(column)), 1 << 17)


def _document_frequencies(docs: DataFrame, terms: Terms, step: int) -> tuple[np.ndarray, int]:
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        total, passages = np.zeros(own.n, np.int64), 0
        for batch in batches:
            for words, at in _groups(batch, 0):
                words, passage, first = _laid_out(words, at, step)
                near, column = own.find(words)
                pairs = np.unique(passage[near] * own.n + column)
                total += np.bincount(pairs % own.n, minlength=own.n)
                passages += int(first[-1])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *at], pa.int64()), pa.array([passages, *total[at]], pa.int64())], names=["i", "c"])

    df, n = np.zeros(terms.n, np.int64), 0
    for r in map_arrow(docs.select("text"), run, "i long, c long").groupBy("i").agg(F.sum("c").alias("c")).collect():
        if r.i < 0:
            n = r.c
        else:
            df[r.i] = r.c
    return df, n


def _rows(words: np.ndarray, at: np.ndarray, terms: Terms, weight: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Passages with any term (ascending, repeated), columns and weights of the entries."""
    words, passage, _ = _laid_out(words, at, step)
    near, column = terms.find(words)
    w = weight[column]
    keep = w > 0
    return passage[near][keep], column[keep], w[keep]


def _times(passage: np.ndarray, w: np.ndarray, gathered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct passages and the sums of their entries' weighted rows."""
    starts = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]]) if len(passage) else np.zeros(0, np.int64)
    if not len(starts):
        return passage, np.zeros((0, gathered.shape[1]), np.float32)
    return passage[starts], np.add.reduceat(gathered * w[:, None], starts, axis=0)


def _add_sketch(y: np.ndarray, passage: np.ndarray, column: np.ndarray, w: np.ndarray, omega: np.ndarray) -> float:
    """Adds A'A O of these entries to ``y``; returns the sum of their squares."""
    energy = 0.0
    ends = np.flatnonzero(np.r_[passage[1:] != passage[:-1], True]) + 1 if len(passage) else []
    at = 0
    while at < len(passage):
        end = int(ends[min(np.searchsorted(ends, at + 16384), len(ends) - 1)])
        p, c, v = passage[at:end], column[at:end], w[at:end]
        _, product = _times(p, v, omega[c])
        row = np.cumsum(np.r_[False, p[1:] != p[:-1]])
        order = np.argsort(c, kind="stable")
        sorted_c = c[order]
        starts = np.flatnonzero(np.r_[True, sorted_c[1:] != sorted_c[:-1]])
        y[sorted_c[starts]] += np.add.reduceat(product[row[order]] * v[order, None], starts, axis=0)
        energy += float((v * v).sum())
        at = end
    return energy


def _omega(n: int, width: int) -> np.ndarray:
    return np.random.default_rng(20_011).standard_normal((n, width)).astype(np.float32)


def _sketch(docs: DataFrame, terms: Terms, weight: np.ndarray, step: int, width: int, part: int = 1024) -> tuple[np.ndarray, float]:
    """Y = A'A O over all documents and the sum of squares of A; sums run task by task, in blocks of rows of Y."""
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast((terms, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, own_weight = shared.value
        omega, y, energy = _omega(own.n, width), np.zeros((own.n, width), np.float32), 0.0
        for batch in batches:
            for words, at in _groups(batch, 0):
                energy += _add_sketch(y, *_rows(words, at, own, own_weight, step), omega)
        yield touched_blocks(y, part, energy)

    y, energy = np.zeros((terms.n, width)), 0.0
    for at, value in summed_blocks(map_arrow(docs.select("text"), run, BLOCKS), width, part):
        if at is None:
            energy += value
        else:
            y[at] += value
    return y, energy


def latent_basis(y: np.ndarray, omega: np.ndarray, rank: int) -> np.ndarray:
    """Leading eigenvectors of A'A from Y = A'A O."""
    core = omega.T.astype(np.float64) @ y
    core = (core + core.T) / 2
    values, vectors = np.linalg.eigh(core)
    keep = values > max(values.max(initial=0.0), 1e-300) * 1e-10
    u, _, _ = np.linalg.svd(y @ (vectors[:, keep] / np.sqrt(values[keep])), full_matrices=False)
    return np.ascontiguousarray(u[:, :rank], dtype=np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-20)


def find_passages(docs: DataFrame, benchmark: DataFrame, half: int = 32, rank: int = 192, max_share: float = 0.05, cosine: float = 0.4, verbatim: float = 0.8, paraphrase: float = 0.6, short: int = 8, block_items: int = 768) -> DataFrame:
    """(doc_id, item_id, lcs, cosine, first_word): a row for each item that a document holds."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id IS NOT NULL")
    benchmark = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id IS NOT NULL AND text IS NOT NULL")
    found: DataFrame | None = None
    items: list[tuple[int, str]] = []
    for r in benchmark.toLocalIterator():
        items.append((r.item_id, r.text))
        if len(items) == block_items:
            part = _find_block(docs, items, half, rank, max_share, cosine, verbatim, paraphrase, short)
            found, items = part if found is None else found.union(part), []
    if items or found is None:
        part = _find_block(docs, items, half, rank, max_share, cosine, verbatim, paraphrase, short)
        found = part if found is None else found.union(part)
    best = F.max(F.struct("lcs", "cosine", (-F.col("first_word")).alias("f"))).alias("x")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "x.lcs", "x.cosine", (-F.col("x.f")).alias("first_word"))


def _find_block(docs: DataFrame, items: list[tuple[int, str]], half: int, rank: int, max_share: float, cosine: float, verbatim: float, paraphrase: float, short: int) -> DataFrame:
    spark, width = docs.sparkSession, rank + 32
    hashed = [(i, w, t) for i, t in items if len(w := word_hashes(t))]
    if not hashed:
        return spark.createDataFrame([], _FOUND)
    terms = Terms(np.concatenate([w for _, w, _ in hashed]))
    df, n = _document_frequencies(docs, terms, 2 * half)
    weight = np.log1p(max(n, 1) / np.maximum(df, 1)).astype(np.float32)
    weight[df > max(max_share * n, 1)] = 0
    # An item of common terms only is compared by those.
    lost = [i for i, (_, w, _) in enumerate(hashed) if not weight[terms.find(w)[1]].any()]
    for i in lost:
        c = terms.find(hashed[i][1])[1]
        weight[c] = np.log1p(max(n, 1) / np.maximum(df[c], 1))
    y, energy = _sketch(docs, terms, weight, 2 * half, width)
    omega = _omega(terms.n, width)
    # The benchmark's passages, weighed to the corpus's sum of squares.
    long_step = 2 * half
    pieces, owner = [], []
    for i, (_, w, _) in enumerate(hashed):
        for at in range(0, len(w), long_step):
            if at == 0 or len(w) - at >= half:
                pieces.append(w[at : at + long_step])
                owner.append(i)
    passage, column, w = _rows(np.concatenate(pieces), np.cumsum([0] + [len(x) for x in pieces]), terms, weight, long_step)
    own = np.zeros((terms.n, width), np.float32)
    own_energy = _add_sketch(own, passage, column, w, omega)
    y += own * (max(energy, own_energy) / max(own_energy, 1e-12))
    basis = latent_basis(y, omega, rank)
    rows, vectors = _times(passage, w, basis[column])
    vectors, owner = _unit(vectors), np.array(owner)[rows]
    answers = []
    for _, w, text in hashed:
        if (m := _ANSWER.match(text)) and len(a := word_hashes(m[1])):
            answers.append(np.unique(a))
        else:
            near, c = terms.find(w)
            answers.append(np.unique(w[near][np.argsort(-weight[c], kind="stable")[:5]]))
    shared = spark.sparkContext.broadcast((terms, weight, basis, vectors, owner, [(i, w) for i, w, _ in hashed], answers, Runs([w for _, w, _ in hashed])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, weight, basis, vectors, owner, items, answers, runs = shared.value

        def verified(item: int, region: np.ndarray) -> float | None:
            words = items[item][1]
            share = common_subsequence(words, region) / len(words)
            if share >= (1.0 if len(words) < short else verbatim) or len(words) >= short and share >= paraphrase and np.isin(answers[item], region).all():
                return share
            return None

        for batch in batches:
            ids, out, doc_at = batch.column(0).to_pylist(), [], 0
            for words, at in _groups(batch, 1):
                _, block, first = _laid_out(words, at, half)
                near, column = terms.find(words)
                w = weight[column]
                keep = w > 0
                block, column, w = block[near][keep], column[keep], w[keep]
                sums = np.zeros((int(first[-1]) + 1, basis.shape[1]), np.float32)
                for i in range(0, len(block), 32768):
                    b, s = _times(block[i : i + 32768], w[i : i + 32768], basis[column[i : i + 32768]])
                    sums[b] += s
                # A passage is two blocks of one text; weights are sums, so its vector is too.
                last = np.zeros(len(sums), dtype=bool)
                last[np.maximum(first[1:] - 1, 0)] = True
                sums[:-1][~last[:-1]] += sums[1:][~last[:-1]]
                norms = np.linalg.norm(sums, axis=1)
                rows = np.flatnonzero(norms > 1e-6)
                met: dict[tuple[int, int], list[tuple[float, int]]] = {}
                for i in range(0, len(rows), 4096):
                    part = rows[i : i + 4096]
                    near_by = (sums[part] / norms[part, None]) @ vectors.T
                    for r, j in zip(*np.nonzero(near_by >= cosine)):
                        passage = int(part[r])
                        doc = int(np.searchsorted(first, passage, side="right")) - 1
                        met.setdefault((doc, int(owner[j])), []).append((float(near_by[r, j]), passage - int(first[doc])))
                done: set[tuple[int, int]] = set()
                for (doc, item), hits in met.items():
                    text, size = words[at[doc] : at[doc + 1]], max(2 * half, len(items[item][1]))
                    for cos, passage in sorted(hits, reverse=True):
                        begin = max(0, passage * half - size)
                        share = verified(item, text[begin : passage * half + 2 * half + size])
                        if share is not None:
                            out.append((ids[doc_at + doc], items[item][0], share, cos, passage * half))
                            done.add((doc, item))
                            break
                shared_runs: dict[tuple[int, int], Counter[int]] = {}
                for found_runs in runs.find(words, at):
                    for doc, item, begin in zip(*(x.tolist() for x in found_runs)):
                        if (doc, item) not in done:
                            shared_runs.setdefault((doc, item), Counter())[begin // half] += 1
                for (doc, item), places in shared_runs.items():
                    text, length = words[at[doc] : at[doc + 1]], len(items[item][1])
                    around = max(half, length // 2)
                    for place, _ in places.most_common():
                        share = verified(item, text[max(0, place * half - around) : (place + 1) * half + length + around])
                        if share is not None:
                            passage = int(first[doc]) + max(0, place)
                            cos = float((sums[passage] @ vectors[owner == item].T).max(initial=0.0) / max(norms[passage], 1e-20))
                            out.append((ids[doc_at + doc], items[item][0], share, cos, max(0, place) * half))
                            break
                doc_at += len(at) - 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()))], names=["doc_id", "item_id", "lcs", "cosine", "first_word"])

    return cut(map_arrow(docs.select("doc_id", "text"), run, _FOUND))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
