import math
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from condensa.llm.components import components
from condensa.llm.icws import counted, origin, samples, weighted_jaccard
from condensa.llm.near_dedup import near_duplicates, shingle_idf


def brute(rows, similarity=0.8, idf_share=0.002):
    """All pairs, with weights from plain dictionaries over shingles of words as strings."""
    rows = [(d, t) for d, t in rows if d is not None]
    n = len(rows)

    def shingles(text):
        w = re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (text or "").lower())
        return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()

    sets = [shingles(t) for _, t in rows]
    holders = {}
    for (_, t), own in zip(rows, sets):
        # The hash that says which texts count as one is the operator's; all else is not.
        text = origin(counted(t)[0])
        for x in own:
            holders.setdefault(x, set()).add(text)
    idf = {x: 1 + math.log(1 + min(n / len(h), 1 / idf_share)) for x, h in holders.items()}
    weights = [{x: c * idf[x] for x, c in own.items()} for own in sets]
    total = [sum(w.values()) for w in weights]
    parent = {d: d for d, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def similar(i, j):
        a, b = sorted((weights[i], weights[j]), key=len)
        if not a or min(total[i], total[j]) < similarity * max(total[i], total[j]):
            return False
        both = sum(min(w, b[x]) for x, w in a.items() if x in b)
        return both / (total[i] + total[j] - both) >= similarity

    for i, (a, s) in enumerate(rows):
        for j, (b, t) in enumerate(rows[:i]):
            if s is not None and t is not None and (s == t or similar(i, j)):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return sorted((d, root(d)) for d, _ in rows)


def corpus(seed, n=60):
    rng = random.Random(seed)
    words = [f"w{i}é" for i in range(400)]
    rows = []
    for f in range(n):
        base = [rng.choice(words) for _ in range(rng.randint(1, 120))]
        for _ in range(rng.choice([1, 1, 2, 9])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 9])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append(" ".join(copy))
        if f % 5 == 0:
            rows.append("shared line of many words in every fifth family " * 2 + " ".join(base[:40]))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("block_rows", [3, 512])
def test_equals_brute_force(spark, block_rows):
    rows = corpus(block_rows) + [(1000, None), (1001, None), (1002, ""), (1003, ""), (1004, "!"), (1005, "Ab"), (1006, "ab."), (1007, " ".join(f"x{i}" for i in range(30_000))), (1008, " ".join(f"x{i}" for i in range(29_000))), (None, "ab"), (1004, "!")]
    df = spark.createDataFrame([(d, t, "s", 1) for d, t in rows], "doc_id long, text string, label string, first int")
    got = sorted(tuple(r) for r in near_duplicates(df, block_rows=block_rows).collect())
    assert got == brute(rows)


def test_large_group_of_near_copies(spark):
    rng = random.Random(5)
    base = [f"b{i}" for i in range(100)]
    rows = []
    for i in range(700):
        copy = list(base)
        copy[rng.randrange(100)] = f"own{i}"
        rows.append((i, " ".join(copy)))
    rows += [(1000 + i, " ".join(f"z{rng.random()}" for _ in range(30))) for i in range(1400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_duplicates(df, block_rows=64).collect()}
    assert {got[i] for i in range(700)} == {0}
    assert all(got[d] == d for d in got if d >= 1000)


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_idf_counts_texts_of_all_documents(spark):
    own = lambda i: " ".join(f"own{i}x{j}" for j in range(40))
    rows = [(i, own(i) + (" one two three four five" if i % 3 else "")) for i in range(90)] + [(100 + i, own(0) + " x") for i in range(30)]
    idf = shingle_idf(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), 0.05)
    weights = dict(zip(idf.shingles.tolist(), idf.weight.tolist()))
    passage = counted("one two three four five")[0].tolist()[0]
    assert np.isclose(weights[passage], 1 + np.log(1 + 120 / 60))
    # Thirty copies and their original are one text: what they share weighs as much as what only one document has.
    assert all(np.isclose(weights.get(x, idf.rare), 1 + np.log(21)) for x in counted(own(0))[0].tolist())


def test_driver_holds_the_table_of_frequencies_as_columns(spark):
    docs = spark.createDataFrame([(i, " ".join(f"d{i}w{j}" for j in range(4000)) + " one two three four five") for i in range(30)], "doc_id long, text string")
    tracemalloc.start()
    idf = shingle_idf(docs, 0.05)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 * 30 * 4000
    # Only what is in a share of 0.05 of the documents, for all else weighs the same.
    assert idf.shingles.tolist() == counted("one two three four five")[0].tolist()


def test_a_common_passage_links_no_different_texts(spark):
    rng = random.Random(2)
    passage = " ".join(f"licence{i}" for i in range(90))
    rows = [(i, passage + " " + " ".join(f"w{rng.random()}" for _ in range(14))) for i in range(40)]
    rows += [(1000 + i, " ".join(f"z{rng.random()}" for _ in range(60))) for i in range(360)]
    got = {r.doc_id: r.class_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[d] == d for d in got)


def test_samples_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    x = np.sort(rng.integers(0, 2**63, 400).astype(np.uint64))
    v, w = rng.uniform(1, 7, 400), rng.uniform(1, 7, 400)
    got = samples(np.concatenate([x, x]), np.concatenate([v, w]), np.array([0, 400]), 4000)
    assert abs((got[:, 0] == got[:, 1]).mean() - weighted_jaccard((x, v), (x, w))) < 0.03


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (300, 200)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)} | {200: 200, 300: 200}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
