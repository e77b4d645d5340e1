import inspect
import random

import numpy as np
import pytest

from condensa.llm.common import word_hashes
from condensa.llm.decontaminate import Terms, common_subsequence, find_passages, latent_basis


@pytest.mark.parametrize("seed", range(30))
def test_common_subsequence(seed):
    rng = np.random.default_rng(seed)
    a, b = (rng.integers(0, 6, rng.integers(0, 25)).astype(np.uint64) for _ in range(2))
    row = [0] * (len(b) + 1)
    for x in a:
        above = row[:]
        for j, y in enumerate(b):
            row[j + 1] = above[j] + 1 if x == y else max(above[j + 1], row[j])
    assert common_subsequence(a, b) == row[-1]


def test_terms_finds_words():
    words = np.unique(np.random.default_rng(0).integers(0, 2**64, 9000, dtype=np.uint64))
    terms = Terms(words[::2])
    near, column = terms.find(words)
    assert (near == np.arange(0, len(words), 2)).all() and (column == np.arange(len(near))).all()


def test_latent_basis_spans_the_leading_directions():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(300, 5)) @ rng.normal(size=(5, 60)) + 1e-6 * rng.normal(size=(300, 60))
    omega = rng.normal(size=(60, 12))
    basis = latent_basis(a.T @ (a @ omega), omega, 5).astype(float)
    assert np.linalg.norm(a - a @ basis @ basis.T) < 1e-2 * np.linalg.norm(a)


def corpus():
    rng = random.Random(4)
    rare = [f"term{i}" for i in range(3000)]
    common = "the of and to in a is that it for".split()
    say = lambda n: [rng.choice(common) if rng.random() < 0.5 else rng.choice(rare) for _ in range(n)]
    items = [(i, " ".join(say(rng.randint(10, 60)))) for i in range(30)]
    docs, want = [], set()
    for d in range(300):
        words = say(rng.choice([0, 3, 50, 400]))
        if d % 7 == 0:
            i, text = rng.choice(items)
            at = rng.randint(0, len(words))
            words[at:at] = text.upper().replace(" ", ", ").split()
            want.add((d, i))
        elif d % 11 == 0:
            i, text = items[d % 30]
            part = text.split()
            # A paraphrase: a fifth of the words that aren't the answer's are others.
            for j in rng.sample(range(len(part)), len(part) // 8):
                part[j] = "other" + part[j]
            words += part
            want.add((d, i))
        docs.append((d, " ".join(words)))
    return docs, items, want


def test_finds_planted_and_leaves_clean(spark):
    docs, items, want = corpus()
    docs += [(None, items[0][1]), (900, None), (901, ""), (902, "x " * 40_000 + items[3][1]), (7, docs[7][1])]
    d = spark.createDataFrame([(i, t, "", 0.0) for i, t in docs], "doc_id long, text string, item_id string, lcs double")
    b = spark.createDataFrame([*items, (None, "the of and"), (70, None), (71, ""), (72, "zebra quagga")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in find_passages(d, b).collect()}
    assert got.keys() == want | {(902, 3)}
    assert got[902, 3].lcs == 1.0 and got[902, 3].first_word >= 39_900


def test_blocks_of_items_give_the_same(spark):
    docs, items, want = corpus()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in find_passages(d, b, block_items=11).collect()} == want


def test_rank_spans_180_items_that_share_no_word():
    rank = inspect.signature(find_passages).parameters["rank"].default
    a = np.kron(np.eye(180), np.ones((1, 4)) / 2)
    omega = np.random.default_rng(3).normal(size=(720, rank + 32))
    basis = latent_basis(a.T @ (a @ omega), omega, rank)
    assert np.linalg.norm(a @ basis, axis=1).min() > 0.99


def test_copies_do_not_depend_on_the_cosine(spark):
    rng = random.Random(8)
    say = lambda n: [f"w{rng.randrange(2000)}" for _ in range(n)]
    items = [(i, " ".join(say(n))) for i, n in enumerate([1, 2, 5, 8, 15, 30, 60, 150])]
    docs = [(i, " ".join(f"{x}y" for x in say(300)) + " " + t + " " + " ".join(f"{x}y" for x in say(100))) for i, t in items]
    for i, t in items[3:]:
        part = t.split()
        for j in range(3, len(part), 6):
            part[j] = "other"
        docs.append((100 + i, " ".join(part)))
    # A run that only the border of two texts makes is none.
    docs += [(200, items[1][1].split()[0]), (201, items[1][1].split()[1])]
    d, b = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in find_passages(d, b, cosine=2.0).collect()}
    want = {(i, i) for i, _ in items} | {(100 + i, i) for i, _ in items[3:]}
    assert got.keys() == want
    assert all(got[i, i].lcs == 1.0 and 256 <= got[i, i].first_word <= 300 for i, _ in items)


def test_answer_is_needed_for_paraphrases(spark):
    item = [(1, "what colour has the quiet northern harbour after seven days of heavy rain answer: deep turquoise")]
    kept = "what colour has the quiet northern harbour after seven days of heavy rain"
    docs = [(1, kept + " said deep turquoise"), (2, kept.replace("heavy", "x").replace("quiet", "y") + " said grey")]
    got = {r.doc_id for r in find_passages(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(item, "item_id long, text string")).collect()}
    assert got == {1}


def test_empty(spark):
    none, docs = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b c d e f g h")], "doc_id long, text string")
    items = docs.withColumnRenamed("doc_id", "item_id")
    assert find_passages(none, items).collect() == []
    assert find_passages(docs, items.limit(0)).collect() == []
