import random
import re
import zlib

import numpy as np

from condensa.llm.quality import _CAPITALS, _LONG, _REPEAT, features, index_vectors, quality_scores, tokens, word_vectors

ROWS = 1 << 10


def brute_tokens(text):
    """Kinds of tokens: c capitals, r repeats, l long, or the folded token."""
    raw = (text or "").encode()
    found = re.findall(rb"[0-9A-Za-z\x80-\xff]+|[!-/:-@\[-`{-~]+", raw)
    out = []
    for i, t in enumerate(found):
        folded = [x.lower() for x in found[max(0, i - 2) : i]]
        word = re.match(rb"[0-9A-Za-z\x80-\xff]", t) is not None
        if word and t.lower() in folded:
            out.append("r")
        elif word and len(re.findall(rb"[A-Z]", t)) >= 2 and not re.search(rb"[a-z]", t):
            out.append("c")
        elif word and len(t) > 40:
            out.append("l")
        else:
            out.append(t.lower())
    return out


def test_tokens_equal_brute_force():
    rng = random.Random(3)
    texts = ["", None, "Ab ab AB cd", "x" * 50, "ÉA bc!! ***", "a"] + ["".join(rng.choice("aAbBé !#\n\t9") for _ in range(rng.randint(0, 60))) for _ in range(200)]
    special = {_CAPITALS: "c", _REPEAT: "r", _LONG: "l"}
    names = {}
    n = 0
    for ids, at in tokens(texts, 1 << 40, 50):
        for i, j in zip(at[:-1], at[1:]):
            want = brute_tokens(texts[n])
            got = ids[i:j].tolist()
            assert len(got) == len(want), texts[n]
            for g, w in zip(got, want):
                assert special.get(g, names.setdefault(g, w) if g not in special else None) == w
            n += 1
    assert n == len(texts)


def test_word_vectors_equal_brute_force(spark):
    texts = ["a b c a. d", "b c", "", None, "x y z " * 300]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    got, index = word_vectors(df, ROWS), index_vectors(ROWS)
    want = np.zeros((ROWS, index.shape[1]))
    for ids, at in tokens(texts, ROWS):
        for i, j in zip(at[:-1], at[1:]):
            own = ids[i:j]
            for p in range(len(own)):
                for q in range(max(0, p - 2), min(len(own), p + 3)):
                    if p != q:
                        want[own[p]] += index[own[q]]
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-9)
    assert np.allclose(got, want, atol=1e-5)


def test_features_have_a_row_a_text():
    vectors = np.random.default_rng(0).normal(size=(ROWS, index_vectors(ROWS).shape[1])).astype(np.float32)
    texts = ["", "a b", None, "c", "d e f " * 40_000, ""]
    f = np.concatenate(list(features(texts, vectors)))
    assert len(f) == len(texts) and np.isfinite(f).all() and not f[0].any() and f[1].any()


def corpus(n=800):
    rng = random.Random(2)
    words = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for d in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(5, 80))]
        bad = d % 4 == 0
        if bad:
            text = [x.upper() + "!!" if d % 8 else f"{x} |" for x in text]
        rows.append((d, " ".join(text)))
        labels.append((d, int(not bad)))
    return rows, labels


def test_held_out_accuracy_and_odd_rows(spark):
    rows, labels = corpus()
    odd = [(None, "word1 word2"), (5000, None), (5001, ""), (5002, "word3 " * 50_000), (3, rows[3][1])]
    df = spark.createDataFrame([(d, t, 7, "s") for d, t in rows + odd], "doc_id long, text string, label int, score string")
    lab = spark.createDataFrame([*labels, (None, 1), (6000, 0), (5, None), (9, 1)], "doc_id long, quality int")
    got = quality_scores(df, lab, rows=ROWS).collect()
    assert len(got) == len(rows) + len(odd)
    right = 0
    held = [r for r in got if r.held_out and r.doc_id < 5000]
    truth = dict(labels)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    right = sum((r.score >= 0.5) == truth[r.doc_id] for r in held)
    assert right >= 0.95 * len(held) > 0


def test_labels_of_one_kind_or_none(spark):
    rows, labels = corpus(20)
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    assert {r.score for r in quality_scores(df, lab.limit(0), rows=ROWS).collect()} == {0.5}
    assert {r.score for r in quality_scores(df, lab.filter("quality = 1"), rows=ROWS).collect()} == {1.0}
    assert quality_scores(df.limit(0), lab, rows=ROWS).collect() == []
