import math
import random
import re
from collections import Counter

import numpy as np

from condensa.llm.common import WORD_BYTE
from condensa.llm.language_id import _BITS, identify, trigrams

WORDS = {
    "en": "the and with that this from have they were which their would there about other".split(),
    "de": "der und nicht mit dass werden eine einen auch nach über müssen schön größe für".split(),
    "fr": "les des une dans pour avec être qui que cette leurs où très même français".split(),
}


def corpus(n=240, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(WORDS))
        rows.append((i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(3, 40))), lang, f"h{i % 7}.site.example"))
    return rows


def brute_slots(text):
    raw = [b if WORD_BYTE[b] else 32 for b in b"  " + (text or "").lower().encode() + b"  "]
    out = []
    for i in range(1, len(raw) - 1):
        if raw[i] != 32:
            code = raw[i - 1] << 16 | raw[i] << 8 | raw[i + 1]
            out.append((code * 2654435761 % 2**32) >> (32 - _BITS))
    return out


def test_trigrams_equal_brute_force():
    texts = ["", None, "a", "Ab, c", "é!", "  x  yz"] + [t for _, t, *_ in corpus(20)]
    n = 0
    for got, at in trigrams(texts, 40):
        for i, j in zip(at[:-1], at[1:]):
            assert got[i:j].tolist() == brute_slots(texts[n])
            n += 1
    assert n == len(texts)


def test_held_out_texts(spark):
    train = spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string")
    rows = corpus(200, seed=9) + [(1000, None, "en", None), (1001, "", None, ""), (1002, "!!! ---", "en", "h1.site.example"), (1003, "the and " * 30_000, None, None), (None, "der und nicht", None, "x"), (5, "und nicht mit dass", "de", "x")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, lang string, source string, guess string")
    got = identify(df, "doc_id", "text", host_col="source", train=train).collect()
    assert len(got) == len(rows)
    truth = {r[0]: r[2] for r in rows if r[0] is not None and r[0] < 200 and r[0] != 5}
    for r in got:
        if r.doc_id in truth:
            assert r.language == truth[r.doc_id] and r.accepted
        if r.doc_id in (1000, 1001, 1002):
            assert r.language == "und" and not r.accepted
    assert {(r.language, r.accepted) for r in got if r.doc_id == 1003} == {("en", True)}


def test_other_evidence_decides_where_text_does_not(spark):
    # One word that two languages share, told apart by markup, address suffix and host.
    train = spark.createDataFrame([(i, t, lang, "") for i, (t, lang) in enumerate([("taxi alpha beta", "en"), ("taxi gamma delta", "de")] * 50)], "doc_id long, text string, lang string, source string")
    page = lambda lang, text: f"<html lang='{lang}'><p>{text}</p>"
    rows = [(i, "http://a.example/x", page("en", "alpha beta " * 9)) for i in range(40)] + [(100 + i, "http://b.de/x", page("de", "gamma delta " * 9)) for i in range(40)]
    rows += [(200, "http://c.example/x", page("en", "taxi")), (201, "http://c.example/x", page("de", "taxi")), (202, "http://www.d.de/", "taxi"), (203, "http://a.example/y", "taxi"), (204, None, "taxi")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.language for r in identify(df, "page_id", "html", url_col="url", train=train).collect()}
    assert [got[i] for i in (200, 201, 202, 203)] == ["en", "de", "de", "en"]


def test_without_labels_and_empty(spark):
    df = spark.createDataFrame([(1, "a b", None, "h")], "doc_id long, text string, lang string, source string")
    assert [(r.language, r.accepted) for r in identify(df, "doc_id", "text", host_col="source").collect()] == [("und", False)]
    assert identify(df.limit(0), "doc_id", "text", host_col="source").collect() == []


def test_unknown_script_is_rejected(spark):
    train = spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string")
    rng = np.random.default_rng(0)
    odd = "".join(chr(c) for c in rng.integers(0x4E00, 0x9000, 200))
    df = spark.createDataFrame([(1, odd)], "doc_id long, text string")
    assert [r.language for r in identify(df, "doc_id", "text", train=train).collect()] == ["und"]


def test_every_label_is_learned(spark):
    # More labels than a block, the last of them with the fewest texts.
    rows = []
    for i in range(70):
        rng = np.random.default_rng(i)
        words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(12)]
        rows += [(1000 * i + j, " ".join(rng.choice(words, 40)), f"l{i:02d}") for j in range(2 if i > 63 else 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in identify(df, "doc_id", "text").collect()}
    assert all(got[i].language == lang and got[i].accepted for i, _, lang in rows)


def brute_identify(rows, train, mass=20.0):
    """(id: language, confidence) in plain Python: likelihoods, then priors and evidence from all other documents."""
    names = sorted({lang for _, _, lang, _ in train if lang is not None})
    counts = {lang: Counter(s for _, t, x, _ in train if x == lang and t is not None for s in brute_slots(t)) for lang in names}
    slots, n = 1 << _BITS, len(names) + 1
    norm = {lang: sum(c.values()) + 0.5 * slots for lang, c in counts.items()}

    def softmax(x):
        w = [math.exp(v - max(x)) for v in x]
        return [v / sum(w) for v in w]

    ll, post = {}, {}
    for i, _, text in rows:
        if got := brute_slots(text):
            ll[i] = [sum(math.log((counts[lang][s] + 0.5) / norm[lang]) for s in got) / 3 for lang in names] + [-len(got) * math.log(slots) / 3]
            post[i] = softmax([v + math.log((1 - 1e-3) / (n - 1) if j < n - 1 else 1e-3) for j, v in enumerate(ll[i])])
    host = {i: (re.match(r"(?:\w+:)?//([^/?#:]*)", u or "") or [None, ""])[1].lower() for i, u, _ in rows}
    domain = {i: ".".join(h.split(".")[-2:]) if "." in h else "" for i, h in host.items()}
    declared = {i: (re.search(r"<html\b[^>]*?\slang\s*=\s*[\"']?\s*([a-z]{2,3})\b", t or "", re.I) or [None, ""])[1].lower() for i, _, t in rows}
    suffix = {i: (re.search(r"\.([a-z]{2})$", h) or [None, ""])[1] for i, h in host.items()}
    out = {}
    for i, _, _ in rows:
        if i not in ll:
            out[i] = ("und", 1.0)
            continue
        others = [j for j in post if j != i]
        prior = [1 + sum(post[j][k] for j in others) for k in range(n)]
        prior = [v / sum(prior) for v in prior]
        for of in (domain, host):
            sums = [sum(post[j][k] for j in others if host[i] and of[j] == of[i]) for k in range(n)]
            prior = [(a + mass * b) / (sum(sums) + mass) for a, b in zip(sums, prior)]
        total = [a + math.log(b) for a, b in zip(ll[i], prior)]
        for of in (declared, suffix):
            values = len({v for v in of.values() if v})
            if of[i]:
                for k in range(n):
                    guessed = [j for j in others if of[j] and post[j].index(max(post[j])) == k]
                    total[k] += math.log((sum(of[j] == of[i] for j in guessed) + 1) / (len(guessed) + values))
        last = softmax(total)
        out[i] = ([*names, "und"][last.index(max(last))], max(last))
    return out


def test_fusion_equals_brute_force(spark):
    rng = random.Random(12)
    train = corpus(60, seed=2)
    rows = []
    for i in range(90):
        lang = rng.choice(sorted(WORDS))
        text = " ".join(rng.choice(WORDS[rng.choice([lang, lang, rng.choice(sorted(WORDS))])]) for _ in range(rng.choice([0, 1, 1, 2, 6])))
        html = rng.choice([f"<html lang='{lang}'>{text}", text])
        rows.append((i, rng.choice([None, f"http://{lang}.site.example/x", f"http://www.news.{lang}/", f"http://solo{i}.{lang}/"]), html))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    model = spark.createDataFrame(train, "doc_id long, text string, lang string, source string")
    want = brute_identify(rows, train)
    got = {r.page_id: (r.language, r.confidence) for r in identify(df, "page_id", "html", url_col="url", train=model).collect()}
    assert all(got[i][0] == want[i][0] and abs(got[i][1] - want[i][1]) < 1e-4 for i in want)
    # Evidence beside the text changes answers here.
    alone = brute_identify([(i, None, t if "<html" not in t else t.split(">", 1)[1]) for i, _, t in rows], train)
    assert sum(alone[i][0] != want[i][0] for i in want) > 3
