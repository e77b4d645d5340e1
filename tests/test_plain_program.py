"""The whole program against one written plainly, entry after entry, in lists."""

import random
import re
import struct

import numpy as np
import pytest
import xxhash

from condensa.functions import codecs, kernels
from condensa.plans import compress as program
from condensa.sources import entries

WORDS = "amber basalt cedar delta ember fjord grove harbor inlet jetty knoll lagoon meadow north orchard pier quarry ridge shoal tundra".split()


def texts(n, seed, lonely):
    """Texts of a few subjects, so that some are central, a share with words of their own; one in twelve an exact or near copy of an earlier one."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        if i > 10 and rng.random() < 1 / 12:
            out.append(rng.choice(out) if rng.random() < 0.5 else re.sub(r"10\.0\.0\.\d+", "10.0.0.7", rng.choice(out)))
            continue
        pool = [f"{w}{i}x" for w in WORDS] if rng.random() < lonely else rng.sample(WORDS, 6) if rng.random() < 0.6 else WORDS[:5]
        out.append(f"10.0.0.{i % 250} note{i} " + " ".join(rng.choice(pool) + (str(rng.randint(0, 9)) if rng.random() < 0.2 else "") for _ in range(rng.randint(4, 90))))
    return out


def upper(xs, share):
    return sorted(xs)[min(len(xs) - 1, int(len(xs) * share))]


def knee(xs):
    xs, n = sorted(xs, reverse=True), len(xs)
    spread = xs[0] - xs[-1]
    if n < 3 or spread < 1e-10:
        return n - 1
    d = [(x - xs[-1]) / spread - (1 - i / (n - 1)) for i, x in enumerate(xs)]
    best = max(range(n - 1), key=lambda i: (d[i], -i))
    return next((i for i in range(best + 1, n) if d[i] < d[best] - spread / n), best)


def centrality(own, query, full, sample):
    """The first score of each text: its place in the graph of all, or of a sample with retrieval by the sample's core."""
    ids = sorted(own)
    if len(ids) <= full:
        return dict(zip(ids, kernels.rank([own[i] for i in ids], 1, query).scores))
    signed = lambda i: struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(struct.pack("<q", i), 42)))[0]
    some = sorted(sorted(ids, key=lambda i: (signed(i), i))[:sample])
    inner = dict(zip(some, kernels.rank([own[i] for i in some], 1, query).scores))
    core = sorted(some, key=lambda i: (-inner[i], i))[: max(3, sample // 5)]
    hits = retrieval(own, " ".join(own[i][:200] for i in core), query)
    top = max(hits.values())
    hits = {i: h / top for i, h in hits.items()}
    return {i: 0.5 * inner[i] + 0.5 * hits.get(i, 0.0) if i in inner else hits.get(i, 0.0) for i in ids}


def retrieval(own, excerpt, query):
    ids = sorted(own)
    asked = f"{query} {excerpt[:500]}" if query else excerpt[:2000]
    return {ids[k]: s for k, s in kernels.Corpus([own[i] for i in ids]).search(asked).items()}


def plain(rows, budget, query, full, sample):
    """{idx: (tier, score, entry budget, output)} of the texts that stay."""
    exact, near, own = set(), set(), {}
    for i, t in enumerate(rows):
        if t in exact:
            continue
        exact.add(t)
        if codecs.normalized(t) not in near:
            own[i] = t
        near.add(codecs.normalized(t))
    score = centrality(own, query, full, sample)
    n, total = len(score), sum(score.values())
    gini = 1 - 2 * np.cumsum(sorted(score.values())).sum() / (n * total) + 1 / n
    if gini < 0.2:
        tier, final = dict.fromkeys(own, "medium"), dict.fromkeys(own, 1 / n)
    else:
        median = upper(score.values(), 0.5)
        mad = 1.4826 * upper([abs(v - median) for v in score.values()], 0.5)
        capped = {i: median + 2 * mad if mad and (v - median) / mad > 3 else v for i, v in score.items()}
        order = sorted(capped, key=lambda i: (-capped[i], i))
        core = order[: max(1, min(knee(capped.values()) + 1, n // 2), n // 20)]
        hits = retrieval(own, " ".join(own[i][:200] for i in core), query)
        relevance = {i: hits.get(i, 0.0) for i in own}
        ids = sorted(own)
        r = np.corrcoef([capped[i] for i in ids], [relevance[i] for i in ids])[0, 1]
        mixed = {i: capped[i] if r > 0.95 else 0.4 * capped[i] + 0.6 * relevance[i] for i in ids}
        final = {i: v / max(mixed.values()) for i, v in mixed.items()}
        high, low = upper(final.values(), 0.75), upper(final.values(), 0.25)
        tier = {i: "high" if v >= high else "medium" if v >= low else "low" if v > 0 else "cut" for i, v in final.items()}
    left = budget - int(budget * 0.05)
    dealt = {t: int(left * share) for t, share in (("high", 0.6), ("medium", 0.3), ("low", 0.1))}
    sums = {t: sum(max(final[i], 1e-10) for i in own if tier[i] == t) for t in dealt}
    out = {}
    for i, t in tier.items():
        if t != "cut":
            limit = max(10, int(dealt[t] * max(final[i], 1e-10) / sums[t]))
            out[i] = (t, final[i], limit, codecs.compress_string(own[i], limit, query=query))
    return out


@pytest.mark.parametrize(
    "n, query, lonely, full, sample, flat",
    [(60, None, 0.0, 1000, 500, True), (60, None, 0.5, 1000, 500, False), (60, "cedar delta", 0.5, 1000, 500, False), (150, "harbor", 0.4, 40, 30, False), (150, None, 0.4, 40, 30, False)],
)
def test_program_equals_the_plain_one(spark, monkeypatch, n, query, lonely, full, sample, flat):
    monkeypatch.setattr(program, "FULL_GRAPH", full)
    monkeypatch.setattr(program, "SAMPLE", sample)
    rows = texts(n, n + len(query or ""), lonely)
    own = entries.from_strings(spark.createDataFrame(list(enumerate(rows)), "i long, t string"), "i", "t")
    got = {r.idx: r for r in program.compress(own, 4000, program.Options(query=query)).collect()}
    want = plain(rows, 4000, query, full, sample)
    assert got.keys() == want.keys() and len(want) < n
    for i, (tier, score, limit, output) in want.items():
        assert got[i].tier == tier and got[i].score == pytest.approx(score, abs=1e-6), i
        # A budget that a sum's last digit decides may be one off.
        assert abs(got[i].entry_budget - limit) <= 1
        assert got[i].entry_budget != limit or got[i].output == output
    assert ({t for t, *_ in want.values()} == {"medium"}) == flat
