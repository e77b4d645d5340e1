import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from condensa.functions import kernels
from condensa.operators import budget, dedup, fold, graph, index, logs, routing, scoring, stats, symbols
from condensa.functions import codecs
from condensa.runtime import ranked


def values(spark, xs):
    return spark.createDataFrame([(float(x),) for x in xs], "v double").repartition(3)


@pytest.mark.parametrize("xs, want", [([1, 1, 1, 1], 0.0), ([0, 0, 0, 100], 0.75), ([], 0.0), ([42], 0.0)])
def test_gini(spark, xs, want):
    assert abs(stats.gini(values(spark, xs), "v").first().gini - want) < 1e-12


def test_pearson(spark):
    df = lambda pairs: spark.createDataFrame([(float(a), float(b)) for a, b in pairs], "x double, y double")
    assert abs(stats.pearson(df((i, 2 * i) for i in range(1, 6)), "x", "y").first().r - 1) < 1e-12
    assert stats.pearson(df([(1, 2), (2, 3)]), "x", "y").first().r == 0
    assert stats.pearson(df([(1, 5), (2, 5), (3, 5)]), "x", "y").first().r == 0


def knee(scores):
    n = len(scores)
    spread = max(scores) - min(scores)
    if n < 3 or spread < 1e-10:
        return n - 1
    d = [(s - min(scores)) / spread - (1 - i / (n - 1)) for i, s in enumerate(scores)]
    best = max(range(n - 1), key=lambda i: (d[i], -i))
    return next((i for i in range(best + 1, n) if d[i] < d[best] - spread / n), best)


@pytest.mark.parametrize("xs", [[1.0], [5.0] * 5, [10, 9, 8, 2, 1, 0.5, 0.1], [3, 3, 1], [1 / (i + 1) for i in range(40)], [math.sqrt(40 - i) for i in range(40)]])
def test_kneedle(spark, xs):
    assert stats.kneedle(values(spark, xs), "v").first().knee == knee(sorted(map(float, xs), reverse=True))


def test_elements_not_interpolations(spark):
    xs = [5, 1, 9, 3, 7, 11, 2, 8]
    s = sorted(xs)
    got = stats.upper_median_mad(values(spark, xs), "v").first()
    assert got.median == s[4] and abs(got.mad - 1.4826 * sorted(abs(x - s[4]) for x in xs)[4]) < 1e-12
    cuts = stats.cut_points(values(spark, xs), "v").first()
    assert (cuts.p75, cuts.p25) == (s[6], s[2])
    assert tuple(stats.cut_points(values(spark, [4, 2]), "v").first()) == (4, 2)
    assert [r.capped for r in stats.hub_capped(values(spark, [1, 1, 1]), "v").collect()] == [1, 1, 1]
    capped = {r.v: r.capped for r in stats.hub_capped(values(spark, [1, 2, 3, 4, 100]), "v").collect()}
    assert capped[100.0] == 3 + 2 * 1.4826 and capped[4.0] == 4


def test_ranks(spark):
    df = spark.createDataFrame([(i % 7, i) for i in range(500)], "a int, b int").repartition(9)
    got = sorted((r["rank"], r.a, r.b) for r in ranked(df, "a", "b").collect())
    assert [x[1:] for x in got] == sorted((i % 7, i) for i in range(500)) and [x[0] for x in got] == list(range(1, 501))


def test_index_equals_kernel(spark, monkeypatch):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("alpha beta gamma delta epsilon zeta été".split()) for _ in range(rng.randint(0, 12))) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    own, kernel = index.build(df, "i", "t"), kernels.Corpus(texts)
    weights = {r.term: r.eidf for r in own.terms.collect()}
    assert weights.keys() == kernel.weight.keys() and all(abs(weights[t] - w) < 1e-9 for t, w in kernel.weight.items())
    asked = spark.createDataFrame([(0, "alpha été unknown alpha")], "q long, t string")
    got = {r.doc: r.score for r in own.search(asked, "q", "t", None).collect()}
    want = kernel.search("alpha été unknown alpha")
    assert got.keys() == want.keys() and all(abs(got[i] - s) < 1e-9 for i, s in want.items())
    top = own.search(asked, "q", "t", 3, normalize=True).orderBy("rank").collect()
    assert top[0].score == 1.0 and len(top) == 3
    links = {(r.i, r.j): r.sim for r in graph.edges(own).collect()}
    sim = kernel.similarity()
    assert {(i, j) for i in range(30) for j in range(i + 1, 30) if sim[i, j] > 0} == links.keys()
    degree = graph.degrees(graph.edges(own), own.docs)
    prior = {r.doc: r.prior for r in graph.prior(degree).collect()}
    assert np.allclose([prior[i] for i in range(30)], kernels.position_prior(sim.sum(axis=1)))
    want = kernels.page_rank(sim, kernels.position_prior(sim.sum(axis=1)), 8, None)
    # As one matrix, and by rounds of joins.
    for small in (graph.SMALL_GRAPH, 0):
        monkeypatch.setattr(graph, "SMALL_GRAPH", small)
        rank = {r.doc: r["rank"] for r in graph.page_rank(graph.edges(own), graph.prior(degree), rounds=8, epsilon=None).collect()}
        assert np.allclose([rank[i] for i in range(30)], want / want.max(), atol=1e-6)


def test_updated_index_equals_a_new_one(spark):
    rng = random.Random(11)
    text = lambda: " ".join(rng.choice("red green blue cyan pink grey teal gold rust".split()) for _ in range(rng.randint(0, 30)))
    rows = {i: text() for i in range(60)}
    table = lambda d: spark.createDataFrame(list(d.items()), "i long, t string")
    own = index.build(table(rows), "i", "t")
    for k in range(3):
        gone, new = rng.sample(sorted(rows), 9) + [999], {**{i: text() for i in rng.sample(sorted(rows), 4)}, 100 + k: "unseen words here", 200 + k: "", 300 + k: None}
        own = index.update(own, "i", "t", table(new), table(dict.fromkeys(gone, "")))
        rows = {**{i: t for i, t in rows.items() if i not in gone}, **new}
        if k == 1:
            own = index.compact(own)
    want = index.build(table(rows), "i", "t")
    assert (own.n, own.average, own.idf_max) == (want.n, want.average, pytest.approx(want.idf_max)) and own.n == len(rows)
    for one, other in zip((own.docs, own.postings), (want.docs, want.postings)):
        assert sorted(map(tuple, one.collect())) == sorted(map(tuple, other.collect()))
    got, new = ({r.term: tuple(r[1:]) for r in x.terms.collect()} for x in (own, want))
    assert got.keys() == new.keys() and all(np.allclose(got[t], new[t]) for t in got)
    asked = spark.createDataFrame([(0, "red words gold")], "q long, t string")
    found = [[(r.doc, round(r.score, 9)) for r in x.search(asked, "q", "t").orderBy("rank").collect()] for x in (own, want)]
    assert found[0] == found[1]


def test_updates_that_empty_or_do_nothing(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "b")], "i long, t string")
    own = index.build(df, "i", "t")
    assert index.update(own, "i", "t") is own
    empty = index.update(own, "i", "t", removed=df)
    assert empty.n == 0 and empty.terms.count() == 0 and empty.postings.count() == 0
    again = index.update(empty, "i", "t", added=df)
    assert again.n == 2 and {r.term: r.df for r in again.terms.collect()} == {"a": 1, "b": 2}
    for bad in ([(3, "x"), (3, "y")], [(None, "x")]):
        with pytest.raises(ValueError, match="twice or null"):
            index.update(own, "i", "t", added=spark.createDataFrame(bad, df.schema))


def test_segments_equal_the_kernel(spark):
    texts = ["One. Two is longer than that. Three!\n\nFour follows here? \"Yes it does.\"", "", "Ab. Cd. Ef gh ij kl.", "no end"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    got = {}
    for r in graph.segment(df, "i", "t").orderBy("doc", "idx").collect():
        got.setdefault(r.doc, []).append(r.sentence)
    assert [got.get(i, []) for i in range(4)] == [kernels.sentences(t) for t in texts]


def test_ranking_edges():
    assert kernels.rank([]).selected == [] and list(kernels.rank(["x"]).scores) == [1.0]
    got = kernels.rank(["the cat sat here", "the cat ran here", "dogs bark"], 2)
    assert max(got.scores) == 1.0 and len(got.selected) == 2
    assert kernels.summarize("One is here. Two is there. Three is lost.") != ""


def status(spark, rows):
    df = spark.createDataFrame([(i, k, c, n) for i, (k, c, n) in enumerate(rows)], "idx long, etype string, canon string, norm string")
    return [r.status for r in dedup.classify(df).orderBy("idx").collect()]


def test_duplicates(spark):
    rows = [("string", "a", "a"), ("string", "a", "a"), ("dict", '{"id":1}', "{N}"), ("dict", '{"id":2}', "{N}"), ("list", "[1]", None), ("list", "[2]", None), ("list", "[1]", None), ("primitive", "1", None)]
    assert status(spark, rows) == ["unique", "exact", "unique", "near", "unique", "unique", "exact", "unique"]


def test_templates_collapse(spark):
    rows = [(i, {"kind": "x", "n": str(i)}) for i in range(0, 10, 2)] + [(3, {"other": "1"}), (20, {"other": "2"})]
    df = spark.createDataFrame(rows, "idx long, fields map<string,string>")
    spans = dedup.templates(df)
    assert [(r["count"], r.first_idx, r.last_idx, r.static) for r in spans.collect()] == [(5, 0, 8, "kind=x")]
    entries = df.select("idx", F.lit("dict").alias("etype"))
    got = {r.idx: (r.removed, r.template_count) for r in dedup.collapse(entries, spans).collect()}
    assert {i for i, (gone, _) in got.items() if gone} == {2, 3, 4, 6} and got[0][1] == 5
    strict = df.select("idx", F.lit("dict").alias("etype"), F.array_join(F.array_sort(F.map_keys("fields")), ",").alias("schema"))
    assert {r.idx for r in dedup.collapse(strict, spans, same_schema=True).collect() if r.removed} == {2, 4, 6}


def test_overlapping_spans(spark):
    rng = random.Random(8)
    spans = sorted((rng.randrange(100), rng.randrange(100)) for _ in range(12))
    spans = [(min(s), max(s) + 1) for s in spans]
    df = spark.createDataFrame([(i, "dict") for i in range(110)], "idx long, etype string").repartition(5)
    s = spark.createDataFrame([("", "", 3, a, b) for a, b in spans], "schema string, static string, count long, first_idx long, last_idx long").dropDuplicates(["first_idx"])
    own = [(r.first_idx, r.last_idx) for r in s.collect()]
    got = {r.idx for r in dedup.collapse(df, s).collect() if r.removed}
    assert got == {i for i in range(110) if any(a < i < b for a, b in own)}


def test_bounded_first_in_first_out(spark):
    df = spark.createDataFrame([("s", i, c) for i, c in enumerate("abacbda")], "session string, idx long, canon string")
    got = [r.canon for r in dedup.bounded_first(df, "session", 2).orderBy("idx").collect()]
    # a, b; a is held; c pushes a out; b is held; d pushes b out; a is new again.
    assert got == ["a", "b", "c", "d", "a"]


def test_allocation(spark):
    rows = [(i, 100, s, t) for i, (s, t) in enumerate([(1.0, "high"), (1.0, "high"), (0.5, "medium"), (0.0, "low"), (0.0, "cut")])]
    df = spark.createDataFrame(rows, "idx long, tokens long, score double, tier string")
    got = {r.idx: (r.tier_budget, r.entry_budget) for r in budget.allocate(df, 1000).collect()}
    assert got == {0: (570, 285), 1: (570, 285), 2: (285, 285), 3: (95, 95), 4: (0, 0)}
    assert budget.auto_budget(df, "tokens").first().budget == 250
    kept = budget.allocate(df.withColumn("tier", F.when(F.col("idx") == 4, "preserve").otherwise(F.col("tier"))), 1000)
    assert {r.idx: r.entry_budget for r in kept.collect()}[4] == 100


def test_scoring(spark):
    df = spark.createDataFrame([(i, float(i), float(i % 3)) for i in range(40)], "idx long, own double, rel double")
    assert scoring.core(df, "idx", "own").filter("is_core").count() == scoring.core_size(40, knee([float(39 - i) for i in range(40)]))
    tiers = {r.idx: r.tier for r in scoring.tiers(df, "own").collect()}
    assert tiers[30] == "high" and tiers[29] == "medium" and tiers[10] == "medium" and tiers[9] == "low" and tiers[0] == "cut"
    assert max(r.final for r in scoring.blend(df, "own", "rel").collect()) == 1.0


CASES = [("error.message", "x" * 200, True, "preserve"), ("payload_extra", "v", True, "passthrough"), ("payload", "v", True, "truncate"), ("payload.a.b", "v", True, "truncate"), ("log.stdout", "v", True, "parse_json"), ("log.size", "v", False, "drop"), ("log.size", "v", True, "passthrough")]


def test_routing(spark):
    own = routing.Routing(preserve=(routing.Matcher(pattern="^message$"),), rules=(routing.Rule(routing.Matcher(path="payload"), "truncate", 9), routing.Rule(routing.Matcher(pattern="stdout$"), "parse_json"), routing.Rule(routing.Matcher(path="log", min_length=5), "drop")))
    df = spark.createDataFrame(CASES, "path string, value string, is_string boolean, want string")
    for r in df.withColumn("got", routing.route(F.col("path"), F.col("value"), F.col("is_string"), own)).collect():
        assert r.got == r.want, r
    off = routing.Routing(enabled=False, rules=own.rules)
    assert {r[0] for r in df.select(routing.route(F.col("path"), F.col("value"), F.col("is_string"), off)).collect()} == {"passthrough"}
    with pytest.raises(ValueError):
        routing.preset("none")
    assert routing.applied(df.filter("is_string"), "path", "value", own).filter("action = 'truncate'").count() == 2


def test_folding(spark):
    df = spark.createDataFrame([([1, 2, 3, 4, 5, 6, 7, 8],), ([1],), ([],)], "a array<int>")
    got = [r.f for r in df.select(fold.folded("a").alias("f")).collect()]
    assert (got[0]["count"], got[0].sample) == (8, [1, 2, 3]) and got[1:] == [None, None]
    with pytest.raises(ValueError):
        fold.folded("a", 0)
    assert fold.fold_value({"a": [[1] * 9] * 7}, marker="m")["a"] == {"m": True, "count": 7, "sample": [{"m": True, "count": 9, "sample": [1, 1, 1]}] * 3}
    text = spark.createDataFrame([(json.dumps({"x": list(range(9))}),), ("no json",)], "t string").select(fold.fold_json("t").alias("o")).collect()
    assert json.loads(text[0].o)["x"]["count"] == 9 and text[1].o == "no json"


@pytest.mark.parametrize("limit", [0, 80, 200, 500])
def test_logs_equal_the_kernel(spark, limit):
    text = "\n".join(f"2024-01-01 10:00:{i % 60:02d} {('INFO ok', 'WARN request timeout', 'ERROR failed')[i % 3]} n{i % 4}" + ("\n" if i % 9 == 0 else "") for i in range(40))
    df = spark.createDataFrame([(1, text), (2, "one line"), (3, "")], "id long, t string")
    got = {r.log: r.compressed for r in logs.compress(logs.lines_of(df, "id", "t"), limit).collect()}
    assert got == {i: codecs.compress_log(t, limit) for i, t in [(1, text), (2, "one line"), (3, "")]}


SOURCE = "import os\n\nclass A:\n    def f(self):\n        return g()\n\ndef g():\n    x = 1\n    return x\n"


def test_symbols(spark):
    files = spark.createDataFrame([("a.py", "python", SOURCE), ("b.x", "cobol", "y")], "path string, language string, text string")
    table = symbols.symbols(files)
    assert {(r.name, r.type, r.line) for r in symbols.definitions(table).collect()} == {("A", "class", 3), ("f", "method", 4), ("g", "function", 7)}
    assert [r.line for r in symbols.find(table, "A.f").collect()] == [4] and symbols.find(table, "g.f").collect() == []
    assert symbols.select(table, "ref", exclude=("import",)).count() == 1
    assert symbols.summary(table).first().summary == "1 class, 1 function, 1 method"
    inner = symbols.innermost(spark.createDataFrame([("a.py", 8), ("a.py", 1)], "path string, line long"), symbols.scopes(files))
    assert {r.line: r.scope_name for r in inner.collect()} == {8: "g", 1: ""}
    bad = spark.createDataFrame([("c.py", "python", "def f(:\n")], files.schema)
    assert symbols.syntax_errors(bad).count() == 1 and symbols.syntax_errors(files).count() == 0
    md = spark.createDataFrame([("d.md", "markdown", "a\n```python\nx\n```\n")], files.schema)
    assert [(r.embedded, r.startLine) for r in symbols.injections(md).collect()] == [("python", 3)]
    outline = symbols.outlines(files).filter("path = 'a.py'").first().structure
    assert [(b.name, b.startLine) for b in sorted(outline, key=lambda b: b.startLine)] == [("A", 2), ("f", 3), ("g", 6)]
