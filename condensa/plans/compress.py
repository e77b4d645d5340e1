"""The whole program: entries and a budget in, the entries that are worth it out, each within its allowance.

Duplicates go, the rest is scored (by a graph of all entries up to a thousand, by a sample's graph
and retrieval beyond), tiers and allowances follow from the scores, and codecs shorten each entry.
``strict`` leaves preserved entries as they are; else their estimated tokens are a budget like any.
An entry that opens a template is written as a marker with the template's count and its first and last
entry, each within half of the budget. ``preset`` names a rule set that the fields of objects are routed
by, at any depth, in place of the fixed fields.

Bodies are moved twice: once when duplicates have been left out, to be scored, and once when it is known
which entries stay. All else is keyed by place.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codecs
from ..functions.text import string_token_estimate, token_estimate
from ..operators import budget as budgets
from ..operators import dedup, fold, graph, index, routing, scoring, stats
from ..runtime import cut, ranked, stored

#: When a graph is of all entries, how large a sample is, and lengths of excerpts.
FULL_GRAPH, SAMPLE, CORE_PART, EXCERPT, QUERY_CORE, CORE_TEXT = 1000, 500, 5, 200, 500, 2000


@dataclass(frozen=True)
class Options:
    query: str | None = None
    least_entries: int = 5
    fixed_core: bool = False
    strict: bool = False
    preset: str | None = None
    marker: str = "__template"
    sentence_top_k: int = 0


def flat_text(body, etype):
    """Keys and values of JSON as one text; strings as they are."""

    def one(value) -> str:
        if isinstance(value, dict):
            return " ".join(f"{k} {one(v)}" for k, v in value.items())
        if isinstance(value, list):
            return " ".join(one(v) for v in value)
        return "" if value is None else str(value)

    @F.pandas_udf("string")
    def run(bodies: pd.Series) -> pd.Series:
        return bodies.map(lambda b: None if b is None else one(json.loads(b)))

    # Strings don't go through Python.
    return F.coalesce(F.when(etype == "string", body), run(F.when(etype != "string", body)))


def _routed(value, path: str, routing: routing.Routing, options: Options):
    """A value of JSON by its action; objects field by field. ``DROPPED`` for what goes."""
    action, limit = routing_of(path, value, routing)
    if action == "drop":
        return DROPPED
    if action == "array" and isinstance(value, list):
        return fold.fold_value(value, 5)
    if isinstance(value, str):
        if action == "truncate":
            return codecs.compress_string(value, limit or 500, query=options.query)
        if action == "dedup":
            return codecs.normalized(value)
        if action == "parse_json":
            try:
                return json.loads(value)
            except ValueError:
                return value
    # Length gates hold for all that isn't a string, so what is done to strings doesn't end the way down.
    if isinstance(value, dict) and action != "preserve":
        done = {k: _routed(v, f"{path}.{k}" if path else k, routing, options) for k, v in value.items()}
        return {k: v for k, v in done.items() if v is not DROPPED}
    return value


DROPPED = object()
routing_of = routing.chosen


def template_entry(first: str, last: str, etype: str, count: int, budget: int | None, options: Options) -> str:
    """The marker that stands for a template: how many entries, and its first and last, each within half of the budget."""
    ends = [json.loads(compress_entry(x, etype, budgets.halved(budget), options)) for x in (first, last)]
    return json.dumps({options.marker: True, "count": count, "first": ends[0], "last": ends[1]}, ensure_ascii=False)


def compress_entry(body: str, etype: str, budget: int | None, options: Options) -> str:
    """One entry within its budget; objects by their top-level fields, lists by folding."""
    if etype == "string":
        limit = len(body) if budget is None else budget
        if options.sentence_top_k and len(body) > max(limit, 500):
            from ..functions import kernels

            parts = kernels.sentences(body)
            body = " ".join(parts[i] for i in sorted(kernels.rank(parts, options.sentence_top_k, options.query).selected)) or body
        return codecs.compress_string(body, limit, query=options.query)
    value = json.loads(body)
    if isinstance(value, list):
        return json.dumps(fold.fold_value(value, 5 if budget is None else max(3, budget // 50)), ensure_ascii=False)
    if not isinstance(value, dict):
        return body
    if options.preset:
        return json.dumps(_routed(value, "", routing.preset(options.preset), options), ensure_ascii=False)
    out = {}
    for key, v in value.items():
        low = key.lower()
        if low not in routing.PRESERVE_FIELDS and low in routing.ENCODE_FIELDS:
            if isinstance(v, list) and len(v) > 5:
                v = fold.fold_value(v, 5)
            elif isinstance(v, str) and budget:
                v = codecs.compress_string(v, budget // max(1, len(value)), query=options.query)
        out[key] = v
    return json.dumps(out, ensure_ascii=False)


def score(texts: DataFrame, n: int, whole: index.Index | None, options: Options) -> DataFrame:
    """(idx, self): how central each of ``n`` texts is, from (idx, place, text) and their index; place is 0 to n - 1."""
    if whole is None:
        # A corpus of at most a thousand texts is ranked in one grouped call.
        own = texts.withColumn("_one", F.lit(1))
        return graph.rank_groups(own, "_one", "place", "text", 1, options.query).join(texts.select("place", "idx"), "place").select("idx", F.col("score").alias("self"))
    # A sample by hash of the place, ranked as a corpus of its own; retrieval by its core for all.
    sample = cut(texts.orderBy(F.xxhash64("idx"), "idx").limit(SAMPLE))
    places = sample.withColumn("_one", F.lit(1))
    inner = cut(graph.rank_groups(places, "_one", "idx", "text", 1, options.query).select("idx", F.col("score").alias("central")))
    core = inner.orderBy(F.desc("central"), "idx").limit(max(3, SAMPLE // CORE_PART)).join(sample, "idx")
    excerpt = " ".join(r["t"] for r in core.orderBy(F.desc("central"), "idx").select(F.substring("text", 1, EXCERPT).alias("t")).collect())
    asked = f"{options.query} {excerpt[:QUERY_CORE]}" if options.query else excerpt[:CORE_TEXT]
    hits = whole.search(texts.sparkSession.createDataFrame([(0, asked)], "q long, t string"), "q", "t", top_k=None, normalize=True).select(F.col("doc").alias("idx"), F.col("score").alias("hit"))
    both = texts.select("idx").join(hits, "idx", "left").join(inner, "idx", "left")
    hit = F.coalesce("hit", F.lit(0.0))
    return both.select("idx", F.when(F.col("central").isNotNull(), 0.5 * F.col("central") + 0.5 * hit).otherwise(hit).alias("self"))


def scored_entries(entries: DataFrame, options: Options) -> DataFrame:
    """(idx, score, tier, is_core) of entries (idx, etype, body)."""
    entries = stored(entries.select("idx", "etype", "body"))
    n = entries.count()
    if n < options.least_entries:
        return entries.select("idx", F.lit(1.0).alias("score"), F.lit("preserve").alias("tier"), F.lit(False).alias("is_core"))
    texts = entries.select("idx", flat_text(F.col("body"), F.col("etype")).alias("text"))
    if n > FULL_GRAPH:
        # Only the graph of all texts needs places.
        whole = index.build(texts, "idx", "text")
        own = cut(score(texts, n, whole, options))
    else:
        whole = None
        texts = cut(ranked(texts, "idx", name="place").withColumn("place", F.col("place") - 1))
        own = cut(score(texts, n, None, options))
    if (stats.gini(own, "self").first()["gini"] or 0.0) < scoring.GINI_LEAST:
        return entries.select("idx", F.lit(1.0 / n).alias("score"), F.lit("medium").alias("tier"), F.lit(False).alias("is_core"))
    capped = stats.hub_capped(own, "self").select("idx", F.col("capped").alias("self"))
    central = cut(scoring.core(capped, "idx", "self", options.fixed_core).select("idx", "self", "core_rank", "is_core"))
    # The excerpt is at most CORE_TEXT characters, so its first few core entries are enough.
    first = central.filter("is_core").orderBy("core_rank").limit(CORE_TEXT).join(texts, "idx").orderBy("core_rank").select(F.substring("text", 1, EXCERPT).alias("t"))
    excerpt = " ".join(r["t"] for r in first.collect())
    asked = f"{options.query} {excerpt[:QUERY_CORE]}" if options.query else excerpt[:CORE_TEXT]
    whole = whole or index.build(texts, "idx", "text")
    hits = whole.search(entries.sparkSession.createDataFrame([(0, asked)], "q long, t string"), "q", "t", top_k=None).select(F.col("doc").alias("idx"), F.col("score").alias("relevance"))
    both = cut(central.join(hits, "idx", "left").withColumn("relevance", F.coalesce("relevance", F.lit(0.0))))
    blended = cut(scoring.blend(both, "self", "relevance"))
    return scoring.tiers(blended, "final").select("idx", F.col("final").alias("score"), "tier", "is_core")


def compress(entries: DataFrame, budget: int | None = None, options: Options = Options()) -> DataFrame:
    """(idx, tier, score, entry_budget, output, template_count) of the entries that stay, from idx, etype, canon, norm and body."""
    estimate = F.when(F.col("etype") == "string", string_token_estimate("body")).otherwise(token_estimate("canon"))
    sizes = stored(entries.select("idx", "etype", estimate.alias("tokens")))
    if budget is None:
        budget = budgets.auto_budget(sizes, "tokens").first()["budget"]
    keep = stored(dedup.statuses(entries).filter("status = 'unique'").select("idx").join(sizes, "idx"))
    dicts = entries.join(keep.filter("etype = 'dict'").select("idx"), "idx", "left_semi")
    spans = cut(dedup.templates(dicts.select("idx", F.from_json("canon", "map<string,string>").alias("fields")))) if keep.filter("etype = 'dict'").limit(1).count() else None
    if spans is None or spans.isEmpty():
        keep = keep.withColumn("template_count", F.lit(None).cast("long")).withColumn("last_idx", F.lit(None).cast("long"))
    else:
        keep = dedup.collapse(keep, spans).filter("NOT removed").drop("removed")
        keep = stored(keep.join(spans.groupBy(F.col("first_idx").alias("idx")).agg(F.max("last_idx").alias("last_idx")), "idx", "left"))
    scored = stored(scored_entries(entries.join(keep.select("idx"), "idx", "left_semi"), options))
    allowed = stored(budgets.allocate(keep.join(scored, "idx").filter("tier <> 'cut'"), budget))

    @F.pandas_udf("string")
    def run(bodies: pd.Series, kinds: pd.Series, limits: pd.Series, tiers: pd.Series, counts: pd.Series, lasts: pd.Series) -> pd.Series:
        out = []
        for b, k, n, t, c, last in zip(bodies, kinds, limits, tiers, counts, lasts):
            if options.strict and t == "preserve" and last is None:
                out.append(b)
            elif last is not None:
                out.append(template_entry(b, last, k, int(c), int(n), options))
            else:
                out.append(compress_entry(b, k, int(n), options))
        return pd.Series(out, dtype="object")

    bodies = entries.select("idx", "body")
    lasts = bodies.join(allowed.filter("last_idx IS NOT NULL").select(F.col("last_idx").alias("idx")).distinct(), "idx", "left_semi")
    done = allowed.join(bodies, "idx").join(lasts.select(F.col("idx").alias("last_idx"), F.col("body").alias("last_body")), "last_idx", "left") if spans is not None else allowed.join(bodies, "idx").withColumn("last_body", F.lit(None).cast("string"))
    return done.select("idx", "tier", "score", "entry_budget", run("body", "etype", "entry_budget", "tier", "template_count", "last_body").alias("output"), "template_count")


def report(entries: DataFrame, done: DataFrame) -> DataFrame:
    """One row: entries in and out, how many of each tier stay, and the ratio of characters saved."""
    before = entries.agg(F.count("*").alias("entries_in"), F.sum(F.length("body")).alias("chars_in"))
    tiers = [F.count(F.when(F.col("tier") == t, 1)).alias(t) for t in ("preserve", "high", "medium", "low")]
    after = done.agg(F.count("*").alias("entries_out"), F.sum(F.length("output")).alias("chars_out"), *tiers)
    saved = F.round(1 - F.col("chars_out") / F.greatest(F.lit(1), F.col("chars_in")), 4)
    return before.crossJoin(after).withColumn("saved", saved)
