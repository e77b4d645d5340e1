"""Queries over the driver's tables, one for each operator, each over whole tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs, text
from ..operators import budget, dedup, fold, graph, index, logs, routing, scoring, stats, symbols
from ..runtime import cut, ranked, shared_dir
from ..sources import entries
from ..streaming import session_dedup
from . import compress as program

QUERY = "the and of tion with the reading"
BUDGET = 50_000


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _round(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _scored(spark, d) -> DataFrame:
    """Documents with two plain scores."""
    own = _t(spark, d, "documents")
    return own.select("doc_id", (F.col("n_chars") / 100_000.0).alias("own"), ((F.col("doc_id") * 37 % 101) / 101.0).alias("relevance"), F.length("text").alias("chars"))


def token_estimate(spark, d):
    return _t(spark, d, "documents").select("doc_id", text.token_estimate("text").alias("tokens"), text.string_token_estimate("text").alias("json_tokens"))


def dedup_status(spark, d):
    own = entries.from_strings(_t(spark, d, "documents"), "doc_id", "text")
    return dedup.classify(own).select(F.col("idx").alias("doc_id"), "status")


def dedup_stats(spark, d):
    own = entries.from_strings(_t(spark, d, "documents"), "doc_id", "text")
    return dedup.dedup_stats(dedup.classify(own))


def near_dedup_records(spark, d):
    own = entries.from_table(_t(spark, d, "events"), "event_id")
    return dedup.classify(own).select(F.col("idx").alias("event_id"), "status")


def _records(spark, d) -> DataFrame:
    own = _t(spark, d, "labels")
    s = lambda c: F.col(c).cast("string")
    two = F.create_map(F.lit("doc_id"), s("doc_id"), F.lit("quality"), s("quality"))
    three = F.create_map(F.lit("doc_id"), s("doc_id"), F.lit("quality"), s("quality"), F.lit("toxic"), s("toxic"))
    return own.select(F.col("doc_id").alias("idx"), F.when(F.col("doc_id") % 3 == 0, two).otherwise(three).alias("fields"))


def schema_groups(spark, d):
    return dedup.schema_groups(_records(spark, d))


def template_detect(spark, d):
    return dedup.templates(_records(spark, d))


def template_collapse(spark, d):
    own = _records(spark, d)
    spans = cut(dedup.templates(own))
    return dedup.collapse(own.select("idx", F.lit("dict").alias("etype")), spans).select("idx", "removed", "template_count")


def postings_tf(spark, d):
    return index.postings_of(_t(spark, d, "documents"), "doc_id", "text")


def _index(spark, d) -> index.Index:
    return index.build(_t(spark, d, "documents"), "doc_id", "text")


def term_stats(spark, d):
    return _round(_index(spark, d).terms.select("term", "df", "cf", "idf", "info", "gamma", "eidf"), "idf", "info", "gamma", "eidf")


def index_stats(spark, d):
    return _index(spark, d).stats()


def index_update(spark, d):
    """The terms of an index from which toxic documents went and to which the benchmark came."""
    gone = _t(spark, d, "labels").filter("toxic = 1").select("doc_id")
    new = _t(spark, d, "benchmark").select((-1 - F.col("item_id")).alias("doc_id"), "text")
    own = index.update(_index(spark, d), "doc_id", "text", new, gone)
    return _round(own.terms.select("term", "df", "cf", "idf", "info", "eidf"), "idf", "info", "eidf")


def _asked(spark) -> DataFrame:
    return spark.createDataFrame([(0, QUERY)], "q long, t string")


def search_topk(spark, d):
    return _round(_index(spark, d).search(_asked(spark), "q", "t", 10).select("doc", "rank", "score"), "score")


def search_normalized(spark, d):
    return _round(_index(spark, d).search(_asked(spark), "q", "t", 10, normalize=True).select("doc", "rank", "score"), "score")


def search_batch(spark, d):
    asked = _t(spark, d, "benchmark").select("item_id", "text")
    return _round(_index(spark, d).search(asked, "item_id", "text", 10), "score")


def keywords(spark, d):
    return _round(index.keywords(_index(spark, d)), "weight")


def _small(spark, d) -> index.Index:
    return index.build(_t(spark, d, "benchmark"), "item_id", "text")


def sim_edges(spark, d):
    return _round(graph.edges(_small(spark, d)), "sim")


def degree_centrality(spark, d):
    own = _small(spark, d)
    return _round(graph.degrees(graph.edges(own), own.docs), "degree")


def position_prior(spark, d):
    own = _small(spark, d)
    return _round(graph.prior(graph.degrees(graph.edges(own), own.docs)), "prior")


def query_biased_prior(spark, d):
    own = _small(spark, d)
    return _round(graph.query_bias(own, graph.prior(graph.degrees(graph.edges(own), own.docs)), QUERY), "prior")


def pagerank_fixed(spark, d):
    own = _small(spark, d)
    links = cut(graph.edges(own))
    return _round(graph.page_rank(links, graph.prior(graph.degrees(links, own.docs)), rounds=12, epsilon=None), "rank")


def rank_conversations(spark, d):
    return _round(graph.rank_groups(_t(spark, d, "conversations"), "conv_id", "turn", "text", 2), "score")


def summarize_docs(spark, d):
    return graph.summarize(_t(spark, d, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("doc"), "text"), "doc", "text")


def sentence_segments(spark, d):
    return graph.segment(_t(spark, d, "documents"), "doc_id", "text")


def gini(spark, d):
    return _round(stats.gini(_t(spark, d, "events"), "value"), "gini")


def pearson(spark, d):
    return _round(stats.pearson(_t(spark, d, "events"), "value", "user_id"), "r")


def upper_median_mad(spark, d):
    return _round(stats.upper_median_mad(_t(spark, d, "events"), "value"), "median", "mad")


def hub_capped(spark, d):
    return _round(stats.hub_capped(_t(spark, d, "events").select("event_id", "value"), "value").select("event_id", "capped"), "capped")


def kneedle(spark, d):
    return stats.kneedle(_t(spark, d, "events"), "value")


def tier_cuts(spark, d):
    return _round(stats.cut_points(_t(spark, d, "events"), "value"), "p75", "p25")


def core_select(spark, d):
    return scoring.core(_scored(spark, d), "doc_id", "own").select("doc_id", "core_rank", "is_core")


def blended_scores(spark, d):
    return _round(scoring.blend(_scored(spark, d), "own", "relevance").select("doc_id", "final"), "final")


def tier_assign(spark, d):
    return scoring.tiers(_scored(spark, d), "own").select("doc_id", "tier")


def budget_allocate(spark, d):
    own = scoring.tiers(_scored(spark, d), "relevance").withColumn("tier", F.when(F.col("doc_id") % 50 == 0, "preserve").otherwise(F.col("tier")))
    own = own.select("doc_id", F.greatest(F.lit(1), F.floor(F.col("chars") / 4)).alias("tokens"), F.col("relevance").alias("score"), "tier")
    return budget.allocate(own, 10 * BUDGET).select("doc_id", "tier", "tier_budget", "entry_budget")


def auto_budget(spark, d):
    return budget.auto_budget(_t(spark, d, "documents").select(text.token_estimate("text").alias("tokens")), "tokens")


def truncate_adaptive(spark, d):
    return _t(spark, d, "pages").select("page_id", text.truncated("html", 400).alias("cut"))


def content_type(spark, d):
    own = _t(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text")
    return own.union(_t(spark, d, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")), "html")).select("id", text.content_type("text").alias("kind"))


def _log_lines(spark, d) -> DataFrame:
    """A log a user: time, severity and value of each event."""
    own = _t(spark, d, "events")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("INFO request done", "WARN request timeout", "ERROR request failed", "INFO cache hit")]), (F.col("event_id") % 4 + 1).cast("int"))
    line = F.concat_ws(" ", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), kind, F.col("event_type"))
    return own.select(F.col("user_id").alias("log"), F.col("event_id").alias("n"), line.alias("line"))


def log_template_counts(spark, d):
    return logs.template_counts(_log_lines(spark, d))


def log_severity(spark, d):
    return _log_lines(spark, d).groupBy(logs.severity(F.col("line")).alias("severity")).agg(F.count("*").alias("lines"))


def log_compress(spark, d):
    return logs.compress(_log_lines(spark, d), 300)


def fold_arrays(spark, d):
    own = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return fold.fold_groups(own, "l_orderkey", "l_linenumber", "l_partkey", 4)


def _fields(spark, d) -> DataFrame:
    own = _t(spark, d, "events")
    paths = {"payload.output": "props", "payload.status": "event_type", "reasoning": "event_type", "log.stderr": "props"}
    pairs = F.array(*[F.struct(F.lit(p).alias("path"), F.col(c).alias("value")) for p, c in paths.items()])
    return own.select("event_id", F.explode(pairs).alias("f")).select("event_id", "f.path", "f.value")


def route_fields(spark, d):
    own = _fields(spark, d)
    action = routing.route(F.col("path"), F.col("value"), F.lit(True), routing.preset("codex_logs"))
    return own.select("event_id", "path", action.alias("action"))


def preset_actions(spark, d):
    own = _t(spark, d, "pages")
    return own.select("page_id", *[routing.route(F.lit("body.html"), F.col("html"), F.lit(True), routing.preset(p)).alias(p) for p in sorted(routing.PRESETS)])


def stack_select(spark, d):
    trace = "Traceback (most recent call last):\n" + "\n".join(f'  File "/app/m{i}.py", line {i}, in f{i}\n    call{i}()' for i in range(20)) + '\n  File "/x/site-packages/lib.py", line 1, in g\nValueError: error: bad'
    return spark.createDataFrame([(b, codecs.compress_stack(trace, b)) for b in (120, 400, 900)], "budget long, out string")


def json_compress(spark, d):
    own = _t(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("results"))
    bodies = own.select("conv_id", F.to_json(F.struct(F.lit("ok").alias("status"), "results")).alias("body"))

    @F.pandas_udf("string")
    def run(x):
        return x.map(lambda b: codecs.compress_json(json.loads(b), 400))

    return bodies.select("conv_id", run("body").alias("out"))


def _sources(spark, d) -> DataFrame:
    """A source file a user, in one of three languages, with a definition for each of the user's events: (path, language, n, text)."""
    own = _t(spark, d, "events").groupBy("user_id").agg(F.count("*").cast("long").alias("n"), F.sort_array(F.collect_list("event_id")).alias("ids"))

    def file(ending: str, head: str, part: str, tail: str):
        """Text with the user's name in the head and tail, and each event's in its part."""
        parts = F.array_join(F.transform("ids", lambda e: F.replace(F.lit(part), F.lit("{}"), e.cast("string"))), "")
        whole = F.concat(F.replace(F.lit(head), F.lit("{}"), F.col("user_id").cast("string")), parts, F.replace(F.lit(tail), F.lit("{}"), F.col("user_id").cast("string")))
        return F.struct(F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(ending)).alias("path"), whole.alias("text"))

    python = file(".py", "import os\n\n\nclass User{}:\n", "    def e{}(self, x):\n        y = x\n        return y\n", "\n\ndef main():\n    return User{}()\n")
    script = file(".js", "export class User{} { }\n", "function e{}(x) {\n  return x;\n}\n", "")
    notes = file(".md", "# User {}\n", "## {}\n```python\nx = 1\n```\n", "")
    kind = F.col("user_id") % 3
    return own.select("n", F.when(kind == 0, python).when(kind == 1, script).otherwise(notes).alias("f")).select("f.path", entries.language_of(F.col("f.path")).alias("language"), "n", "f.text")


def stack_select(spark, d):
    """A trace a user, whose frames are the user's events, in 600 characters."""
    frame = lambda e: F.format_string('  File "%s/m%d.py", line %d, in f%d\n    call()', F.when(e % 4 == 0, "/x/site-packages").otherwise("/app"), e % 50, e, e)
    own = _t(spark, d, "events").groupBy("user_id").agg(F.sort_array(F.collect_list("event_id")).alias("ids"))
    trace = F.concat(F.lit("Traceback (most recent call last):\n"), F.array_join(F.transform("ids", frame), "\n"), F.lit("\nValueError: error: bad"))

    @F.pandas_udf("string")
    def run(x):
        return x.map(lambda t: codecs.compress_stack(t, 600))

    return own.select("user_id", run(trace).alias("out"))


def source_compress(spark, d):
    @F.pandas_udf("string")
    def run(x):
        return x.map(lambda t: codecs.compress_source(t, 400, "main"))

    return _sources(spark, d).select("path", run("text").alias("out"))


def source_structured(spark, d):
    own = symbols.outlines(_sources(spark, d)).filter("structure IS NOT NULL")

    @F.pandas_udf("string")
    def run(t, s):
        import pandas as pd

        return pd.Series([codecs.compress_source_structured(a, 300, [dict(x) for x in b]) for a, b in zip(t, s)])

    return own.select("path", run("text", "structure").alias("out"))


def symbols_defs(spark, d):
    return symbols.definitions(symbols.symbols(_sources(spark, d))).select("path", "name", "type", "line")


def symbol_summary(spark, d):
    return symbols.file_summary(_sources(spark, d))


def scope_bindings(spark, d):
    own = _sources(spark, d)
    lines = symbols.symbols(own).select("path", "line", "name")
    return symbols.innermost(lines, symbols.scopes(own)).select("path", "line", "name", "scope", "scope_name")


def code_injections(spark, d):
    """Code that stands in Markdown files."""
    return symbols.injections(_sources(spark, d)).select("path", "embedded", "startLine", "endLine")


def syntax_check(spark, d):
    """Files to which a line that no parser takes was added where the number of events is even."""
    broken = F.concat("text", F.when(F.col("n") % 2 == 0, "def (:\n").otherwise(""))
    return symbols.syntax_errors(_sources(spark, d).withColumn("text", broken)).select("path", "line")


def language_map(spark, d):
    own = _t(spark, d, "pages").select("page_id", F.concat(F.lit("f"), F.col("page_id").cast("string"), F.element_at(F.array(*[F.lit(x) for x in (".PY", ".ts", ".rs", ".none", "")]), (F.col("page_id") % 5 + 1).cast("int"))).alias("path"))
    return own.select("page_id", entries.language_of(F.col("path")).alias("language"))


def stream_dedup(spark, d):
    """Each conversation's texts once, from a stream over the files that ends when all are read."""
    import uuid

    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    batch = _t(spark, d, "conversations")
    # A stream reads folders; the file's own folder holds other tables too.
    batch.select("conv_id", "turn", "text").write.parquet(f"{at}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{at}/in").schema).parquet(f"{at}/in")
    own = session_dedup.dedup(stream, "conv_id", "text")
    query = own.writeStream.format("parquet").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start(f"{at}/out")
    query.awaitTermination()
    return spark.read.parquet(f"{at}/out").select("conv_id", "text")


def event_rollup(spark, d):
    """Tiers of users by how often they come, with rank and share: the aggregates, windows and joins that reports use."""
    own = _t(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("total"))
    return ranked(own.withColumn("_down", -F.col("events")), "_down", "user_id").select("user_id", "events", "total", "rank")


def compress_documents(spark, d):
    own = entries.from_strings(_t(spark, d, "documents"), "doc_id", "text")
    return program.compress(own, BUDGET, program.Options(query=QUERY))


def compress_records(spark, d):
    own = entries.from_table(_t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice"), "o_orderkey")
    return program.compress(own, BUDGET)


QUERIES = {
    f.__name__: f
    for f in (
        search_topk, search_batch, search_normalized, postings_tf, term_stats, index_stats, index_update, keywords, token_estimate, dedup_status, dedup_stats, near_dedup_records,
        schema_groups, template_detect, template_collapse, sim_edges, degree_centrality, position_prior, query_biased_prior, pagerank_fixed, rank_conversations,
        summarize_docs, sentence_segments, gini, pearson, upper_median_mad, hub_capped, kneedle, tier_cuts, core_select, blended_scores, tier_assign, budget_allocate,
        auto_budget, truncate_adaptive, content_type, log_template_counts, log_severity, log_compress, fold_arrays, route_fields, preset_actions, stack_select,
        json_compress, source_compress, source_structured, symbols_defs, symbol_summary, scope_bindings, code_injections, syntax_check, language_map, stream_dedup, event_rollup,
        compress_documents, compress_records,
    )
}
