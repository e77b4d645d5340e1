import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from condensa.functions import codecs, kernels, text

LOG = "\n".join(f"2024-01-01 10:00:{i % 60:02d} {('INFO ok', 'WARN request timeout', 'ERROR failed to connect')[i % 3]} item" for i in range(60))
TEXTS = ["", "a" * 26, "short", "x" * 1000, "key: value " + "y" * 900, "z" * 900 + " fatal error", "line\n" * 300, LOG, '{"a": 1}', "import os\nfrom a import b\ndef f():\n  pass\n" * 20, "Traceback (most recent call last):\n  File \"a.py\"\n" * 30, "é" * 700]


def rows(spark, column):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i long, text string")
    return [r.x for r in df.orderBy("i").select(column.alias("x")).collect()]


@pytest.mark.parametrize("budget", [5, 27, 28, 100, 400])
def test_truncation_equals_the_kernel(spark, budget):
    assert rows(spark, text.truncated("text", budget)) == [codecs.truncate(t, budget) for t in TEXTS]


def test_detectors_equal_the_kernels(spark):
    assert rows(spark, text.is_source("text")) == [codecs.is_source(t) for t in TEXTS]
    assert rows(spark, text.is_stack("text")) == [codecs.is_stack(t) for t in TEXTS]
    assert rows(spark, text.is_json("text")) == [codecs.is_json(t) for t in TEXTS]
    assert rows(spark, text.is_log("text")) == [codecs.is_log(t) for t in TEXTS]


def test_normal_forms(spark):
    values = ["at 2024-01-02T03:04:05.678Z from 10.0.0.1", "id 123e4567-e89b-12d3-a456-426614174000", "n 1234567890123 m 123456789", "k " + "Ab1+/" * 6 + " end", "plain"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r.x for r in df.select(text.normalized("v").alias("x")).collect()]
    assert got == ["at <TS> from <IP>", "id <UUID>", "n <NUM> m 123456789", got[3], "plain"]
    assert "<B64>" in got[3]
    assert got == [codecs.normalized(v) for v in values]


def test_token_estimates(spark):
    values = ["", "abc", "a" * 41, "[1, 2, 3]", '{"a": 1}', 'q"uo\\te\n', "été", "\u0007bell", "😀"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v string").orderBy("i")
    got = df.select(text.token_estimate("v").alias("a"), text.string_token_estimate("v").alias("b")).collect()
    for v, r in zip(values, got):
        assert r.a == max(1, len(v) // (2 if v[:1] in ("{", "[") and v else 4))
        assert r.b == max(1, len(json.dumps(v)) // 4)


def test_sigmoid_values(spark):
    got = spark.range(1).select(text.rational_sigmoid(F.lit(0.0)).alias("a"), text.rational_sigmoid(F.lit(1.0)).alias("b")).first()
    assert got.a == 0.25 and abs(got.b - 19 / 61) < 1e-12
    assert kernels.rational(100) == kernels.rational(8)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab:\n error", max_size=400), st.integers(0, 200))
def test_truncation_fits(value, budget):
    out = codecs.truncate(value, budget)
    assert len(out) <= max(budget, 0) or len(value) <= budget


@settings(max_examples=60, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=30), lambda c: st.lists(c, max_size=8) | st.dictionaries(st.text(max_size=6), c, max_size=6), max_leaves=30), st.integers(1, 400))
def test_json_codec_never_fails(value, budget):
    assert isinstance(codecs.compress_json(value, budget), str)


def test_json_codec_forms():
    assert codecs.compress_json([], 100) == "[]"
    assert codecs.compress_json(list(range(8)), 300) == '[0, "... (7 more similar items)"]'
    assert codecs.compress_json({"b": 1, "name": 2}, 300) == '{\n  "name": 2,\n  "b": 1\n}'
    assert codecs.compress_json(5, 0) == '"...(int at depth 0)"'


def test_stack_codec_keeps_headers_first():
    trace = "Traceback (most recent call last):\n" + "\n".join(f'  File "/site-packages/x{i}.py", line {i}' for i in range(30)) + "\nValueError: exception here"
    out = codecs.compress_stack(trace, 120)
    assert "ValueError: exception here" in out and out.endswith("frames omitted]")


def test_log_codec():
    out = codecs.compress_log(LOG, 200)
    assert "ERROR failed" in out and "[repeated 20 times]" in out and "log lines omitted" in out


@pytest.mark.parametrize("budget", [120, 300, 600])
def test_source_codecs_fit(budget):
    source = open(codecs.__file__, encoding="utf-8").read()[:4000]
    blocks = [{"startLine": s["line"] - 1, "endLine": s["endLine"] - 1, "name": s["name"], "type": s["type"]} for s in codecs.symbols(open(kernels.__file__, encoding="utf-8").read(), "python") if s["type"] in ("function", "class")]
    assert len(codecs.compress_source(source, budget)) <= budget
    assert len(codecs.compress_source_structured(open(kernels.__file__, encoding="utf-8").read(), budget, blocks)) <= budget


def test_structured_codec_prefers_anchors_and_public_names():
    body = "\n".join(f"    step_{i}()" for i in range(30))
    source = f"import os\n\ndef run():\n{body}\n    return total\n\ndef _hidden():\n{body}\n"
    blocks = [{"startLine": 2, "endLine": 33, "name": "run", "type": "function", "anchors": [{"startLine": 33, "endLine": 33, "kind": "return", "priority": 9}]}, {"startLine": 35, "endLine": 65, "name": "_hidden", "type": "function"}]
    out = codecs.compress_source_structured(source, 160, blocks)
    assert "return total" in out and "def run():  # L3" in out and len(out) <= 160


def test_preserved_short_text():
    assert codecs.compress_string("abc", 3) == "abc"
