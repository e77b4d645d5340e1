"""Definitions, their blocks and scopes by line rules."""

import pytest

from condensa.functions import codecs, kernels, outline
from condensa.operators import symbols
from condensa.sources.entries import EXTENSIONS

# Language, text, definitions as (type, name, line, endLine).
SAMPLES = [
    ("go", "type T struct {\n  x int\n}\nfunc (t *T) Run(a int) error {\n  if a > 0 { return nil }\n  return nil\n}\nfunc main() {\n}\n", [("type", "T", 1, 3), ("method", "Run", 4, 7), ("function", "main", 8, 9)]),
    ("java", 'public class A {\n  public int get(int x) {\n    return "}".length(); // }\n  }\n}\n', [("class", "A", 1, 5), ("method", "get", 2, 4)]),
    ("c", "#define N 3\nstruct P {\n  int x;\n};\nint add(int a, int b) {\n  return a + b;\n}\nint later(int);\n", [("macro", "N", 1, 1), ("struct", "P", 2, 4), ("function", "add", 5, 7)]),
    ("cpp", "namespace n {\nint A::get(int x) {\n  return x;\n}\n}\n", [("namespace", "n", 1, 5), ("method", "A::get", 2, 4)]),
    ("csharp", "namespace N {\n  public class A {\n    public int Get(int x) {\n    }\n  }\n}\n", [("namespace", "N", 1, 6), ("class", "A", 2, 5), ("method", "Get", 3, 4)]),
    ("kotlin", "class A {\n  fun go(): Int {\n  }\n}\nfun String.ext() = 1\n", [("class", "A", 1, 4), ("function", "go", 2, 3), ("function", "ext", 5, 5)]),
    ("php", "class A {\n  public static function go($x) {\n  }\n}\nfunction f() {}\n", [("class", "A", 1, 4), ("method", "go", 2, 3), ("function", "f", 5, 5)]),
    ("rust", "pub struct S {\n}\nimpl S {\n  pub fn go(&self) -> i32 {\n    1\n  }\n}\n", [("class", "S", 1, 2), ("function", "go", 4, 6)]),
    ("bash", 'A=1\nrun() {\n  echo "}" # }\n}\n', [("variable", "A", 1, 1), ("function", "run", 2, 4)]),
    ("typescript", "interface I {\n  x: number;\n}\ntype U = string;\nabstract class C {\n}\n", [("interface", "I", 1, 3), ("type", "U", 4, 4), ("class", "C", 5, 6)]),
    ("proto", "service S {\n  rpc Get (M) returns (M);\n}\n", [("service", "S", 1, 3), ("method", "Get", 2, 2)]),
    ("hcl", 'resource "a" "x" {\n}\nlocals {\n}\n', [("block", "x", 1, 2), ("block", "locals", 3, 4)]),
    ("scss", "$x: 1;\n@mixin m {\n}\n.a {\n}\n", [("variable", "$x", 1, 1), ("mixin", "m", 2, 3), ("selector", ".a", 4, 5)]),
    ("yaml", "a:\n  b: 1\n", [("key", "a", 1, 1), ("key", "b", 2, 2)]),
    ("toml", "[a.b]\nx = 1\n", [("table", "a.b", 1, 1), ("key", "x", 2, 2)]),
    ("dockerfile", "FROM p:3 AS base\nENV A=1\n", [("stage", "base", 1, 1), ("variable", "A", 2, 2)]),
]


@pytest.mark.parametrize("language, text, want", SAMPLES, ids=[x[0] for x in SAMPLES])
def test_definitions(language, text, want):
    assert [(s["type"], s["name"], s["line"], s["endLine"]) for s in codecs.symbols(text, language)] == want


@pytest.mark.parametrize("language", codecs.SUPPORTED)
def test_odd_texts(language):
    for text in ("", "\n", "}}}{{{", "class", '"' * 7, "a" * 20_000, "{" * 5000):
        for s in codecs.symbols(text, language):
            assert 1 <= s["line"] <= s["endLine"] <= text.count("\n") + 1
        codecs.scopes(text, language)


def test_languages_of_extensions_have_rules():
    assert set(EXTENSIONS) <= set(codecs.SUPPORTED)


def test_scopes_by_braces(spark):
    text = "function go(x) {\n  const f = (a) => {\n    return a;\n  };\n  return f(x);\n}\nclass T {\n}\n"
    got = codecs.scopes(text, "javascript")
    assert [(s["scope"], s["name"], s["startLine"], s["endLine"], s["bindings"]) for s in got] == [("module", "", 1, 9, ["T", "go"]), ("function", "go", 1, 6, ["f"]), ("function", "f", 2, 4, []), ("class", "T", 7, 8, [])]
    files = spark.createDataFrame([("a.js", "javascript", text), ("b.md", "markdown", "# x")], "path string, language string, text string")
    lines = spark.createDataFrame([("a.js", 3), ("a.js", 5), ("a.js", 9)], "path string, line long")
    assert [r.scope_name for r in symbols.innermost(lines, symbols.scopes(files)).orderBy("line").collect()] == ["f", "go", ""]


def test_packs(spark):
    packs = outline.load_rules('{"own": [["thing", "^thing (\\\\w+)"]]}')
    files = spark.createDataFrame([("a", "own", "thing x\nother y\n")], "path string, language string, text string")
    assert [(r.type, r.name) for r in symbols.symbols(files, packs).collect()] == [("thing", "x")] and symbols.symbols(files).count() == 0
    with pytest.raises(ValueError, match="no group"):
        outline.load_rules('{"own": [["thing", "^thing"]]}')


def test_long_files_have_a_summary_unless_told(spark):
    files = spark.createDataFrame([("a", "python", "def f():\n  pass\n" + "#" * 300_000)], "path string, language string, text string")
    assert symbols.file_summary(files).first().summary == "1 function" and symbols.file_summary(files, 1000).count() == 0


def test_best_places():
    got = kernels.rank(["red green blue sky", "red green blue sea", "red green blue sky sea", "far off"], 2)
    assert [s for _, s in got.top(4)] == sorted(got.scores, reverse=True) and len(got.top(2)) == 2
