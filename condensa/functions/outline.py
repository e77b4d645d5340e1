"""Definitions of source files by line rules, for languages whose grammars aren't available here.

A rule is a kind and a pattern that a line begins with; the first group is the name. In languages
with braces a definition ends where the first block that it opens does; comments and strings are
passed over. Packs of rules can be read from JSON beside the ones here.
"""

from __future__ import annotations

import bisect
import json
import re

Rules = list[tuple[str, str]]

_EXPORT, _MODIFIERS = r"^\s*(?:export\s+(?:default\s+)?)?", r"^\s*(?:[a-z]+\s+)*"
#: Words before a parenthesis that call or branch and define nothing.
_NO_NAME = r"(?!(?:if|for|while|switch|return|else|do|catch|sizeof|new|case|throw)\b)"
_SCRIPT: Rules = [("function", _EXPORT + r"(?:async\s+)?function\s*\*?\s*(\w+)"), ("class", _EXPORT + r"(?:abstract\s+)?class\s+(\w+)"), ("function", r"^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?(?:function|\([^)]*\)\s*=>|\w+\s*=>)")]
_TYPED: Rules = [*_SCRIPT, ("interface", r"^\s*(?:export\s+)?(?:declare\s+)?interface\s+(\w+)"), ("type", r"^\s*(?:export\s+)?type\s+(\w+)[^=]*="), ("enum", r"^\s*(?:export\s+)?(?:const\s+)?enum\s+(\w+)")]
_C: Rules = [("macro", r"^\s*#\s*define\s+(\w+)"), ("struct", r"^\s*(?:typedef\s+)?(?:struct|union)\s+(\w+)\s*(?:\{|$)"), ("enum", r"^\s*(?:typedef\s+)?enum\s+(?:class\s+)?(\w+)"), ("function", r"^" + _NO_NAME + r"[A-Za-z_][\w\s*&<>,]*?[\s*&](\w+)\s*\([^;]*$")]
_MARKUP: Rules = [("element", r"^\s*<([A-Za-z][\w:.-]*)")]
_STYLE: Rules = [("rule", r"^\s*@(?:media|keyframes|font-face|supports|layer)\s*([^{]*?)\s*\{"), ("selector", r"^\s*([.#&:\w\[*][^{};]*?)\s*\{")]

RULES: dict[str, Rules] = {
    "javascript": _SCRIPT,
    "typescript": _TYPED,
    "tsx": _TYPED,
    "vue": [*_TYPED, *_MARKUP],
    "svelte": [*_TYPED, *_MARKUP],
    "go": [("function", r"^func\s+(\w+)"), ("method", r"^func\s+\([^)]*\)\s*(\w+)"), ("type", r"^type\s+(\w+)")],
    "rust": [("function", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:const\s+|async\s+|unsafe\s+)*fn\s+(\w+)"), ("class", r"^\s*(?:pub(?:\([^)]*\))?\s+)?struct\s+(\w+)"), ("enum", r"^\s*(?:pub(?:\([^)]*\))?\s+)?enum\s+(\w+)"), ("interface", r"^\s*(?:pub(?:\([^)]*\))?\s+)?trait\s+(\w+)"), ("module", r"^\s*(?:pub\s+)?mod\s+(\w+)"), ("macro", r"^\s*macro_rules!\s*(\w+)")],
    "java": [("class", _MODIFIERS + r"(?:class|record)\s+(\w+)"), ("interface", _MODIFIERS + r"interface\s+(\w+)"), ("enum", _MODIFIERS + r"enum\s+(\w+)"), ("method", r"^\s+(?:public|protected|private|static|final|abstract|synchronized)\s+[\w<>\[\], ]+?\s(\w+)\s*\(")],
    "csharp": [("namespace", r"^\s*namespace\s+([\w.]+)"), ("class", _MODIFIERS + r"(?:class|record)\s+(\w+)"), ("struct", _MODIFIERS + r"struct\s+(\w+)"), ("interface", _MODIFIERS + r"interface\s+(\w+)"), ("enum", _MODIFIERS + r"enum\s+(\w+)"), ("method", r"^\s+(?:public|protected|private|internal|static|override|virtual|async)\s+[\w<>\[\],? ]+?\s(\w+)\s*\(")],
    "kotlin": [("function", _MODIFIERS + r"fun\s+(?:<[^>]*>\s*)?(?:\w+\.)?(\w+)"), ("class", _MODIFIERS + r"class\s+(\w+)"), ("interface", _MODIFIERS + r"interface\s+(\w+)"), ("object", _MODIFIERS + r"object\s+(\w+)")],
    "scala": [("function", _MODIFIERS + r"def\s+(\w+)"), ("class", _MODIFIERS + r"class\s+(\w+)"), ("trait", _MODIFIERS + r"trait\s+(\w+)"), ("object", _MODIFIERS + r"object\s+(\w+)")],
    "swift": [("function", _MODIFIERS + r"func\s+(\w+)"), ("class", _MODIFIERS + r"(?:class|actor)\s+(\w+)"), ("struct", _MODIFIERS + r"struct\s+(\w+)"), ("enum", _MODIFIERS + r"enum\s+(\w+)"), ("protocol", _MODIFIERS + r"protocol\s+(\w+)"), ("extension", _MODIFIERS + r"extension\s+([\w.]+)")],
    "php": [("class", _MODIFIERS + r"class\s+(\w+)"), ("interface", r"^\s*interface\s+(\w+)"), ("trait", r"^\s*trait\s+(\w+)"), ("method", r"^\s+(?:(?:public|protected|private|static|final|abstract)\s+)+function\s+&?(\w+)"), ("function", r"^\s*function\s+&?(\w+)")],
    "c": _C,
    "cpp": [("namespace", r"^\s*namespace\s+([\w:]+)"), ("class", r"^\s*(?:template\s*<[^>]*>\s*)?class\s+(\w+)\s*[^;]*$"), *_C[:3], ("method", r"^" + _NO_NAME + r"[\w\s*&<>,:]*?(\w+::~?\w+)\s*\([^;]*$"), _C[3]],
    "ruby": [("method", r"^\s*def\s+(?:self\.)?(\w+[?!]?)"), ("class", r"^\s*class\s+(\w+)"), ("module", r"^\s*module\s+(\w+)")],
    "bash": [("function", r"^\s*function\s+([\w:-]+)"), ("function", r"^\s*([\w:-]+)\s*\(\)"), ("variable", r"^(?:export\s+|readonly\s+)?(\w+)=")],
    "lua": [("function", r"^\s*(?:local\s+)?function\s+([\w.:]+)"), ("variable", r"^local\s+(\w+)\s*=")],
    "perl": [("function", r"^\s*sub\s+(\w+)"), ("package", r"^\s*package\s+([\w:]+)")],
    "r": [("function", r"^\s*([\w.]+)\s*(?:<-|=)\s*function\b")],
    "dart": [("class", _MODIFIERS + r"class\s+(\w+)"), ("enum", r"^\s*enum\s+(\w+)"), ("function", r"^\s*" + _NO_NAME + r"[\w<>?]+\s+(\w+)\s*\([^;]*$")],
    "elixir": [("module", r"^\s*defmodule\s+([\w.]+)"), ("function", r"^\s*defp?\s+(\w+[?!]?)")],
    "haskell": [("type", r"^(?:data|newtype|type)\s+(\w+)"), ("class", r"^class\s+(?:.*=>\s*)?(\w+)"), ("function", r"^(\w+)\s*::")],
    "ocaml": [("function", r"^\s*let\s+(?:rec\s+)?(\w+)"), ("module", r"^\s*module\s+(\w+)"), ("type", r"^\s*type\s+(\w+)")],
    "zig": [("function", r"^\s*(?:pub\s+)?fn\s+(\w+)"), ("struct", r"^\s*(?:pub\s+)?const\s+(\w+)\s*=\s*(?:packed\s+)?struct")],
    "sql": [("table", r"(?i)^\s*create\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+)?table\s+(?:if\s+not\s+exists\s+)?([\w.]+)"), ("view", r"(?i)^\s*create\s+(?:or\s+replace\s+)?(?:materialized\s+)?view\s+([\w.]+)"), ("function", r"(?i)^\s*create\s+(?:or\s+replace\s+)?(?:function|procedure)\s+([\w.]+)"), ("index", r"(?i)^\s*create\s+(?:unique\s+)?index\s+(?:if\s+not\s+exists\s+)?([\w.]+)")],
    "graphql": [("type", r"^\s*(?:extend\s+)?(?:type|input|union|scalar)\s+(\w+)"), ("interface", r"^\s*interface\s+(\w+)"), ("enum", r"^\s*enum\s+(\w+)"), ("operation", r"^\s*(?:query|mutation|subscription|fragment)\s+(\w+)")],
    "proto": [("message", r"^\s*message\s+(\w+)"), ("enum", r"^\s*enum\s+(\w+)"), ("service", r"^\s*service\s+(\w+)"), ("method", r"^\s*rpc\s+(\w+)")],
    "prisma": [("model", r"^\s*model\s+(\w+)"), ("enum", r"^\s*enum\s+(\w+)"), ("block", r"^\s*(?:datasource|generator)\s+(\w+)")],
    "hcl": [("block", r'^\s*\w+\s+"[^"]*"\s+"([^"]+)"\s*\{'), ("block", r'^\s*\w+\s+"([^"]+)"\s*\{'), ("block", r"^(\w+)\s*\{")],
    "nix": [("attribute", r"^\s*([\w.'-]+)\s*=")],
    "dockerfile": [("stage", r"(?i)^\s*from\s+\S+\s+as\s+(\S+)"), ("image", r"(?i)^\s*from\s+(\S+)"), ("variable", r"(?i)^\s*(?:arg|env)\s+(\w+)")],
    "css": _STYLE,
    "scss": [("mixin", r"^\s*@mixin\s+([\w-]+)"), ("function", r"^\s*@function\s+([\w-]+)"), ("variable", r"^\s*(\$[\w-]+)\s*:"), *_STYLE],
    "html": _MARKUP,
    "xml": _MARKUP,
    "markdown": [("heading", r"^#{1,6}\s+(.+?)\s*#*$")],
    "json": [("key", r'^\s*"([^"]+)"\s*:')],
    "yaml": [("key", r"^\s*(?:-\s+)?([\w.$/-]+)\s*:(?:\s|$)")],
    "toml": [("table", r"^\s*\[\[?\s*([^\]]+?)\s*\]\]?"), ("key", r"^\s*([\w.-]+)\s*=")],
    "ini": [("table", r"^\s*\[\s*([^\]]+?)\s*\]"), ("key", r"^\s*([\w.-]+)\s*=")],
    "query": [("capture", r".*?(@[\w.]+)")],
    "regex": [("group", r".*?\(\?P?<([A-Za-z_]\w*)>")],
}
#: Languages whose definitions hold blocks in braces.
BRACES = frozenset("javascript typescript tsx vue svelte go rust java csharp kotlin scala swift php c cpp dart zig graphql proto prisma hcl css scss perl bash".split())
#: Kinds whose block is a scope of names, and the scope's kind.
SCOPES = {**dict.fromkeys(("function", "method"), "function"), **dict.fromkeys(("class", "struct", "interface", "trait", "object", "enum", "protocol", "extension"), "class"), **dict.fromkeys(("module", "namespace"), "module")}
_HASHED = frozenset(("bash", "perl", "hcl", "prisma", "graphql", "php"))
_SKIPPED = r"""/\*.*?\*/|//[^\n]*|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`"""
_TOKEN, _TOKEN_HASHED = (re.compile(rf"(?s){x}|([{{}};])") for x in (_SKIPPED, _SKIPPED + r"|(?:(?<=\s)|^)#[^\n]*"))


def load_rules(text: str) -> dict[str, Rules]:
    """A pack from JSON: a language's list of [kind, pattern]. Patterns must compile and have a group."""
    out = {}
    for language, rules in json.loads(text).items():
        out[language] = [(kind, pattern) for kind, pattern in rules]
        for kind, pattern in out[language]:
            if re.compile(pattern).groups < 1:
                raise ValueError(f"the pattern of {language} {kind} has no group for the name")
    return out


def _ends(source: str, language: str, starts: list[int]) -> list[int | None]:
    """For each place in the text the place where the first block opened after it ends; none where a statement ends before."""
    if language not in BRACES:
        return [None] * len(starts)
    at, closes, stack, semicolon = [], [], [], []
    for m in (_TOKEN_HASHED if language in _HASHED else _TOKEN).finditer(source):
        if m[1] == "}":
            if stack:
                closes[stack.pop()] = m.start()
        elif m[1]:
            if m[1] == "{":
                stack.append(len(at))
            at.append(m.start())
            closes.append(None)
            semicolon.append(m[1] == ";")
    out: list[int | None] = []
    for k, start in enumerate(starts):
        i = bisect.bisect_left(at, start)
        # The block must open before the next definition does.
        opened = i < len(at) and not semicolon[i] and (k + 1 == len(starts) or at[i] < starts[k + 1])
        out.append(closes[i] if opened else None)
    return out


def definitions(source: str, language: str, rules: Rules) -> list[dict]:
    """Definitions in order of lines, with 1-based lines, a line's first rule that fits."""
    patterns = [(kind, re.compile(pattern)) for kind, pattern in rules]
    found, starts, place = [], [], 0
    for n, line in enumerate(source.split("\n"), 1):
        for kind, pattern in patterns:
            if (m := pattern.match(line)) and m[1]:
                found.append({"name": m[1], "kind": "def", "type": kind, "line": n, "endLine": n, "column": m.start(1)})
                starts.append(place + m.start(1))
                break
        place += len(line) + 1
    breaks = [i for i, c in enumerate(source) if c == "\n"] if language in BRACES and found else []
    for symbol, end in zip(found, _ends(source, language, starts)):
        if end is not None:
            symbol["endLine"] = bisect.bisect_left(breaks, end) + 1
    return found


def scopes(source: str, language: str) -> list[dict]:
    """The file and the blocks of its definitions, each with the names that are defined right inside it; for languages with braces."""
    out = [{"scope": "module", "name": "", "startLine": 1, "endLine": source.count("\n") + 1, "bindings": set()}]
    open_: list[dict] = [out[0]]
    for s in definitions(source, language, RULES[language]):
        while len(open_) > 1 and open_[-1]["endLine"] < s["line"]:
            open_.pop()
        open_[-1]["bindings"].add(s["name"])
        if s["type"] in SCOPES and s["endLine"] > s["line"]:
            out.append({"scope": SCOPES[s["type"]], "name": s["name"], "startLine": s["line"], "endLine": s["endLine"], "bindings": set()})
            open_.append(out[-1])
    return [{**s, "bindings": sorted(s["bindings"])} for s in out]
