"""Text functions as column expressions: words, sizes, normal forms, content types, truncation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of volatile parts and what stands for them, in the order they apply.
NORMALIZERS = (
    (r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?", "<TS>"),
    (r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "<UUID>"),
    (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "<IP>"),
    (r"\b\d{10,}\b", "<NUM>"),
    (r"\b[A-Za-z0-9+/]{20,}={0,2}\b", "<B64>"),
)
#: Words that mark an error.
ERROR_KEYWORDS = ("error", "fatal", "critical", "exception", "traceback", "caused by", "failed", "killed", "oom", "panic", "crash", "abort")
#: Words that make a line with a severity one of medium weight.
MEDIUM_KEYWORDS = ("warn", "timeout", "retry", "refused", "denied")
#: Patterns of content types.
STACK = r'(?m)(Traceback|Exception|Error|Caused by:|^\s+at\s+|^\s+File\s+")'
SEVERITY = r"(?i)\b(DEBUG|INFO|WARN(?:ING)?|ERROR|FATAL|CRITICAL)\b"
TIMESTAMP_LINE = r"^\d{4}[-/]\d{2}[-/]\d{2}[T ]\d{2}:\d{2}"
DEFINITION = (
    r"^(?:(?:async\s+)?def\s+\w+|class\s+\w+|(?:export\s+(?:default\s+)?)?(?:async\s+)?function\s+\w+|(?:export\s+)?class\s+\w+"
    r"|(?:export\s+)?(?:interface|type|enum)\s+\w+|(?:export\s+)?(?:const|let|var)\s+\w+\s*=\s*(?:async\s+)?(?:function|\())"
)
MARKER = "\n...[content truncated]...\n"
MARKER_LENGTH = 27


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(text) -> Column:
    """Lower-cased runs of letters, digits and underscores of any script."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def rational_sigmoid(x: Column) -> Column:
    """(x^3 + 6x + 12) / (x^3 + 12x + 48) of x kept within 8: a quarter at 0."""
    x = F.greatest(F.lit(-8.0), F.least(F.lit(8.0), x))
    cube = x * x * x
    return (cube + 6 * x + 12) / (cube + 12 * x + 48)


def token_estimate(text) -> Column:
    """Half the characters of what looks like JSON, a quarter of other text; at least 1."""
    text = _col(text)
    share = F.when(text.startswith("{") | text.startswith("["), 2).otherwise(4)
    return F.greatest(F.lit(1), F.floor(F.length(text) / share)).cast("long")


def string_token_estimate(text, ascii_escape: bool = True) -> Column:
    """Estimate of a string as a JSON value: quotes and escapes count, and with ``ascii_escape`` other characters are written as \\uXXXX."""
    text = _col(text)
    # What counts is rare, so taking it out costs little more than a look.
    count = lambda p: F.length(text) - F.length(F.regexp_replace(text, p, ""))
    size = F.length(text) + 2 + count(r'["\\\n\r\t\x08\x0c]+') + 5 * count(r"[\x00-\x07\x0b\x0e-\x1f]+")
    if ascii_escape:
        size = size + 5 * count(r"[^\x00-\x7e]+") + F.when(F.octet_length(text) > F.length(text), 6 * count(r"[\x{10000}-\x{10ffff}]+")).otherwise(0)
    return F.greatest(F.lit(1), F.floor(size / 4)).cast("long")


def normalized(text) -> Column:
    """Text with its volatile parts masked."""
    out = _col(text)
    for pattern, token in NORMALIZERS:
        out = F.regexp_replace(out, pattern, token)
    return out


def canonical_json(text) -> Column:
    """JSON text with sorted keys and no spaces; null where it can't be read."""
    return F.to_json(F.try_parse_json(_col(text)))


def stripped(text) -> Column:
    return F.regexp_replace(_col(text), r"(?U)^\s+|\s+$", "")


def is_stack(text) -> Column:
    return F.substring(_col(text), 1, 2000).rlike(STACK)


def is_json(text) -> Column:
    inner = stripped(text)
    return (inner.startswith("{") | inner.startswith("[")) & (F.length(inner) > 2)


def is_log(text) -> Column:
    """Three timestamps or severities among the first twenty lines and the rest, which is one more."""
    lines = F.split(_col(text), "\n", 21)
    count = lambda p: F.size(F.filter(lines, lambda x: x.rlike(p)))
    return (count(TIMESTAMP_LINE) >= 3) | (count(SEVERITY) >= 3)


def source_score(text) -> Column:
    """Points of what a source file's first fifty lines (and the rest, one more) hold."""

    def points(line: Column) -> Column:
        own = stripped(line)
        known = F.when(own.rlike(r"^(?:import |from )"), 2).when(own.rlike(DEFINITION), 3).when(own.rlike(r"^(?:export |require\()"), 2)
        known = known.when(own.rlike(r'^(?:const|let|var) |^"""' + "|^'''"), 1).otherwise(0)
        return F.when((own == "") | own.startswith("#"), 0).otherwise(known)

    return F.aggregate(F.transform(F.split(_col(text), "\n", 51), points), F.lit(0), lambda a, x: a + x)


def is_source(text) -> Column:
    return source_score(text) >= 5


def content_type(text) -> Column:
    """Which codec a string gets: source, stack, json, log or text."""
    return F.when(is_source(text), "source").when(is_stack(text), "stack").when(is_json(text) & F.try_parse_json(_col(text)).isNotNull(), "json").when(is_log(text), "log").otherwise("text")


def truncated(text, budget: int | Column) -> Column:
    """Head and tail of a text over ``budget`` characters: more tail if that names an error, more head if the start looks like a key."""
    text, budget = _col(text), budget if isinstance(budget, Column) else F.lit(budget)
    n = F.length(text)
    usable = budget - MARKER_LENGTH
    tail_part = F.lower(F.substring(text, F.floor(n * F.lit(0.8)).cast("int") + 1, n))
    in_error = tail_part.rlike("|".join(ERROR_KEYWORDS))
    first = F.substring(text, F.lit(1), F.greatest(F.lit(1), F.floor(n / 10).cast("int")))
    newlines = F.length(first) - F.length(F.replace(first, F.lit("\n"), F.lit("")))
    ratio = F.when(in_error, 0.4).when((newlines < 3) & F.contains(first, F.lit(":")), 0.8).otherwise(0.5)
    head = F.floor(usable * ratio).cast("int")
    tail = (usable - head).cast("int")
    cut = F.concat(F.substring(text, F.lit(1), head), F.lit(MARKER), F.substring(text, n - tail + 1, tail))
    return F.when(n <= budget, text).when(usable <= 0, F.substring(text, F.lit(1), budget)).otherwise(cut)
