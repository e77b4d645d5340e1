"""Secrets in text, by patterns and by a battery of randomness tests, in DataFrame functions only.

Patterns give the base spans: assignments to names like password or token, access keys, and long
hexadecimal runs. Beside them every run of at least ``min_length`` characters of [A-Za-z0-9+/_-],
with its padding, is a candidate, also inside a base span. Its encoding is inferred from its
characters (hexadecimal, base32, base36, base62, base64), and three tests ask whether it could be
uniform over that alphabet, each with a two-sided p-value for its length:

* chi-squared of the symbol counts, scaled to its exact mean and variance, by Wilson and Hilferty;
* the number of changes between digits, lower case, upper case and others, against the exact mean
  and variance for independent draws;
* the lag-one serial correlation of the symbols' places in the alphabet.

Fisher's method combines the three; a candidate's score is -log10 of the combined p-value, so
random strings of any length and encoding have the same distribution of scores (a tenth above 1, a
hundredth above 2), and structured ones score high, the higher the longer they are.

Which scores count is set by false-discovery control over all candidates of an encoding and class
of length. The chance that a structured string of the class scores at most s is estimated by
(D + 1) / m * s / (high - low), where D of the m candidates score between ``low`` and ``high``:
structured strings thin out towards low scores, so their density there bounds that below. These
are the p-values against "structured" of a Benjamini-Hochberg step-up at rate ``q``: the largest s
counts at which (D + 1) * s / (high - low) is at most ``q`` times the number of scores up to s. A
class of few candidates must so score very low: one alone is taken only up to 0.3.

Scale: one scan of the texts without a shuffle; ``find_secrets`` writes the spans and candidates
once, ``redact`` the rows with them. The counts that reach the driver have a row an encoding, class
and score step.

Positions are found by marking matches with two control characters, splitting at them, and adding
up the lengths of the parts, in blocks, so that a text of many matches takes no quadratic time.

Defined cases: a null text is empty; empty texts have no spans and the digest of no characters.
The marks, where a text has them itself, count as characters that match nothing. Rows with null or
repeated ids are scanned each. An empty table gives no rows. Other columns are ignored by
``find_secrets`` and kept as they are by ``redact``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table, work_dir

#: The kinds of base spans in their order, each with its pattern.
KINDS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
}
_VALUE = 6
_RANDOM = "random"
_OPEN, _CLOSE = "\u0001", "\u0002"
_BLOCK = 256
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encoding: what a string of it matches, its alphabet, the case it is read in.
ENCODINGS = {
    "hex": (r"^(?:[0-9a-f]+|[0-9A-F]+)$", _DIGITS + "abcdef", F.lower),
    "base32": (r"^[A-Z2-7]+=*$", _UPPER + "234567", None),
    "base36": (r"^(?:[0-9a-z]+|[0-9A-Z]+)=*$", _UPPER + _DIGITS, F.upper),
    "base62": (r"^[A-Za-z0-9]+=*$", _UPPER + _LOWER + _DIGITS, None),
    "base64": (r"", _UPPER + _LOWER + _DIGITS + "+/", None),
}
#: Score of what can't be random, or is too short to tell.
_NEVER = 999.0
#: Chebyshev's fit of erfc, with a relative error under 1.2e-7 everywhere (Press et al., Numerical Recipes).
_ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def _candidates(min_length: int) -> str:
    return rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{min_length},}}+={{0,6}}"


def _parts(text: str, pattern: str) -> Column:
    """Text between and in matches, in turn; null where there is none."""
    marked = F.regexp_replace(text, pattern, f"{_OPEN}$0{_CLOSE}")
    return F.when(F.col(text).rlike(pattern), F.split(marked, f"[{_OPEN}{_CLOSE}]"))


def _with_spans(df: DataFrame, parts: str, out: str) -> DataFrame:
    """Adds ``out``: (start, end, text) of the matches that ``parts`` holds at its odd places."""
    add = lambda a, x: a + x
    zero = F.lit(0).cast("long")
    df = df.withColumn("_lengths", F.transform(parts, lambda x: F.length(x).cast("long")))
    blocks = F.sequence(F.lit(0), F.floor((F.size("_lengths") - 1) / _BLOCK).cast("int"))
    df = df.withColumn("_sums", F.when(F.col(parts).isNotNull(), F.transform(blocks, lambda b: F.aggregate(F.slice("_lengths", b * _BLOCK + 1, F.lit(_BLOCK)), zero, add))))
    df = df.withColumn("_before", F.when(F.col(parts).isNotNull(), F.transform(blocks, lambda b: F.aggregate(F.slice("_sums", F.lit(1), b), zero, add))))

    def span(i: Column) -> Column:
        block = F.floor(i / _BLOCK).cast("int")
        start = F.element_at("_before", block + 1) + F.aggregate(F.slice("_lengths", block * _BLOCK + 1, i - block * _BLOCK), zero, add)
        return F.struct(start.alias("start"), (start + F.element_at("_lengths", i + 1)).alias("end"), F.element_at(parts, i + 1).alias("text"))

    odd = F.sequence(F.lit(1), F.size(parts) - 2, F.lit(2))
    none = F.lit(None).cast("array<struct<start:bigint,end:bigint,text:string>>")
    return df.withColumn(out, F.when(F.col(parts).isNotNull(), F.transform(odd, span)).otherwise(none)).drop("_lengths", "_sums", "_before")


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, x: a + x)


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value computed, and written in the plan, once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _ln_p(z: Column) -> Column:
    """Logarithm of the two-sided p-value of a standard normal ``z``."""

    def tail(x: Column) -> Column:
        def fitted(t: Column) -> Column:
            fit = F.lit(0.0)
            for c in reversed(_ERFC):
                fit = fit * t + c
            return F.least(F.log(t) - x * x + fit, F.lit(0.0))

        return _let(1 / (1 + x / 2), fitted)

    return _let(F.abs(z) / math.sqrt(2), tail)


def read_as(token: Column, encoding: str) -> Column:
    """The string's symbols, without padding, in the alphabet of ``encoding``."""
    case, own = ENCODINGS[encoding][2], F.regexp_replace(token, "=+$", "")
    return case(own) if case else F.translate(own, "-_", "+/") if encoding == "base64" else own


def battery(own: Column, encoding: str) -> dict[str, Column]:
    """Standard scores of the three tests of symbols of ``encoding`` (see ``read_as``); normal for random strings."""
    alphabet = ENCODINGS[encoding][1]
    size = len(alphabet)
    n = F.length(own).cast("double")
    counts = F.transform(F.array(*[F.lit(c) for c in alphabet]), lambda c: F.length(own) - F.length(F.replace(own, c, F.lit(""))))
    chi = F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * c) * size / n - n
    # Mean size - 1 and variance 2 (size - 1)(n - 1) / n are those of (n - 1) / n times a chi-squared of ``free`` degrees.
    spread = 2 * (n - 1) / (9 * (size - 1) * n)
    chi_z = (F.pow(F.greatest(chi, F.lit(0.0)) / (size - 1), F.lit(1 / 3)) - (1 - spread)) / F.sqrt(spread)
    # Classes of characters: one letter stands for each, and a change is a letter unlike the one before.
    classes = F.translate(own, _DIGITS + _LOWER + _UPPER + "+/", "d" * 10 + "l" * 26 + "u" * 26 + "oo")
    changes = F.length(F.regexp_replace(classes, r"(.)(?=\1)", "")).cast("double") - 1
    shares = [sum(c in group for c in alphabet) / size for group in (_DIGITS, _LOWER, _UPPER, "+/")]
    two, three = (sum(p**k for p in shares) for k in (2, 3))
    change, both = 1 - two, 1 - 2 * two + three
    pairs = n - 1
    runs_z = (changes - pairs * change) / F.sqrt(pairs * (change * (1 - change)) + (pairs - 1) * (2 * (both - change * change)))
    places = F.transform(F.split(own, ""), lambda c: F.position(c, F.lit(alphabet)).cast("double"))

    def correlation(x: Column) -> Column:
        square = _sum(F.transform(x, lambda v: v * v))
        ahead = F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x) - 1), lambda v, w: v * w)
        return F.when(square > 0, (_sum(ahead) / square + 1 / n) * n * F.sqrt(pairs) / (n - 2))

    centred = _let(places, lambda x: _let(_sum(x) / F.size(x), lambda mean: F.transform(x, lambda v: v - mean)))
    return {"chi": chi_z, "runs": runs_z, "serial": _let(centred, correlation)}


def _scored(token: Column, encoding: str) -> Column:
    """-log10 of the combined p-value of a string of ``encoding``."""

    def combined(own: Column) -> Column:
        ln = [_ln_p(z) for z in battery(own, encoding).values()]
        # Fisher: minus twice the sum is chi-squared of six degrees, whose tail is closed.
        score = _let(-(ln[0] + ln[1] + ln[2]), lambda s: F.round((s - F.log1p(s + s * s / 2)) / math.log(10), 9))
        return F.when(F.length(own) < 8, F.lit(_NEVER)).otherwise(F.least(F.coalesce(score, F.lit(_NEVER)), F.lit(_NEVER)))

    return _let(read_as(token, encoding), combined)


def _encoding(token: Column) -> Column:
    out = F.lit("base64")
    for name in ("base62", "base36", "base32", "hex"):
        out = F.when(token.rlike(ENCODINGS[name][0]), name).otherwise(out)
    return out


def _spanned(df: DataFrame, min_length: int) -> DataFrame:
    """From (_row, _text): _row, base (start, kind's number, end) and candidates (start, end, encoding, length class, score)."""
    df = df.withColumn("_marked", F.translate("_text", _OPEN + _CLOSE, "\u0003\u0003"))
    patterns = KINDS | {_RANDOM: _candidates(min_length)}
    df = df.select("_row", *[_parts("_marked", p).alias(f"_{k}") for k, p in patterns.items()])
    for kind in patterns:
        df = _with_spans(df, f"_{kind}", f"_{kind}_spans").drop(f"_{kind}")
    none = F.array().cast("array<struct<start:bigint,end:bigint,text:string>>")
    value = F.filter("_assign_spans", lambda s: F.length(F.regexp_extract(s["text"], KINDS["assign"], 1)) >= _VALUE)
    spans = {"assign": value, "access": F.col("_access_spans"), "hex": F.col("_hex_spans")}

    def numbered(i: int, own: Column) -> Column:
        return F.transform(F.coalesce(own, none), lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("kind"), s["end"].alias("end")))

    df = df.withColumn("base", F.sort_array(F.concat(*[numbered(i, spans[k]) for i, k in enumerate(KINDS)])))
    own = F.transform(F.coalesce("_random_spans", none), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), _encoding(s["text"]).alias("encoding")))
    df = df.withColumn("_own", own)

    def score(s: Column) -> Column:
        out = F.lit(None).cast("double")
        for name in ENCODINGS:
            out = F.when(s["encoding"] == name, _scored(s["text"], name)).otherwise(out)
        length = (s["end"] - s["start"]).cast("double")
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["encoding"].alias("encoding"), F.floor(2 * F.log2(length)).cast("int").alias("length_class"), out.alias("score"))

    return df.select("_row", "base", F.transform("_own", score).alias("candidates"))


def scan(docs: DataFrame, min_length: int = 20) -> DataFrame:
    """(doc_id, base, candidates), written once."""
    own = docs.select(F.struct("doc_id").alias("_row"), F.coalesce("text", F.lit("")).alias("_text"))
    return cut(_spanned(own, min_length).select("_row.doc_id", "base", "candidates"))


def cuts(scanned: DataFrame, q: float = 0.1, low: float = 3.0, high: float = 6.0, steps: int = 30) -> dict[tuple[str, int], float]:
    """Largest score that counts as random, by encoding and class of length; none where no cut holds the rate."""
    width = low / steps
    each = scanned.select(F.explode("candidates").alias("c")).select("c.encoding", "c.length_class", "c.score")
    step = F.when(F.col("score") <= low, F.greatest(F.ceil(F.col("score") / width), F.lit(1))).when(F.col("score") <= high, F.lit(-1)).cast("int")
    rows = each.withColumn("step", step).filter("step IS NOT NULL").groupBy("encoding", "length_class", "step").count().collect()
    by_class: dict[tuple[str, int], dict[int, int]] = {}
    for r in rows:
        by_class.setdefault((r["encoding"], r["length_class"]), {})[r["step"]] = r["count"]
    out = {}
    for key, counts in by_class.items():
        density = (counts.get(-1, 0) + 1) / (high - low)
        for s in range(steps, 0, -1):
            under = sum(c for k, c in counts.items() if 0 < k <= s)
            if density * s * width <= q * under + 1e-9:
                out[key] = s * width
                break
    return out


def with_spans(scanned: DataFrame, limits: dict[tuple[str, int], float]) -> DataFrame:
    """Adds ``all_spans``: base spans and the candidates under their limits, as (start, kind's number, end)."""
    if limits:
        # A literal map of a row an encoding and length class.
        table_of = F.create_map(*[x for (e, c), v in sorted(limits.items()) for x in (F.lit(f"{e}/{c}"), F.lit(float(v)))])
        limit = lambda c: F.element_at(table_of, F.concat(c["encoding"], F.lit("/"), c["length_class"].cast("string")))
        added = F.filter("candidates", lambda c: F.coalesce(c["score"] <= limit(c), F.lit(False)))
    else:
        added = F.slice("candidates", F.lit(1), F.lit(0))
    added = F.transform(added, lambda c: F.struct(c["start"].alias("start"), F.lit(len(KINDS)).alias("kind"), c["end"].alias("end")))
    return scanned.withColumn("all_spans", F.sort_array(F.concat("base", added)))


def _joined(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in [*KINDS, _RANDOM]])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, min_length: int = 20, q: float = 0.1) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans)."""
    scanned = scan(docs, min_length)
    found = with_spans(scanned, cuts(scanned, q))

    def count(i: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")

    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_joined("base").cast("binary"), 256).alias("base_sha256"), _joined("all_spans").alias("spans"))


def redact(docs: DataFrame, min_length: int = 20, q: float = 0.1, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with the spans of its texts replaced by ``mask`` (spans that overlap by one); an ``n_chars`` column follows the text in its own type."""
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.coalesce("text", F.lit("")).alias("_text"))
    at = work_dir(docs.sparkSession, "scanned")
    _spanned(own, min_length).write.parquet(at)
    scanned = docs.sparkSession.read.parquet(at)
    found = with_spans(scanned, cuts(scanned, q)).withColumn("_text", F.coalesce("_row.text", F.lit("")))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(done: Column, s: Column) -> Column:
        between = F.substring("_text", (done["at"] + 1).cast("int"), (s["start"] - done["at"]).cast("int"))
        apart = (s["start"] >= done["at"]) & ((s["start"] > 0) | (F.size(done["parts"]) == 0))
        return F.struct(F.greatest(done["at"], s["end"]).alias("at"), F.when(apart, F.concat(done["parts"], F.array(between, F.lit(mask)))).otherwise(done["parts"]).alias("parts"))

    masked = F.aggregate("all_spans", start, step, lambda done: F.concat(F.array_join(done["parts"], ""), F.substring("_text", (done["at"] + 1).cast("int"), F.length("_text"))))
    found = found.withColumn("_new", F.when(F.size("all_spans") > 0, masked).otherwise(F.col("_row.text")))
    changed = {"text": F.col("_new")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.size("all_spans") > 0, F.length("_new").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_row.n_chars"))
    return found.select(*[(changed[c] if c in changed else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))
