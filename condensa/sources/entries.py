"""Sources of entries: any table, JSON text, structured payloads, files with their language; and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import canonical_json, normalized

STRUCTURE = "array<struct<type:string,name:string,kind:string,startLine:int,endLine:int,exported:boolean,priority:int,anchors:array<struct<startLine:int,endLine:int,kind:string,priority:int>>>>"
PAYLOAD = f"struct<content:string,budget:int,structure:{STRUCTURE}>"

#: Languages and their file extensions.
EXTENSIONS = {
    "python": ("py", "pyw", "pyi"), "javascript": ("js", "mjs", "cjs", "jsx"), "typescript": ("ts", "mts", "cts"), "tsx": ("tsx",),
    "rust": ("rs",), "go": ("go",), "java": ("java",), "c": ("c", "h"), "cpp": ("cpp", "cc", "cxx", "hpp", "hxx", "hh"), "csharp": ("cs",),
    "ruby": ("rb", "rake", "gemspec"), "php": ("php",), "swift": ("swift",), "kotlin": ("kt", "kts"), "scala": ("scala", "sc"), "bash": ("sh", "bash", "zsh"),
    "sql": ("sql",), "html": ("html", "htm"), "css": ("css",), "scss": ("scss",), "json": ("json", "jsonc"), "yaml": ("yaml", "yml"), "toml": ("toml",),
    "ini": ("ini",), "markdown": ("md", "markdown", "mdx"), "lua": ("lua",), "perl": ("pl", "pm"), "r": ("r",), "dart": ("dart",), "elixir": ("ex", "exs"),
    "haskell": ("hs",), "ocaml": ("ml", "mli"), "zig": ("zig",), "vue": ("vue",), "svelte": ("svelte",), "xml": ("xml",), "dockerfile": ("dockerfile",), "proto": ("proto",),
    "graphql": ("graphql", "gql"), "prisma": ("prisma",), "hcl": ("hcl", "tf"),
}


def etype(text: Column) -> Column:
    """dict, list, string or primitive, of a JSON value's text."""
    first = F.substring(F.ltrim(text), 1, 1)
    return F.when(first == "{", "dict").when(first == "[", "list").when(first == '"', "string").otherwise("primitive")


def masked_numbers(canon: Column) -> Column:
    """Canonical JSON with numbers and booleans outside of strings as <NUM>."""
    number = r'(?<=[:\[,])(?:-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false)(?=[,\]}])'
    return F.regexp_replace(canon, number, '"<NUM>"')


def forms(body: str) -> tuple[Column, Column, Column]:
    """etype, canon and norm of a column of JSON texts. Text that isn't JSON is a string."""
    canon = canonical_json(body)
    kind = F.when(canon.isNull(), "string").otherwise(etype(canon))
    form = F.coalesce(canon, F.col(body))
    return kind, form, F.when(kind == "dict", normalized(masked_numbers(form))).when(kind == "string", normalized(F.col(body)))


def from_json(df: DataFrame, idx: str, body: str) -> DataFrame:
    """Entries of a column of JSON texts: idx, etype, canon, norm, body."""
    kind, canon, norm = forms(body)
    return df.select(F.col(idx).alias("idx"), kind.alias("etype"), canon.alias("canon"), norm.alias("norm"), F.col(body).alias("body"))


def from_table(df: DataFrame, idx: str) -> DataFrame:
    """Entries of any table's rows: each row is a dict of its other columns."""
    body = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns if c != idx]))
    return from_json(df.select(F.col(idx), body.alias("_body")), idx, "_body")


def from_strings(df: DataFrame, idx: str, text: str) -> DataFrame:
    """Entries of a column of plain strings."""
    return df.select(F.col(idx).alias("idx"), F.lit("string").alias("etype"), F.col(text).alias("canon"), normalized(F.col(text)).alias("norm"), F.col(text).alias("body"))


def payloads(df: DataFrame, value: str, budget: int | None = None) -> DataFrame:
    """(content, budget, structure) of structured payloads; the given budget goes before the payload's, that before the content's length. Rows that can't be read raise."""
    read = F.from_json(F.col(value), PAYLOAD, {"mode": "PERMISSIVE"})
    own = df.select(read.alias("p"))
    content = F.coalesce("p.content", F.raise_error(F.lit("a payload has no content")).cast("string"))
    return own.select(content.alias("content"), F.coalesce(F.lit(budget).cast("int"), F.col("p.budget"), F.length("p.content")).alias("budget"), F.coalesce("p.structure", F.array().cast(STRUCTURE)).alias("structure"))


def language_of(path: Column) -> Column:
    """By the file's extension, whatever its case; null if it isn't known."""
    by_extension = F.create_map(*[x for lang, exts in sorted(EXTENSIONS.items()) for e in exts for x in (F.lit(e), F.lit(lang))])
    return F.try_element_at(by_extension, F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)))


def files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, language, text) of whole files."""
    own = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return own.select("path", language_of(F.col("path")).alias("language"), "text")


def write_entries(df: DataFrame, out: str, kind: str = "json") -> None:
    """Sinks: json, text (one column) or parquet."""
    if kind not in ("json", "text", "parquet"):
        raise ValueError(f"no sink {kind!r}")
    getattr(df.write, kind)(out)
