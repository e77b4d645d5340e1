"""Command line: compress a JSON or text input, or a structured payload, to a budget.

    python -m condensa.cli [--budget N] [--query Q] [--structured] [FILE]
"""

from __future__ import annotations

import argparse
import json
import sys

from .functions import codecs


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="condensa")
    parser.add_argument("file", nargs="?", help="input; standard input without it")
    parser.add_argument("--budget", type=int)
    parser.add_argument("--query")
    parser.add_argument("--structured", action="store_true", help="input is {content, budget, structure}")
    args = parser.parse_args(argv)
    raw = open(args.file, encoding="utf-8").read() if args.file else sys.stdin.read()
    if args.structured:
        try:
            payload = json.loads(raw)
            content = payload["content"]
            budget = args.budget if args.budget is not None else payload.get("budget", len(content))
            structure = payload.get("structure") or []
            out = codecs.compress_source_structured(content, budget, structure) if structure else codecs.compress_string(content, budget, query=args.query)
        except (ValueError, KeyError, TypeError) as e:
            print(f"invalid payload: {e}", file=sys.stderr)
            return 1
        sys.stdout.write(out)
        return 0
    try:
        data = json.loads(raw)
    except ValueError:
        data = raw
    if isinstance(data, str) and args.budget is not None:
        sys.stdout.write(codecs.compress_string(data, args.budget, query=args.query))
        return 0
    rows = data if isinstance(data, list) else [data]
    from pyspark.sql import SparkSession

    from .plans.compress import Options, compress
    from .sources.entries import from_json, from_strings

    spark = SparkSession.builder.appName("condensa").getOrCreate()
    strings = spark.createDataFrame([(i, r) for i, r in enumerate(rows) if isinstance(r, str)], "idx long, body string")
    others = spark.createDataFrame([(i, json.dumps(r, ensure_ascii=False, default=str)) for i, r in enumerate(rows) if not isinstance(r, str)], "idx long, body string")
    entries = from_strings(strings, "idx", "body").unionByName(from_json(others, "idx", "body"))
    got = compress(entries, args.budget, Options(query=args.query)).orderBy("idx").collect() if rows else []
    kept = [r["output"] if isinstance(rows[r["idx"]], str) else json.loads(r["output"]) for r in got]
    result = kept if isinstance(data, list) else (kept[0] if kept else None)
    sys.stdout.write(result if isinstance(result, str) else json.dumps(result, ensure_ascii=False, default=str))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
