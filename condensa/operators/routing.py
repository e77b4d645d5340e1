"""Field routing: which action a field's value gets, by rules that are data."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields kept as they are, and fields whose arrays and strings are compressed.
PRESERVE_FIELDS = ("error", "exception", "message", "status", "code", "id", "type", "name")
ENCODE_FIELDS = ("data", "results", "items", "records", "rows", "entries", "payload")
ACTIONS = ("preserve", "truncate", "dedup", "parse_json", "drop", "array", "passthrough")


@dataclass(frozen=True)
class Matcher:
    """All that is given must hold: an exact or dotted-prefix path, a pattern in the last segment, lengths (of strings only)."""

    path: str | None = None
    pattern: str | None = None
    min_length: int | None = None
    max_length: int | None = None

    def column(self, path: Column, value: Column, is_string: Column) -> Column:
        out = F.lit(True)
        if self.path is not None:
            out = out & ((path == self.path) | path.startswith(self.path + "."))
        if self.pattern is not None:
            out = out & F.substring_index(path, ".", -1).rlike(self.pattern)
        if self.min_length is not None:
            out = out & (~is_string | (F.length(value) >= self.min_length))
        if self.max_length is not None:
            out = out & (~is_string | (F.length(value) <= self.max_length))
        return out


    def holds(self, path: str, value) -> bool:
        """``column`` for one value of JSON."""
        size = len(value) if isinstance(value, str) else None
        return (
            (self.path is None or path == self.path or path.startswith(self.path + "."))
            and (self.pattern is None or re.search(self.pattern, path.rpartition(".")[2]) is not None)
            and (self.min_length is None or size is None or size >= self.min_length)
            and (self.max_length is None or size is None or size <= self.max_length)
        )


@dataclass(frozen=True)
class Rule:
    matcher: Matcher
    action: str
    budget: int | None = None


@dataclass(frozen=True)
class Routing:
    enabled: bool = True
    preserve: tuple[Matcher, ...] = ()
    rules: tuple[Rule, ...] = ()
    default: str | None = None


#: The named rule sets.
PRESETS = {
    "generic": Routing(rules=(Rule(Matcher(min_length=500), "truncate", 400),)),
    "codex_logs": Routing(
        preserve=(Matcher(pattern=r"(message|reasoning)$"),),
        rules=(Rule(Matcher(path="payload.output"), "truncate", 400), Rule(Matcher(path="payload.arguments"), "parse_json"), Rule(Matcher(pattern=r"(output|stdout|stderr)$"), "truncate", 300)),
    ),
    "mcp_responses": Routing(preserve=(Matcher(pattern=r"(error|status|message|id|type)$"),), rules=(Rule(Matcher(min_length=1000), "truncate", 500),)),
    "aggressive": Routing(rules=(Rule(Matcher(min_length=200), "truncate", 200),)),
}


def preset(name: str) -> Routing:
    if name not in PRESETS:
        raise ValueError(f"no preset {name!r}; there are {', '.join(sorted(PRESETS))}")
    return PRESETS[name]


def route(path: Column, value: Column, is_string: Column, routing: Routing) -> Column:
    """The action: preserve if any such rule matches, else the first rule's, else the default's, else passthrough."""
    if not routing.enabled:
        return F.lit("passthrough")
    out = F.lit(routing.default or "passthrough")
    for rule in reversed(routing.rules):
        out = F.when(rule.matcher.column(path, value, is_string), rule.action).otherwise(out)
    for matcher in routing.preserve:
        out = F.when(matcher.column(path, value, is_string), "preserve").otherwise(out)
    return out


def chosen(path: str, value, routing: Routing) -> tuple[str, int | None]:
    """Action and budget of one value of JSON, by the rules of ``route`` and ``route_budget``."""
    if not routing.enabled:
        return "passthrough", None
    if any(m.holds(path, value) for m in routing.preserve):
        return "preserve", None
    rule = next((r for r in routing.rules if r.matcher.holds(path, value)), None)
    return (rule.action, rule.budget) if rule else (routing.default or "passthrough", None)


def route_budget(path: Column, value: Column, is_string: Column, routing: Routing) -> Column:
    """The budget of the rule whose action ``route`` gives."""
    out = F.lit(None).cast("int")
    for rule in reversed(routing.rules if routing.enabled else ()):
        out = F.when(rule.matcher.column(path, value, is_string), F.lit(rule.budget).cast("int")).otherwise(out)
    for matcher in routing.preserve:
        out = F.when(matcher.column(path, value, is_string), F.lit(None).cast("int")).otherwise(out)
    return out


def legacy_action(key: Column) -> Column:
    """The pipeline's own sets: preserve, encode or keep, by the lower-cased key."""
    low = F.lower(key)
    return F.when(low.isin(*PRESERVE_FIELDS), "preserve").when(low.isin(*ENCODE_FIELDS), "encode").otherwise("keep")


def applied(df: DataFrame, path: str, value: str, routing: Routing) -> DataFrame:
    """Routes string fields and carries out what can be done to one value; dropped rows go."""
    from ..functions.text import canonical_json, normalized, truncated

    p, v = F.col(path), F.col(value)
    out = df.withColumn("action", route(p, v, F.lit(True), routing)).withColumn("_budget", route_budget(p, v, F.lit(True), routing))
    done = F.when(F.col("action") == "truncate", truncated(v, F.coalesce("_budget", F.lit(500)))).when(F.col("action") == "parse_json", F.coalesce(canonical_json(v), v)).when(F.col("action") == "dedup", normalized(v)).otherwise(v)
    return out.filter("action <> 'drop'").withColumn("routed", done).drop("_budget")


