"""Streaming removal of entries that a session has seen, exactly or up to volatile parts, and compression of those that stay."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..plans.compress import Options, compress_entry
from ..sources.entries import forms

SCOPES = ("session", "turn", "none")


class _Bounded(StatefulProcessor):
    """Keeps the last exact and the last near forms of a session, each so many; the oldest goes first. A reset forgets all."""

    def __init__(self, size: int, columns: list[str]):
        self.size, self.columns = size, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "kind string, form string", "at long")
        self.queue = handle.getMapState("queue", "kind string, at long", "form string")
        self.ends = handle.getMapState("ends", "kind string", "first long, next long")

    def _new(self, kind: str, form: str | None) -> bool:
        """Whether a form wasn't held; it then is, and the oldest beyond the size is forgotten."""
        if form is None:
            return True
        if self.seen.containsKey((kind, form)):
            return False
        first, after = self.ends.getValue((kind,)) if self.ends.containsKey((kind,)) else (0, 0)
        self.seen.updateValue((kind, form), (after,))
        self.queue.updateValue((kind, after), (form,))
        after += 1
        while after - first > self.size:
            self.seen.removeKey((kind, self.queue.getValue((kind, first))[0]))
            self.queue.removeKey((kind, first))
            first += 1
        self.ends.updateValue((kind,), (first, after))
        return True

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            # By place: names that begin with an underscore don't get here as they are.
            own, keep = pdf.iloc[:, : len(self.columns)].set_axis(self.columns, axis=1), []
            for exact, near, reset in zip(*(pdf.iloc[:, i] for i in (-3, -2, -1))):
                if reset:
                    for state in (self.seen, self.queue, self.ends):
                        state.clear()
                # An entry that is new exactly is remembered so even if it is near to another.
                keep.append(not reset and self._new("exact", exact) and self._new("near", near))
            yield own[keep]

    def close(self) -> None:
        pass


def dedup(stream: DataFrame, session: str | list[str], exact: str, near: str | None = None, size: int | None = None, reset: str | None = None) -> DataFrame:
    """Rows of a stream whose form their session hasn't seen.

    Without ``size`` Spark's own state keeps all forms; with it each session keeps that many exact and
    that many near forms. ``reset`` names a boolean column (with ``size`` only): such a row gives nothing
    and its session forgets all. Rows count in their order of arrival, so a session's rows should come
    in one partition of the source where resets matter. Null forms are never copies of one another with
    ``size``, and are one form without it.
    """
    session = [session] if isinstance(session, str) else session
    if size is None:
        if reset:
            raise ValueError("a reset needs the bounded state: give a size")
        return stream.withColumn("_form", F.sha2(F.col(near or exact), 256)).dropDuplicates([*session, "_form"]).drop("_form")
    flag = F.coalesce(F.col(reset).cast("boolean"), F.lit(False)) if reset else F.lit(False)
    keyed = stream.select("*", F.sha2(exact, 256).alias("_exact"), (F.sha2(near, 256) if near else F.lit(None).cast("string")).alias("_near"), flag.alias("_reset"))
    return keyed.groupBy(*session).transformWithStateInPandas(_Bounded(size, stream.columns), stream.schema, "Append", "None")


def compressed(etype: Column, body: Column, options: Options = Options()) -> Column:
    """Each entry shortened by itself, without a budget."""

    @F.pandas_udf("string")
    def run(kinds: pd.Series, bodies: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else compress_entry(b, k, None, options) for k, b in zip(kinds, bodies)], dtype="object")

    return run(etype, body)


def feed(stream: DataFrame, session: str, body: str, scope: str = "session", turn: str | None = None, size: int = 5000, reset: str | None = None, options: Options = Options()) -> DataFrame:
    """Entries of a stream (``body``: JSON, or text that is then a string) that are new in their scope, each with its compressed ``output``.

    Scopes: ``session``, ``turn`` (a session's turn forgets what others saw; ``turn`` names the column) and
    ``none`` (all entries stay). ``size`` and ``reset`` are those of ``dedup``. A null body is an entry whose
    output is null and that is a copy of nothing.
    """
    if scope not in SCOPES:
        raise ValueError(f"no scope {scope!r}")
    if scope == "turn" and not turn:
        raise ValueError("the scope of turns needs the column of turns")
    etype, canon, norm = forms(body)
    own = stream.select("*", etype.alias("entry_etype"), canon.alias("entry_canon"), norm.alias("entry_norm"))
    if scope != "none":
        own = dedup(own, [session, turn] if scope == "turn" else session, "entry_canon", "entry_norm", size, reset)
    elif reset:
        own = own.filter(~F.coalesce(F.col(reset).cast("boolean"), F.lit(False)))
    return own.select(*[F.col(f"`{c}`") for c in stream.columns], compressed(F.col("entry_etype"), F.col(body), options).alias("output"))


def dedup_within(stream: DataFrame, session: str, form: str, time: str, delay: str) -> DataFrame:
    """The same as ``dedup`` with state that a watermark bounds: forms are forgotten ``delay`` after their time."""
    own = stream.withColumn("_form", F.sha2(form, 256)).withWatermark(time, delay)
    return own.dropDuplicatesWithinWatermark([session, "_form"]).drop("_form")
