"""Span lists of operators 1 and 6, and the lines that their contracts print."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Span = tuple[str, int, int]


def redact(text: str, spans: list[tuple[int, int]], mark: str) -> str:
    """Put mark in the place of each span; spans that overlap or touch count as one."""
    out, at = [], 0
    for a, b in sorted(spans):
        if a > at or not out:
            out.append(text[at:a] + mark)
        at = max(at, b)
    return "".join(out) + text[at:]


def digest(found: DataFrame, base: tuple[str, ...], order: tuple[str, ...], value: str) -> DataFrame:
    """n_<kind> of each base kind, base_sha256 over the base spans, all spans, and the value (score, cost) of each of them.

    A span prints as kind:start:end; spans are ordered by start, then kind as listed; values, with two digits, in the same
    order. found: doc_id and spans (structs with kind, start, end, base, and the value).
    """

    def ranked(spans):
        return F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*map(F.lit, order)), s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s[value].alias("value"))))

    def line(spans):
        return F.array_join(F.transform(ranked(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    own = F.filter("spans", lambda s: s["base"])

    def count(kind: str):
        return F.size(F.filter(own, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in base]
    values = F.array_join(F.transform(ranked(F.col("spans")), lambda s: s["value"].cast("decimal(20,2)").cast("string")), ",")
    return found.select("doc_id", *counts, F.sha2(line(own), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"), values.alias(f"{value}s"))
