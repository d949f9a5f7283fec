"""Validation of JSON payloads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.functions.text import latin1, tokens_by_words

SCHEMA = "summary_120w string, usage_snippet string, inputs array<string>, outputs array<string>, side_effects array<string>, pitfalls array<string>, evidence array<struct<field:string,lines:array<int>>>"


def enrichment_errors(payload: Column, start: Column, end: Column, only_latin1: bool = False) -> Column:
    """An array of what is wrong with a payload whose span has the lines [start, end]."""
    p = F.from_json(payload, SCHEMA)
    within = lambda x: F.coalesce((F.size(x["lines"]) == 2) & F.forall(x["lines"], lambda n: (n >= start) & (n <= end)), F.lit(False))
    tests = [
        F.when(p.isNull(), "schema"), F.when(~F.forall(F.coalesce(p["evidence"], F.array().cast("array<struct<field:string,lines:array<int>>>")), within), "evidence lines out of range"),
        F.when(tokens_by_words(F.coalesce(p["summary_120w"], F.lit(""))) > 120, "summary exceeds 120 words"), F.when(F.size(F.split(F.coalesce(p["usage_snippet"], F.lit("")), "\n")) > 12, "snippet exceeds 12 lines"),
    ]
    if only_latin1:
        tests.append(F.when(~latin1(F.coalesce(p["summary_120w"], F.lit(""))), "summary contains non-Latin-1 characters"))
    return F.filter(F.array(*tests), lambda e: e.isNotNull())
