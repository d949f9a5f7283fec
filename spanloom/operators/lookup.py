"""Lookups that fall back from one key to the next."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cascade(rows: DataFrame, steps: list[tuple[str, DataFrame, list[str]]], value: str) -> DataFrame:
    """Adds ``value`` and ``strategy``: of the first of (name, table with keys and value, keys) that has a non-null value.

    Each table has one row per key.
    """
    found, name = F.lit(None), F.lit(None).cast("string")
    for i, (label, t, keys) in reversed(list(enumerate(steps))):
        rows = rows.join(t.select(*keys, F.col(value).alias(f"_v{i}")), keys, "left")
        found, name = F.coalesce(F.col(f"_v{i}"), found), F.when(F.col(f"_v{i}").isNotNull(), label).otherwise(name)
    return rows.withColumn(value, found).withColumn("strategy", name).drop(*[f"_v{i}" for i in range(len(steps))])
