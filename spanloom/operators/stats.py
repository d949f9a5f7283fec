"""Statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators.fusion import ranked


def quantiles_exclusive(rows: DataFrame, key: str, value: str, points: list[float], least: int = 4) -> DataFrame:
    """(key, p, value) by interpolation at position p * (n + 1), for keys with at least ``least`` values.

    Spark's percentile interpolates at p * (n - 1); the two neighbours are picked by rank here.
    """
    r = ranked(rows.filter(F.col(value).isNotNull()).select(key, value), [key], [value]).withColumnRenamed("_rank", "_i")
    r = r.join(r.groupBy(key).agg(F.count("*").alias("_n")), key).filter(F.col("_n") >= least)
    r = r.withColumn("p", F.explode(F.array(*map(F.lit, points))))
    at = F.greatest(F.lit(1), F.least(F.col("_n") - 1, F.floor(F.col("p") * (F.col("_n") + 1))))
    r = r.withColumn("_j", at).filter((F.col("_i") == F.col("_j")) | (F.col("_i") == F.col("_j") + 1))
    g = r.groupBy(key, "p").agg(F.min(value).alias("a"), F.max(value).alias("b"), F.max(F.col("p") * (F.col("_n") + 1) - F.col("_j")).alias("t"))
    return g.select(key, "p", (F.col("a") + F.col("t") * (F.col("b") - F.col("a"))).alias("value"))
