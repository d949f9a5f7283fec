"""Retrieval-quality metrics over (query_id, rank, rel, grade)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def mrr(rows: DataFrame) -> DataFrame:
    """One row: mean reciprocal rank of the first relevant row, and the number of queries."""
    q = rows.groupBy("query_id").agg(F.min(F.when(F.col("rel"), F.col("rank"))).alias("f"))
    return q.agg(F.avg(F.coalesce(1.0 / F.col("f"), F.lit(0.0))).alias("mrr"), F.count("*").alias("queries"))


def hit_rate(rows: DataFrame, k: int) -> DataFrame:
    """One row: share of queries with a relevant row among the first k."""
    q = rows.groupBy("query_id").agg(F.max(F.when(F.col("rel") & (F.col("rank") <= k), 1.0).otherwise(0.0)).alias("h"))
    return q.agg(F.avg("h").alias("hit_rate"))


def precision(rows: DataFrame, k: int) -> DataFrame:
    """One row: relevant rows among the first k, over k, on average."""
    q = rows.groupBy("query_id").agg((F.count_if(F.col("rel") & (F.col("rank") <= k)) / k).alias("p"))
    return q.agg(F.avg("p").alias("precision"))


def ndcg(rows: DataFrame, k: int) -> DataFrame:
    """(query_id, ndcg) with gain 2^grade - 1; the ideal order is that of the returned grades."""
    r = rows.withColumn("_ideal", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("grade"), "rank")))
    gain = lambda at: F.sum(F.when(F.col(at) <= k, (F.pow(F.lit(2.0), "grade") - 1) / F.log2(F.col(at) + 1)).otherwise(0.0))
    q = r.groupBy("query_id").agg(gain("rank").alias("d"), gain("_ideal").alias("i"))
    return q.select("query_id", F.when(F.col("i") > 0, F.col("d") / F.col("i")).otherwise(0.0).alias("ndcg"))


def average_precision(rows: DataFrame, truth: DataFrame) -> DataFrame:
    """(query_id, ap, recall) against (query_id, truth: number of relevant rows there are); without any, recall is 1."""
    hits = F.sum(F.col("rel").cast("int")).over(W.partitionBy("query_id").orderBy("rank").rowsBetween(W.unboundedPreceding, 0))
    r = rows.withColumn("_h", hits)
    q = r.groupBy("query_id").agg(F.sum(F.when(F.col("rel"), F.col("_h") / F.col("rank")).otherwise(0.0)).alias("s"), F.count_if("rel").alias("n")).join(truth, "query_id", "left")
    t = F.coalesce("truth", F.lit(0))
    return q.select("query_id", F.when(t > 0, F.col("s") / t).otherwise(0.0).alias("ap"), F.when(t > 0, F.col("n") / t).otherwise(1.0).alias("recall"))


def by_query(rows: DataFrame, k: int, code, globs, relevant) -> DataFrame:
    """(query_id, code_at_k, mrr_code, by_globs, by_tokens) of (query_id, rank, path): the share of code files among the first k, the first one's
    reciprocal rank, and precision at k by gold globs and by relevant tokens."""
    few = F.col("rank") <= k
    first = F.min(F.when(code, F.col("rank")))
    return rows.groupBy("query_id").agg(
        F.round(F.count_if(code & few) / F.count_if(few), 6).alias(f"code_at_{k}"), F.round(F.coalesce(1.0 / first, F.lit(0.0)), 6).alias("mrr_code"),
        F.round(F.count_if(globs & few) / k, 6).alias("by_globs"), F.round(F.count_if(relevant & few) / k, 6).alias("by_tokens"),
    )


def by_arm(rows: DataFrame, k: int, routed) -> DataFrame:
    """(arm, queries, precision, hit_rate, mrr, routed) of (arm, query_id, rank, rel): means over each arm's queries."""
    q = rows.groupBy("arm", "query_id").agg((F.count_if(F.col("rel") & (F.col("rank") <= k)) / k).alias("p"), F.min(F.when(F.col("rel"), F.col("rank"))).alias("f"))
    mean = lambda x: F.round(F.avg(x), 6)
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    return q.groupBy("arm").agg(F.count("*").alias("queries"), mean(F.col("p")).alias("precision"), mean(one(F.col("f") <= k)).alias("hit_rate"), mean(F.coalesce(1.0 / F.col("f"), F.lit(0.0))).alias("mrr"), mean(one(routed)).alias("routed"))
