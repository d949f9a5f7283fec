"""What leaves the engine: contexts packed by words, results without internal fields, work for the queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.functions.paths import priority
from spanloom.operators.search import top


def words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"[\s\x1c-\x1f\x85\p{Z}]+"), lambda w: w != ""))


def two_digits(x: Column) -> Column:
    """A number with two decimals, halves rounded up."""
    return F.round(x.cast("decimal(38,18)"), 2).cast("decimal(20,2)").cast("string")


def task_context(tasks: DataFrame, hits: DataFrame, budget: int = 8000, limit: int = 20) -> DataFrame:
    """(query_id, context, words, files) of tasks (query_id, project, task) and their hits (query_id, rank, path, relevance, text).

    The heading counts; the first hit that would pass the budget ends the context. A task without hits says so and has no words. Null texts are empty, null paths unknown.
    """
    heading = F.concat(F.lit("# Project: "), F.col("project"), F.lit("\n# Task: "), F.col("task"), F.lit("\n\n## Relevant Code Context:\n"))
    h = top(hits, ["query_id"], limit, F.col("rank"), F.col("path")).withColumn("path", F.coalesce("path", F.lit("unknown")))
    chunk = F.concat(F.lit("\n### "), F.col("path"), F.lit(" (relevance: "), two_digits(F.col("relevance")), F.lit(")\n```\n"), F.coalesce("text", F.lit("")), F.lit("\n```\n"))
    h = h.select("query_id", "rank", "path", chunk.alias("chunk")).join(tasks.select("query_id", words(heading).alias("_head")), "query_id")
    so_far = F.col("_head") + F.sum(words(F.col("chunk"))).over(W.partitionBy("query_id").orderBy("rank").rowsBetween(W.unboundedPreceding, 0))  # at most `limit` rows
    fit = h.withColumn("_n", so_far).filter(F.col("_n") <= budget).groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "chunk"))).alias("_c"), F.max("_n").alias("_n"), F.count_distinct("path").alias("_f"),
    )
    found = h.groupBy("query_id").agg(F.lit(True).alias("_found"))
    x = tasks.join(found, "query_id", "left").join(fit, "query_id", "left").withColumn("files", F.coalesce("_f", F.lit(0)).cast("long"))
    body = F.coalesce(F.array_join(F.transform("_c", lambda c: c["chunk"]), "\n"), F.lit(""))
    full = F.concat(heading, F.lit("## Files referenced: "), F.col("files"), F.lit("\n\n"), F.when(F.col("_c").isNotNull(), F.lit("\n")).otherwise(""), body)
    none = F.concat(F.lit("Project: "), F.col("project"), F.lit("\nNo relevant context found.\n"))
    return x.select(
        "query_id", F.when(F.col("_found"), full).otherwise(none).alias("context"),
        F.when(F.col("_found"), F.coalesce("_n", words(heading))).otherwise(0).cast("long").alias("words"), "files",
    )


def public(results: DataFrame) -> DataFrame:
    """Results without internal columns: the slice's id, and all whose name starts with an underscore."""
    return results.select(*[F.col(f"`{c}`") for c in results.columns if c != "slice_id" and not c.startswith("_")])


def feed(spans: DataFrame, done: DataFrame, queued: DataFrame, limit: int = 100) -> DataFrame:
    """(repo, span_hash, path, priority) to be pushed for spans (id, repo, path, span_hash) of many repositories: the first ``limit`` of each that no enrichment in
    done (repo, span_hash) covers, once a hash, without those that are in the queue (repo, span_hash). The limit counts spans before the queue is looked at."""
    p = spans.join(done.select("repo", "span_hash"), ["repo", "span_hash"], "left_anti")
    few = top(p, ["repo"], limit, F.col("id")).groupBy("repo", "span_hash").agg(F.min_by("path", "id").alias("path"))
    return few.join(queued.select("repo", "span_hash"), ["repo", "span_hash"], "left_anti").select("repo", "span_hash", "path", priority(F.col("path")).alias("priority"))
