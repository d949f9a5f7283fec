"""The query analyser: what a query asks of the graph, as one table of features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import classify
from spanloom.operators.search import rows_with, top


def identifiers(text: Column) -> Column:
    """Distinct lower-cased identifiers: words that begin with a small letter and have two characters at least, and names in quotes or backticks."""
    words = F.filter(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda w: w.rlike(r"^[a-z][a-zA-Z0-9_]*[a-zA-Z0-9]\z"))
    quoted = F.regexp_extract_all(text, F.lit("['\"`]([a-zA-Z_][a-zA-Z0-9_.]*)['\"`]"), F.lit(1))
    return F.array_distinct(F.transform(F.concat(words, quoted), lambda w: F.lower(w)))


def analyzed(queries: DataFrame, entities: DataFrame, graph: DataFrame, per: int = 3) -> DataFrame:
    """(query_id, relation_task, n_entities, coverage, complexity) of queries (query_id, text), one row per id.

    An identifier names the first ``per`` entities (id) whose id contains it, whatever the case; coverage is the share of a query's entities that the graph (id) holds, 0
    without any. Identifiers meet entities by the rarest run of characters of each; null and empty texts name nothing.
    """
    q = queries.select("query_id", F.coalesce("text", F.lit("")).alias("text"))
    named = q.select("query_id", F.explode(identifiers(F.col("text"))).alias("needle"))
    ids = entities.select("id").filter("id IS NOT NULL").distinct().withColumn("low", F.lower("id"))
    best = top(rows_with(ids, named, "id", "low", "needle"), ["needle"], per, F.col("id")).select("needle", "id")
    found = named.join(best, "needle").select("query_id", "id").distinct()
    held = graph.select("id").distinct().withColumn("_in", F.lit(1))
    n = found.join(held, "id", "left").groupBy("query_id").agg(F.count("*").alias("_n"), F.sum(F.coalesce("_in", F.lit(0))).alias("_held"))
    x = q.join(n, "query_id", "left").withColumn("n_entities", F.coalesce("_n", F.lit(0)))
    return x.select(
        "query_id", classify.has_any(F.lower("text"), classify.RELATION).alias("relation_task"), "n_entities",
        F.when(F.col("n_entities") > 0, F.col("_held") / F.col("n_entities")).otherwise(0.0).alias("coverage"),
        classify.complexity(F.col("text"), F.col("n_entities").cast("int")).cast("int").alias("complexity"),
    )
