"""Enrichment of spans by a model: an injected callable, tried backend by backend, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Backend = tuple[str, Callable[[str], str]]


def offline(prompt: str) -> str:
    """A deterministic stand-in for a model: the prompt's first words."""
    return "Auto-summary generated offline: " + " ".join(prompt.split()[:12])


def cascade(rows: DataFrame, make: Callable[[], list[Backend]], key: str = "span_hash", prompt: str = "text", attempts: int = 2) -> DataFrame:
    """(key, summary, backend, error): the first backend that answers within its attempts; null and the last error if none does."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backends = make()

        def one(text: str) -> tuple[str | None, str | None, str | None]:
            error = None
            for name, call in backends:
                for _ in range(attempts):
                    try:
                        return call(text), name, None
                    except Exception as e:  # any failure of a backend passes on to the next
                        error = f"{name}: {e}"
            return None, None, error

        for b in batches:
            out = [one(t or "") for t in b[prompt]]
            yield pd.DataFrame({key: b[key], "summary": [o[0] for o in out], "backend": [o[1] for o in out], "error": [o[2] for o in out]})

    return rows.select(key, prompt).mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, summary string, backend string, error string")


def pending(spans: DataFrame, done: DataFrame, failures: DataFrame, limit: int = 3) -> DataFrame:
    """Spans without an enrichment that have not failed too often: (span_hash, failures) has the counts."""
    out = failures.filter(F.col("failures") >= limit).select("span_hash")
    return spans.join(done.select("span_hash"), "span_hash", "left_anti").join(out, "span_hash", "left_anti")


def describe(spans: DataFrame, order: Column, words: int = 50) -> DataFrame:
    """(path, description): first sentences of a file's most important summaries, up to a number of words; the first is cut if it is longer."""
    from spanloom.functions.text import first_sentence, first_words, tokens_by_words

    s = spans.withColumn("_s", first_sentence(F.col("summary")))
    w = W.partitionBy("path").orderBy(order, "start_line", "span_hash")
    s = s.withColumn("_i", F.row_number().over(w)).withColumn("_u", F.sum(tokens_by_words(F.col("_s"))).over(w.rowsBetween(W.unboundedPreceding, 0)))
    s = s.filter((F.col("_u") <= words) | (F.col("_i") == 1)).withColumn("_s", F.when(F.col("_i") == 1, first_words(F.col("_s"), words)).otherwise(F.col("_s")))
    x = F.array_sort(F.collect_list(F.struct("_i", "_s")))  # at most `words` rows a file
    return s.groupBy("path").agg(F.array_join(F.transform(x, lambda r: r["_s"]), " ").alias("description"))


def refresh(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, description, input_hash, changed): new rows where the input hash differs from the stored one, else the stored row."""
    o = old.select("path", F.col("description").alias("d0"), F.col("input_hash").alias("h0"))
    j = o.join(new, "path", "full")
    fresh = F.col("h0").isNull() | (F.col("input_hash").isNotNull() & (F.col("input_hash") != F.col("h0")))
    return j.select("path", F.when(fresh, F.col("description")).otherwise(F.col("d0")).alias("description"), F.when(fresh, F.col("input_hash")).otherwise(F.col("h0")).alias("input_hash"), fresh.alias("changed"))


def resolve_topics(topics: DataFrame, spans: DataFrame) -> DataFrame:
    """(topic, id, stage): the span whose symbol's leaf is the topic, else the shortest symbol that holds it as a dot part's start."""
    from spanloom.functions.symbols import leaf

    s = spans.select("id", "symbol", F.lower(leaf(F.col("symbol"))).alias("leaf"))
    exact = topics.join(s, F.col("topic") == F.col("leaf")).select("topic", "id", F.length("symbol").alias("n"), F.lit(0).alias("stage"))
    starts = s.select("id", "symbol", F.substring("leaf", 1, 3).alias("k"), "leaf")
    near = topics.withColumn("k", F.substring("topic", 1, 3)).join(starts, "k").filter(F.startswith("leaf", "topic")).select("topic", "id", F.length("symbol").alias("n"), F.lit(1).alias("stage"))
    best = exact.unionByName(near).groupBy("topic").agg(F.min(F.struct("stage", "n", "id")).alias("x"))
    return best.select("topic", "x.id", "x.stage")
