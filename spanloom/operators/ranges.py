"""Joins and merges of ranges."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def overlap_join(left: DataFrame, right: DataFrame, key: str, a: tuple[str, str], b: tuple[str, str], width: int = 256) -> DataFrame:
    """Rows of equal key whose closed ranges overlap.

    Both sides are put into bins of ``width`` and joined on (key, bin); a pair is kept in the first bin that both touch only,
    so that no pair is doubled and no theta join is planned.
    """
    bins = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width)))
    x = left.filter(F.col(a[0]) <= F.col(a[1])).withColumn("_bin", bins(*a))
    y = right.filter(F.col(b[0]) <= F.col(b[1])).withColumn("_bin", bins(*b))
    both = x.join(y, [key, "_bin"])
    first = F.greatest(F.floor(F.col(a[0]) / width), F.floor(F.col(b[0]) / width))
    return both.filter((F.col(a[0]) <= F.col(b[1])) & (F.col(b[0]) <= F.col(a[1])) & (F.col("_bin") == first)).drop("_bin")


def merge_ranges(rows: DataFrame, keys: list[str], start: str, end: str, gap: int = 1) -> DataFrame:
    """Overlapping ranges, and those at most ``gap`` apart, as one: gaps and islands."""
    w = W.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))
    r = rows.withColumn("_new", F.when(before.isNull() | (F.col(start) > before + gap), 1).otherwise(0))
    r = r.withColumn("_island", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return r.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("_island")


def prefix_within(rows: DataFrame, keys: list[str], order: list[Column], cost: Column, budget: float) -> DataFrame:
    """The rows of each group, in order, up to the first that would exceed the budget. Costs are not negative."""
    run = F.sum(cost).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("used", run).filter(F.col("used") <= budget)


def scopes_at(scopes: DataFrame, lines: DataFrame, file: str = "file", width: int = 4096) -> DataFrame:
    """(file, line, scope, depth): for each of ``lines`` (file, line) the names of the scopes (file, name, start, end) that contain it, outermost first, with dots between; null
    and 0 where there is none.

    A sweep over starts and lines in order, with a stack of the scopes that are open. Files are dealt by ranges of ``width`` lines, a scope goes to each that it touches, so
    that a long file is not one task's; the stack is as deep as scopes are nested, and nothing else is held. Scopes needn't nest properly; those
    with null or reversed ends contain nothing, null files and lines are left out, and lines that repeat are answered each.
    """
    at = lambda c: F.floor(F.col(c) / width).cast("long")
    s = scopes.filter(F.col(file).isNotNull() & (F.col("start") <= F.col("end")))
    s = s.select(F.col(file).alias("file"), F.explode(F.sequence(at("start"), at("end"))).alias("bin"), F.col("start").cast("long").alias("pos"), F.lit(0).alias("kind"), F.col("end").cast("long").alias("end"), F.coalesce("name", F.lit("")).alias("name"))
    q = lines.filter(F.col(file).isNotNull() & F.col("line").isNotNull())
    q = q.select(F.col(file).alias("file"), at("line").alias("bin"), F.col("line").cast("long").alias("pos"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("end"), F.lit(None).cast("string").alias("name"))
    both = s.unionByName(q).repartition("file", "bin").sortWithinPartitions("file", "bin", "pos", "kind", F.desc("end"), "name")
    kind = both.schema["file"].dataType.simpleString()

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, stack = None, []
        for b in batches:
            out = []
            for f, bin_, pos, is_line, end, name in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (f, bin_) != here:
                    here, stack = (f, bin_), []
                stack = [x for x in stack if x[0] >= pos]
                if is_line:
                    out.append((f, pos, ".".join(x[1] for x in stack) if stack else None, len(stack)))
                else:
                    stack.append((end, name))
            if out:
                kinds = (b.schema.field("file").type, pa.int64(), pa.string(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["file", "line", "scope", "depth"])

    return both.select("file", "bin", "pos", "kind", "end", "name").mapInArrow(sweep, f"file {kind}, line long, scope string, depth int").withColumnRenamed("file", file)
