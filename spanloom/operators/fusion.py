"""Fusion of ranked results (route, id, score, rank) of several routes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.runtime import write_once

#: Queries and rows of a block, where a query meets all rows of its key; rows that are held and that are given at once, and tasks at most.
QUERIES, ROWS, HELD, GIVEN, TASKS = 1 << 8, 1 << 16, 1 << 20, 1 << 16, 10_000


def min_max(rows: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """Adds ``normalized`` in [0, 1]; if all scores of a group are equal, 1 above zero and 0 else."""
    w = W.partitionBy(*keys)
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    return rows.withColumn("normalized", F.when(hi > lo, (F.col(score) - lo) / (hi - lo)).when(F.col(score) > 0, 1.0).otherwise(0.0))


def fuse_max(rows: DataFrame, weights: DataFrame, query: list[str]) -> DataFrame:
    """(query, id, score, route): the best weighted score; routes of weight 0 are dropped, unknown routes weigh 1."""
    r = rows.join(weights, "route", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0))).filter("weight <> 0")
    r = r.withColumn("score", F.coalesce("score", F.lit(0.0)) * F.col("weight"))
    best = r.groupBy(*query, "id").agg(F.max(F.struct("score", "route")).alias("x"))
    return best.select(*query, "id", F.col("x.score").alias("score"), F.col("x.route").alias("route"))


def _rounded(x: np.ndarray, places: int) -> np.ndarray:
    return np.copysign(np.floor(np.abs(x) * 10.0**places + 0.5) / 10.0**places, x) + 0.0


def _row_blocks(rows: DataFrame, key: str) -> DataFrame:
    """(key, _b, ids): the rows (id, key) of each key in blocks of about ROWS ids, ascending within a block and from block to block; equal ids share one."""
    n = max(1, -(-rows.count() // ROWS))
    r = rows.select(key, F.col("id").cast("long").alias("id")).filter("id IS NOT NULL").repartitionByRange(n, key, "id").withColumn("_b", F.spark_partition_id())
    return write_once(r.groupBy(key, "_b").agg(F.sort_array(F.collect_list("id")).alias("ids")), "rowblocks")


def _meeting(blocks: DataFrame, queries: DataFrame, key: str) -> Callable[[DataFrame], DataFrame]:
    """A function of these queries (query_id, key, times), with more columns of their own, that gives (_b, ids, qs): each block of rows with blocks of QUERIES of its key's
    queries, or of those with its _b. Such rows are moved, and no pairs."""
    of = queries.groupBy(key).agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("_n"))
    groups = of.join(blocks.groupBy(key).agg(F.count("*").alias("_m")), key).agg(F.sum(F.col("_n") * F.col("_m"))).first()[0] or 1

    def met(queries: DataFrame) -> DataFrame:
        own = [c for c in queries.columns if c not in (key, "_b")]
        q = queries.join(of, key)
        q = q if "_b" in queries.columns else q.join(blocks.select(key, "_b"), key)
        q = q.groupBy(key, "_b", F.pmod(F.xxhash64("query_id"), "_n").alias("_a")).agg(F.collect_list(F.struct(*own)).alias("qs"))
        return q.join(blocks, [key, "_b"]).select("_b", "ids", "qs").repartition(int(min(groups, TASKS)))

    return met


def _each(schema: str, f: Callable[[dict, int, np.ndarray], tuple]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over what ``_meeting`` gives: batches of what ``f(query, block, ids)`` gives as columns, where a query that is there more than once has its ids as often.

    Queries of a block that give as many rows each take turns, row by row: files hold an id once for many rows then, and not once a row."""
    names = [c.split()[0] for c in schema.split(", ")]

    def made(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        even = len({len(x[0]) for x in held}) == 1
        out = pa.RecordBatch.from_arrays([pa.array(np.stack(c, axis=1).ravel() if even else np.concatenate(c)) for c in zip(*held, strict=True)], names=names)
        for i in range(0, out.num_rows, GIVEN):
            yield out.slice(i, GIVEN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            for i in range(b.num_rows):
                ids, block = b.column("ids")[i].values.to_numpy(), b.column("_b")[i].as_py()
                for q in b.column("qs")[i].values:
                    q = dict(q.items())
                    held.append(f(q, block, np.repeat(ids, q["times"].as_py())))
                    n += len(held[-1][0])
                    if n >= HELD:
                        yield from made(held)
                        held, n = [], 0
                if n >= GIVEN:  # the next block has other ids
                    yield from made(held)
                    held, n = [], 0
        if held:
            yield from made(held)

    return run


def _list(value: pa.ListScalar, field: str) -> np.ndarray:
    """A field of an array of structs."""
    return value.values.field(field).to_numpy() if value.is_valid else np.empty(0)


def _folded(hits: DataFrame, queries: DataFrame, rows: DataFrame, key: str, own: Callable, part: Callable, joins: dict[str, np.ufunc], places: int) -> DataFrame:
    """Hits (query_id, id, score, ...) of few rows a query, and all rows (id, key) of each query's (query_id, key) key with a score each, joined where they are the same row.

    The pairs of queries and rows grow with the product of both. They are made where they are given and never moved: blocks of rows meet blocks of queries that carry
    their own hits. ``part(query, block, ids)``: columns of rows, to be added or compared with a hit's as ``joins`` says of each.
    """
    columns = list(joins)
    blocks = _row_blocks(rows, key)
    queries = queries.groupBy("query_id", key).agg(F.count("*").alias("times"))
    at = blocks.select(key, F.explode("ids").alias("id")).distinct().withColumn("_in", F.lit(True))
    hits = write_once(hits.join(queries.select("query_id", key), "query_id", "left").join(at, [key, "id"], "left").select("query_id", "id", *columns, "_in"), "hits")
    met = _meeting(blocks, queries, key)
    inside = hits.filter("_in").groupBy("query_id").agg(F.collect_list(F.struct("id", *columns)).alias("hits"))
    own_of = own(met, queries)
    queries = (queries if own_of is None else queries.join(own_of, "query_id")).join(inside, "query_id", "left")

    def f(q, block, ids):
        values = part(q, block, ids)
        if len(ids) > 1 and (ids[1:] == ids[:-1]).any():
            starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            ids, values = ids[starts], [joins[c].reduceat(v, starts) for c, v in zip(columns, values, strict=True)]
        hit = _list(q["hits"], "id")
        i = np.searchsorted(ids, hit)
        here = np.flatnonzero(i < len(ids))
        here = here[ids[i[here]] == hit[here]]
        for c, v in zip(columns, values, strict=True):
            joins[c].at(v, i[here], _list(q["hits"], c)[here])
        return np.full(len(ids), q["query_id"].as_py()), ids, _rounded(values[0], places), *values[1:]

    schema = ", ".join(["query_id long", "id long", *(f"{c} {hits.schema[c].dataType.simpleString()}" for c in columns)])
    both = met(queries).mapInArrow(_each(schema, f), schema)
    return both.unionByName(hits.filter("_in IS NULL").select("query_id", "id", F.round("score", places).alias("score"), *columns[1:]))


def fuse_max_keyed(hits: DataFrame, queries: DataFrame, rows: DataFrame, key: str, score: Callable, weight: float, places: int = 6) -> DataFrame:
    """(query_id, id, score): ``fuse_max`` of routes that are fused already (hits), and of a route of all rows of a query's key, by ``score(query_id, ids)``; see ``_folded``."""
    return _folded(hits, queries, rows, key, lambda *_: None, lambda q, _, ids: [score(q["query_id"].as_py(), ids) * weight], {"score": np.maximum}, places)


def rrf(rows: DataFrame, query: list[str], k: int = 60) -> DataFrame:
    """(query, id, score, best_rank): reciprocal ranks, summed; weights play no part."""
    n = F.row_number().over(W.partitionBy(*query, "route").orderBy(F.desc("score"), "id"))
    r = rows.withColumn("_r", n)
    return r.groupBy(*query, "id").agg(F.sum(1.0 / (k + F.col("_r"))).alias("score"), F.min("_r").alias("best_rank"))


def rrf_keyed(hits: DataFrame, queries: DataFrame, rows: DataFrame, key: str, score: Callable, k: int = 60, places: int = 6) -> DataFrame:
    """(query_id, id, score, best_rank): ``rrf`` of routes that are fused already (hits), and of a route of all rows of a query's key, by ``score(query_id, ids)``; see ``_folded``.

    Scores are made twice: first to count the rows of each query, block and score, which say how many rows of a query stand before a block's first of a score. What
    is moved grows with the scores of a block that differ."""

    def counts(q, block, ids):
        scores, n = np.unique(score(q["query_id"].as_py(), ids), return_counts=True)
        return np.full(len(n), q["query_id"].as_py()), np.full(len(n), block, np.int32), scores, n

    def own(met, queries):
        schema = "query_id long, _b int, score double, n long"
        n = met(queries).mapInArrow(_each(schema, counts), schema)
        before = F.coalesce(F.sum("n").over(W.partitionBy("query_id").orderBy(F.desc("score"), "_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        return n.withColumn("before", before).groupBy("query_id", "_b").agg(F.sort_array(F.collect_list(F.struct("score", "before"))).alias("places"))

    def part(q, _, ids):
        scores = _list(q["places"], "score")
        i = np.searchsorted(scores, score(q["query_id"].as_py(), ids)).astype(np.uint16 if len(scores) < 1 << 16 else np.int64)
        n, rank = np.bincount(i, minlength=len(scores)), np.empty(len(i), np.int64)
        rank[np.argsort(i, kind="stable")] = np.arange(1, len(i) + 1) - np.repeat(np.cumsum(n) - n, n)
        rank += _list(q["places"], "before")[i]
        return [1.0 / (k + rank), rank.astype(np.int32)]

    return _folded(hits, queries, rows, key, own, part, {"score": np.add, "best_rank": np.minimum}, places)


def z_scores(rows: DataFrame, weights: DataFrame, query: list[str]) -> DataFrame:
    """(query, id, score): weighted sums of z-scores (sample deviation; 0 for one row or equal scores) of each route."""
    w = W.partitionBy(*query, "route")
    sd = F.stddev_samp("score").over(w)
    z = F.when((F.count("*").over(w) < 2) | (sd == 0), 0.0).otherwise((F.col("score") - F.avg("score").over(w)) / sd)
    r = rows.withColumn("_z", z).join(weights, "route", "left")
    return r.groupBy(*query, "id").agg(F.sum(F.col("_z") * F.coalesce("weight", F.lit(1.0))).alias("score"))


def z_scores_keyed(hits: DataFrame, queries: DataFrame, rows: DataFrame, key: str, score: Callable, weight: float, places: int = 4) -> DataFrame:
    """(query_id, id, score): ``z_scores`` of routes that are fused already (hits), and of a route of all rows of a query's key, by ``score(query_id, ids)``; see ``_folded``.

    Scores are made twice: first for a count, mean, sum of squares, least and greatest of each query and block, which give a query's mean and deviation."""

    def moments(q, _, ids):
        s = score(q["query_id"].as_py(), ids)
        return [q["query_id"].as_py()], [float(len(s))], [s.mean()], [((s - s.mean()) ** 2).sum()], [s.min()], [s.max()]

    def own(met, queries):
        schema = "query_id long, n double, mean double, squares double, low double, high double"
        m = met(queries).mapInArrow(_each(schema, moments), schema)
        return m.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct(*m.columns[1:]))).alias("moments"))

    def part(q, _, ids):
        n, mean, squares, low, high = (_list(q["moments"], c) for c in ("n", "mean", "squares", "low", "high"))
        if n.sum() < 2 or low.min() == high.max():
            return [np.zeros(len(ids))]
        middle = (n * mean).sum() / n.sum()
        deviation = np.sqrt((squares + n * (mean - middle) ** 2).sum() / (n.sum() - 1))
        return [(score(q["query_id"].as_py(), ids) - middle) / deviation * weight]

    return _folded(hits, queries, rows, key, own, part, {"score": np.add}, places)


def fuse_z(rows: DataFrame, weights: DataFrame, query: list[str], least: int = 5, fallback: bool = True) -> DataFrame:
    """z-score fusion; queries with fewer than ``least`` rows use reciprocal ranks."""
    n = rows.groupBy(*query).agg(F.count("*").alias("_n"))
    r = rows.join(n, query)
    enough = z_scores(r.filter(F.col("_n") >= (least if fallback else 0)), weights, query)
    return enough.unionByName(rrf(r.filter(F.col("_n") < least), query).drop("best_rank")) if fallback else enough


def ranked(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Adds ``_rank``, a row's place from 1 within its key, for keys of any size: rows are dealt by ranges of the order and written, counted by key and range, and
    numbered within each range; a range starts where the ones before it end."""
    r = write_once(rows.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    n = r.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    n = n.select(*keys, "_part", F.coalesce(F.sum("_n").over(W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row per range
    return r.withColumn("_i", F.row_number().over(W.partitionBy(*keys, "_part").orderBy(*order))).join(n, [*keys, "_part"]).withColumn("_rank", F.col("_before") + F.col("_i")).drop("_part", "_i", "_before")


def interleave(rows: DataFrame, high: str, order: list[str], n_high: int = 5, n_low: int = 1) -> DataFrame:
    """Adds ``slot``: n_high rows of the high class, then n_low of the others, and so on; what is left over follows."""
    i, total = F.col("_rank") - 1, n_high + n_low
    slot = F.when(F.col(high), F.floor(i / n_high) * total + i % n_high).otherwise(F.floor(i / n_low) * total + n_high + i % n_low)
    return ranked(rows, [high], order).withColumn("slot", slot).drop("_rank")
