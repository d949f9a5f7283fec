"""Exact top-k by integer inner product: columnar branch-and-bound.

Vectors are packed into blocks of columns (vertical layout), in the narrowest integers that hold them. A block of queries meets a group of candidate
blocks in one task. There the inner products grow by 16 dimensions at a time; after each step a candidate's product can grow by no more
than the product of both remaining norms, so candidates that cannot reach any query's 20th score so far are compacted
away, and once few (query, candidate) pairs are left only those are finished. The 20th score starts at that of a first pass over one candidate
block. The bound is never below the true product (it is rounded up), so the result is exact; ties go to the smaller id. Where products pass the exact range
of floats, bounds take their error into account, and what survives is multiplied in whole integers.

Candidates travel once per block of queries, queries once per group of candidate blocks; both are as large as a task's memory bears, so what is
shuffled grows with the table until the queries fill a block, and after that with the number of query blocks.
Each task returns its k best per query; these partial lists, a bounded number of rows per query and group, are merged by rank.

Defined results: vectors that are null, or hold null or non-finite components, and rows with a null id take no part;
a query only meets candidates of its own dimension; an empty vector takes no part; every row is a query of its own and meets all rows but itself, so rows
that repeat an id are candidates of each other, and each has its ranks (``row_col`` tells rows apart; without it, rows of one id are taken for one row); components and scores beyond the range
of a long are held at its ends; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.runtime import write_once

STEP = 16
#: Most tasks of the step that compares blocks; a task takes several pairs of blocks beyond that.
TASKS = 10_000
#: The least score: what is below is held there.
LOWEST = np.float32(-(2.0**63))


def to_integers(vector: Column, scale: int = 64) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def _clean(rows: DataFrame, id_col: str, vec_col: str, row_col: str) -> DataFrame:
    v = F.col(vec_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return rows.filter(F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & fine).select(F.col(id_col).cast("long").alias("id"), F.col(row_col).cast("long").alias("row"), to_integers(v).alias("v"))


def narrow(v: np.ndarray) -> np.ndarray:
    """The same integers in the narrowest type that holds them."""
    low, high = int(v.min(initial=0)), int(v.max(initial=0))
    return v.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def _pack(rows: DataFrame, most: int) -> DataFrame:
    """Blocks of up to ``most`` vectors of one dimension, made where the rows are: (name, dim, ids, row_ids, cols), ids ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        name = itertools.count(TaskContext.get().partitionId() << 32)

        def block(dim: int) -> pa.RecordBatch:
            parts = held.pop(dim)
            ids, row_ids, vecs = (np.concatenate([p[k] for p in parts]) for k in range(3))
            order = np.argsort(ids, kind="stable")
            cols = narrow(np.ascontiguousarray(vecs[order].T))
            return pa.RecordBatch.from_arrays([pa.array([next(name)], pa.int64()), pa.array([dim], pa.int32()), pa.array([ids[order].tobytes()], pa.binary()), pa.array([row_ids[order].tobytes()], pa.binary()), pa.array([cols.dtype.itemsize], pa.int32()), pa.array([cols.tobytes()], pa.binary())], names=["name", "dim", "ids", "row_ids", "width", "cols"])

        for b in batches:
            ids, row_ids = (np.asarray(b.column(c), dtype=np.int64) for c in ("id", "row"))
            v = b.column("v")
            size = np.asarray(v.value_lengths(), dtype=np.int64)
            flat, ends = np.asarray(v.flatten(), dtype=np.int64), np.cumsum(size)
            for dim in np.unique(size).tolist():
                at = np.flatnonzero(size == dim)
                vecs = flat[(ends[at] - dim)[:, None] + np.arange(dim)]
                for k in range(0, len(at), most):
                    held.setdefault(dim, []).append((ids[at[k : k + most]], row_ids[at[k : k + most]], vecs[k : k + most]))
                    if sum(len(p[0]) for p in held[dim]) >= most:
                        yield block(dim)
        for dim in list(held):
            yield block(dim)

    return rows.mapInArrow(run, "name long, dim int, ids binary, row_ids binary, width int, cols binary")


def _largest(v: np.ndarray) -> int:
    return max(1, -int(v.min(initial=0)), int(v.max(initial=0)))


def best(queries: tuple[np.ndarray, np.ndarray], blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate id, score) of each query's k best over blocks of (ascending ids, row ids, dim x n integers), but for its own row. ``least``: scores that each query's k-th
    best is known to reach; what is below may be left out."""
    q_row, q = queries
    dim, m = q.shape
    bound = max([1, *(_largest(c) for _, _, c in blocks)]) * _largest(q) * dim
    whole = bound >= 1 << 53  # beyond exact floats
    kind = np.float32 if bound < 1 << 24 else np.float64
    cuts = list(range(0, dim, STEP))
    qk = q.astype(kind)
    q2 = (q.astype(np.float64) ** 2)[::-1].cumsum(axis=0)[::-1]
    rest_q = [np.sqrt(q2[j]) if j < dim else np.zeros(m) for j in [*cuts[1:], dim]]
    norm = np.sqrt(q2[0])
    least = np.full(m, -np.inf) if least is None else least.copy()
    found = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))
    for ids, row_ids, cols in blocks:
        i, c, total = _survivors(qk, cols.astype(kind), cols, cuts, rest_q, least, norm if whole else None)
        other = row_ids[c] != q_row[i]
        i, c = i[other], c[other]
        score = exact(q, cols, i, c) if whole else np.rint(total[other]).astype(np.int64)
        i, c, score = np.concatenate([found[0], i]), np.concatenate([found[1], ids[c]]), np.concatenate([found[2], score])
        order = np.lexsort((c, ~score, i))  # ~x falls as x grows, over the whole range of a long
        i, c, score = i[order], c[order], score[order]
        nth = np.arange(len(i)) - np.searchsorted(i, i)
        keep = nth < k
        found = i[keep], c[keep], score[keep]
        last = nth == k - 1
        least[i[last]] = np.maximum(least[i[last]], np.nextafter(score[last].astype(np.float64), -np.inf) if whole else score[last])
    return found


def exact(q: np.ndarray, cols: np.ndarray, i: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Products of the pairs in whole integers, held at the ends of a long."""
    out = np.empty(len(i), np.int64)
    for a in range(0, len(i), 1 << 14):
        x = (q[:, i[a : a + (1 << 14)]].astype(object) * cols[:, c[a : a + (1 << 14)]].astype(object)).sum(axis=0)
        out[a : a + (1 << 14)] = [max(-(1 << 63), min((1 << 63) - 1, v)) for v in x]
    return out


def _survivors(qk, xk, cols, cuts, rest_q, least, norm):
    """(query, candidate, product) of the pairs that may reach the query's ``least``; with ``norm``, products are only near the true ones."""
    x2 = (cols.astype(np.float64) ** 2)[::-1].cumsum(axis=0)[::-1]
    dim = len(cols)
    slack = lambda alive: 0 if norm is None else norm[:, None] * np.sqrt(x2[0][alive])[None, :] * dim * 2.0**-50
    alive, total = np.arange(cols.shape[1]), np.zeros((qk.shape[1], cols.shape[1]), dtype=qk.dtype)
    for n, j in enumerate(cuts):
        to = min(dim, j + STEP)
        total += qk[j:to].T @ xk[j:to][:, alive]
        if to == dim:
            break
        rest = (rest_q[n][:, None] * np.sqrt(x2[to][alive])[None, :] * (1 + 1e-6) + 1e-6 + slack(alive)).astype(qk.dtype)
        may = np.maximum(total + rest, LOWEST) >= least[:, None]
        if not may.all():
            if may.mean() < 0.05:  # few pairs are left: finish them one by one
                i, c = np.nonzero(may)
                out = total[i, c] + np.einsum("ji,ji->i", qk[to:][:, i], xk[to:][:, alive[c]])
                on = np.maximum(out + (0 if norm is None else norm[i] * np.sqrt(x2[0][alive[c]]) * dim * 2.0**-50), LOWEST) >= least[i]
                return i[on], alive[c[on]], out[on]
            some = may.any(axis=0)
            if not some.all():
                alive, total = alive[some], np.ascontiguousarray(total[:, some])
    i, c = np.nonzero(np.maximum(total + slack(alive), LOWEST) >= least[:, None])
    return i, alive[c], total[i, c]


def _columns(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row.ids, np.int64), np.frombuffer(row.row_ids, np.int64), np.frombuffer(row.cols, f"i{row.width}").reshape(row.dim, -1)


def _step(left: pd.DataFrame, right: pd.DataFrame, k: int, part: int = 512) -> pd.DataFrame:
    """The k best of each query of ``left`` among the candidate blocks of ``right``, a part of a query block at a time."""
    out = [pd.DataFrame({"row": pd.Series(dtype="int64"), "query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="int64")})]
    for a in left.itertuples():
        ids, row_ids, q = _columns(a)
        least = np.frombuffer(a.least, np.float64) if isinstance(getattr(a, "least", None), bytes) else None
        same = [_columns(b) for b in right.itertuples() if b.dim == a.dim]
        for z in range(0, len(ids), part) if same else ():
            i, c, s = best((row_ids[z : z + part], q[:, z : z + part]), same, k, None if least is None else least[z : z + part])
            out.append(pd.DataFrame({"row": row_ids[z : z + part][i], "query_id": ids[z : z + part][i], "vec_id": c, "score": s}))
    return pd.concat(out)


def top_k(queries: DataFrame, rows: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", row_col: str | None = None, query_block: int = 4096, row_block: int = 4096, group: int = 8) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's ``k`` best rows other than its own; ``row_col`` is a number that tells rows apart."""
    spark = rows.sparkSession
    q = _clean(queries, id_col, vec_col, row_col or id_col)
    if row_col is None:
        q = q.groupBy("id", "row").agg(F.min("v").alias("v"))
    qb, xb = write_once(_pack(q, query_block), "topq"), write_once(_pack(_clean(rows, id_col, vec_col, row_col or id_col), row_block), "topx")
    nq, nx = qb.count(), xb.count()  # numbers of blocks; the blocks themselves never reach the driver
    qb, xb = _numbered(qb).withColumnRenamed("n", "q"), _numbered(xb)
    groups = max(1, -(-nx // group), min(nx, -(-2 * spark.sparkContext.defaultParallelism // max(1, nq))))

    def first(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """Of one block of queries, what each query's k-th score among a block of candidates reaches."""
        if not len(left):
            return pd.DataFrame({"b": pd.Series(dtype="int32"), "least": pd.Series(dtype="object")})
        found = _step(left, right, k)
        found["n"] = found.groupby("row").cumcount()  # best first
        kth = found[found["n"] == k - 1].set_index("row")["score"].astype(float)
        row_ids = np.frombuffer(left["row_ids"].iloc[0], np.int64)
        return pd.DataFrame({"b": [left["q"].iloc[0]], "least": [np.nextafter(kth.reindex(row_ids).fillna(-np.inf).to_numpy(np.float64), -np.inf).tobytes()]})

    one = xb.groupBy("dim").agg(F.max(F.struct(F.length("ids").alias("l"), "name"))["name"].alias("one"))  # the fullest block of each dimension
    some = xb.join(one.select("one"), F.col("name") == F.col("one"), "left_semi").select("dim", "ids", "row_ids", "width", "cols")
    asked = qb.select(F.col("q").alias("s_q"), F.col("dim").alias("s_dim")).join(some, F.col("s_dim") == F.col("dim")).select("s_q", "dim", "ids", "row_ids", "width", "cols")
    seeds = qb.groupBy("q").cogroup(asked.groupBy("s_q")).applyInPandas(first, "b int, least binary")
    qs = qb.join(write_once(seeds, "topseed"), F.col("q") == F.col("b"), "left")
    qs = qs.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).select("g", "q", "dim", "ids", "row_ids", "width", "cols", "least")
    xs = xb.withColumn("g", (F.col("n") % groups).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(max(nq - 1, 0))))).select("g", "q", "dim", "ids", "row_ids", "width", "cols")
    tasks = max(1, min(groups * nq, TASKS))  # named, as the work of a pair of blocks is far more than its bytes say
    qs, xs = qs.repartition(tasks, "g", "q"), xs.repartition(tasks, "g", "q")
    part = qs.groupBy("g", "q").cogroup(xs.groupBy("g", "q")).applyInPandas(lambda a, b: _step(a, b, k), "row long, query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("row", "query_id").orderBy(F.desc("score"), "vec_id"))
    return part.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _numbered(blocks: DataFrame) -> DataFrame:
    """Blocks with consecutive numbers n; what is sorted is a name per block."""
    keys = blocks.select(F.col("name").alias("k"), (F.row_number().over(W.orderBy("name")) - 1).alias("n"))
    return blocks.join(keys, F.col("name") == F.col("k")).drop("k")


def nearest(embeddings: DataFrame) -> DataFrame:
    """op10: queries are the rows whose id is divisible by 20. Rows are numbered once, and the numbers written, as both sides read them."""
    e = write_once(embeddings.select("vec_id", "embedding", F.monotonically_increasing_id().alias("row")), "toprows")
    return top_k(e.filter(F.col("vec_id") % 20 == 0), e, row_col="row")


NEAREST_SQL = """
WITH e AS (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id % 20 = 0 AND c.r <> q.r)
SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS "rank", vec_id, score
FROM s QUALIFY "rank" <= 20
"""
