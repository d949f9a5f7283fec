import math

import duckdb
import numpy as np
import pytest

from spanloom.llm import topk


def brute(rows, k=20):
    rows = [(i, [max(-(1 << 63), min((1 << 63) - 1, math.floor(64 * x))) for x in v]) for i, v in rows if i is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v)]
    queries = {}
    for i, v in rows:
        if i % 20 == 0:
            queries[i] = min(queries.get(i, v), v)
    top = (1 << 63) - 1
    held = lambda x: max(-top - 1, min(top, x))
    out = []
    for q, v in queries.items():
        s = sorted((-held(sum(a * b for a, b in zip(v, w, strict=True))), i) for i, w in rows if i != q and len(w) == len(v))[:k]
        out += [(q, n + 1, i, -x) for n, (x, i) in enumerate(s)]
    return sorted(out)


def test_repeated_rows_equal_sql(spark):
    """Rows of one id are queries and candidates each; the SQL says the same."""
    g = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in g.normal(size=6)]) for i in range(100)] + [(20, [3.0] * 6), (20, [5.0] * 6), (20, [3.0] * 6), (40, [1.0] * 6), (7, [2.0] * 6), (60, [])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", rows)
    got = sorted(tuple(r) for r in topk.nearest(d).collect())
    assert got == sorted(con.execute(topk.NEAREST_SQL).fetchall()) and len(got) == 20 * 9


@pytest.mark.parametrize("dim", [3, 16, 40])
def test_against_brute_force(spark, dim):
    g = np.random.default_rng(dim)
    rows = [(int(i), [float(x) for x in g.normal(size=dim)]) for i in g.permutation(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(60)]  # ties
    rows += [(2000, None), (2020, [1.0] * (dim - 1) + [None]), (2040, [float("nan")] * dim), (2060, [float("inf")] * dim), (None, [1.0] * dim), (2080, [2.0] * (dim + 1)), (20, rows[3][1]), (2100, [])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 id", "2 v", "3 q")
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    q = d.filter("vec_id % 20 = 0")
    got = sorted(tuple(r) for r in topk.top_k(q, d, query_block=7, row_block=50, group=3).collect())
    assert got == brute(rows)


def test_large_components_and_empty(spark):
    rows = [(0, [1e7, -2e7]), (1, [3e7, 1.0]), (2, [-1.0, 9e6])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in topk.nearest(d).collect()) == brute(rows)
    assert topk.nearest(d.limit(0)).collect() == [] and topk.nearest(d.filter("vec_id = 0")).collect() == []


def test_beyond_the_range_of_a_long(spark):
    far = -(2.0**57)  # 64 times as much is the least long
    rows = [(0, [far, far]), (1, [far, far]), (2, [-far, 1.0]), (3, [1.0, -1.0]), (4, [far, 0.0]), (5, [2.0, far]), (6, [-far, -far]), (20, [1e12, -3e11]), (7, [2e12, 5e11]), (8, [1e12, 1.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in topk.nearest(d).collect()) == brute(rows)
    g = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in g.normal(size=20) * 10.0 ** g.uniform(0, 9)]) for i in range(300)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in topk.top_k(d.filter("vec_id % 20 = 0"), d, query_block=4, row_block=30, group=3).collect()) == brute(rows)


def test_narrow_integers():
    for v, size in (([-128, 127], 1), ([0, 128], 2), ([-(1 << 31)], 4), ([-(1 << 63)], 8), ([], 1)):
        x = topk.narrow(np.array(v, np.int64))
        assert x.dtype.itemsize == size and x.tolist() == v
