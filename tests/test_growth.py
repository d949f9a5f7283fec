"""What an operator keeps or moves must not grow faster than its input."""

import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.operators import graph as G
from spanloom.operators import clinical, composed, fusion, search
from spanloom.plans import catalog
from tests.oracle import compare


def _written(monkeypatch, module):
    """Rows of the tables that a module writes, by tag."""
    rows, write = defaultdict(list), module.write_once

    def counted(df, tag="t"):
        out = write(df, tag)
        rows[tag].append(out.count())
        return out

    monkeypatch.setattr(module, "write_once", counted)
    return rows


def test_layers_of_paths_are_shared_by_origins(spark, monkeypatch):
    rnd = random.Random(5)
    nodes = [f"n{i}" for i in range(40)]
    edges = sorted({(rnd.choice(nodes), rnd.choice(nodes)) for _ in range(70)})
    pairs = sorted({(rnd.choice(nodes), rnd.choice(nodes)) for _ in range(60)}) + [("n0", "x"), ("x", "x")]
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    want = {}
    for a, z in pairs:
        layer = [[a]]
        for hops in range(6):
            hit = sorted(p for p in layer if p[-1] == z)
            if hit:
                want[a, z] = (hops, hit[0])
                break
            layer = [p + [n] for p in layer for n in near[p[-1]] if n not in p]
    rows = _written(monkeypatch, G)
    r = G.shortest_paths(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame(pairs, "src string, dst string"), 5, both=True)
    assert {(x.src, x.dst): (x.hops, list(x.path)) for x in r.collect()} == want
    assert max(rows["layer"]) <= len(nodes) + 1  # a row a node, not one an origin and node


@pytest.mark.parametrize("blocks", [(256, 1 << 13), (2, 16)])
def test_plans_give_few_rows_a_block(spark, monkeypatch, blocks):
    monkeypatch.setattr(search, "QUERY_BLOCK", blocks[0])
    monkeypatch.setattr(search, "ROW_BLOCK", blocks[1])
    rows = [(i, "mod.alpha" if i % 3 else "mod.beta", f"src/doc{i}.py", "of gamma" if i % 7 == 0 else None) for i in range(200)]
    c = spark.createDataFrame(rows, "id long, symbol string, path string, summary string").coalesce(1)
    q = spark.createDataFrame([(i, t) for i, t in enumerate(["mod", "alpha gamma", "the", "doc1 beta"])], "query_id long, text string")
    got = search.plan_scores(c, q, ["symbol", "path", "summary"], 5)
    blocks_of = -(-200 // blocks[1])
    assert got.count() <= 4 * 5 * 2 * blocks_of  # not a row a candidate and query
    best = search.top(got, ["query_id"], 5, F.desc("score"), F.col("id")).filter("query_id < 3").collect()
    assert [(r.query_id, r.id, r.score) for r in sorted(best, key=lambda r: (r.query_id, r["rank"]))] == [
        (0, 0, 3.5), (0, 7, 3.5), (0, 14, 3.5), (0, 21, 3.5), (0, 28, 3.5), (1, 7, 5.3), (1, 14, 5.3), (1, 28, 5.3), (1, 35, 5.3), (1, 49, 5.3),
        (2, 0, 0.5), (2, 7, 0.5), (2, 14, 0.5), (2, 21, 0.5), (2, 28, 0.5)]


def test_words_are_counted_within_a_text_and_blocks_written_in_slices(spark, tmp_path, monkeypatch):
    from collections import Counter

    from spanloom.functions.text import counts
    from spanloom.operators import textindex

    words = [["b", "a", "b"], [], ["z"], ["a"] * 50]
    got = spark.createDataFrame([(w,) for w in words], "t array<string>").select("t", counts(F.col("t")).alias("c")).collect()
    assert all([(x.term, x.tf) for x in r.c] == sorted(Counter(r.t).items()) for r in got)
    monkeypatch.setattr(textindex, "SLICE", 16)
    docs = [(i, f"all word{i % 5} own{i}") for i in range(300)] + [(7, "again again")]
    index = textindex.index_of(spark.createDataFrame(docs, "id long, text string"), f"file://{tmp_path}/i", ["text"])
    q = spark.createDataFrame([(0, "word3 all"), (1, "again own7"), (2, "all")], "query_id long, text string")
    for state in range(2):
        hits = index.hits(q, {"text": 1.0}).select("query_id", "id").collect()
        assert sorted((r.query_id, r.id) for r in hits) == sorted([(0, i) for i in range(300) if i % 5 == 3] + [(1, 7)] + [(2, i) for i in range(300)])
        if not state:
            assert max(r["count"] for r in index._read("postings").groupBy(F.input_file_name()).agg(F.sum("n").alias("count")).collect()) < 300  # not all of a bucket in one task
            index.merge()


def test_python_holds_few_texts_and_rows(spark, monkeypatch):
    import pyarrow as pa

    from spanloom import runtime

    texts = ["x" * 100, None, "", "y" * 5000, *["z" * 400] * 50]
    batch = pa.record_batch({"id": list(range(len(texts))), "text": texts})
    monkeypatch.setattr(runtime, "TEXT_BYTES", 1000)
    monkeypatch.setattr(runtime, "ROWS_OUT", 8)
    parts = list(runtime.small(iter([batch]), "text"))
    assert [i for p in parts for i in p.column("id").to_pylist()] == list(range(len(texts)))
    assert all(p.num_rows == 1 or sum(len(t or "") for t in p.column("text").to_pylist()) <= 1000 for p in parts)
    out = list(runtime.row_batches("id", "text", lambda t: ((i, t[i]) for i in range(20)), "id long, at int, letter string")(iter([batch])))
    assert max(b.num_rows for b in out) <= 8 and sum(b.num_rows for b in out) == 52 * 20
    assert [r for b in out for r in b.to_pylist()][:2] == [{"id": 0, "at": 0, "letter": "x"}, {"id": 0, "at": 1, "letter": "x"}]


def test_a_hubs_neighbours_are_picked_before_queries_meet_them(spark, monkeypatch):
    near = [("hub", f"c{i:03}", 1) for i in range(300)] + [("small", "x", 1), ("small", "c000", 2), ("other", "y", 1)]
    hits = [(q, f"v{i}", i + 1) for q in range(40) for i in range(2)] + [(0, "c001", 3)]
    asks = [(q, "hub" if q % 2 else "small") for q in range(39)] + [(0, "hub")]
    rows = _written(monkeypatch, composed)
    r = composed.hybrid(spark.createDataFrame(hits, "query_id long, id string, rank int"), spark.createDataFrame(asks, "query_id long, entity string"), spark.createDataFrame(near, "entity string, id string, distance int"), 15).collect()
    assert rows["near"] == [19 * 15 + 20 * 2 + 15]  # not a row a query and neighbour
    for q in range(40):
        mine = [h for h in hits if h[0] == q]
        graph = sorted((d, i) for e in {e for k, e in asks if k == q} for _, i, d in sorted((x for x in near if x[0] == e), key=lambda x: (x[2], x[1]))[:15])
        want = [i for _, i, _ in mine] + [i for _, i in sorted((d, i) for i, d in {i: d for d, i in reversed(graph)}.items()) if i not in {h[1] for h in mine}]
        got = sorted((x for x in r if x.query_id == q), key=lambda x: x["rank"])
        assert [x.id for x in got] == want
        assert all(x.density == pytest.approx(len(graph) / len(want)) for x in got)


@pytest.mark.parametrize("both", [False, True])
def test_starts_share_the_rows_of_a_layer(spark, monkeypatch, both):
    rnd = random.Random(8)
    edges = sorted({(f"n{rnd.randrange(150)}", rnd.choice(["hub", "n3", f"n{rnd.randrange(150)}"])) for _ in range(300)} | {("hub", "a"), ("a", "b"), ("b", "hub"), ("n1", "n1")})
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        if both:
            near[b].add(a)
    asked = None if not both else ["hub", "n1", "nowhere"]
    want = {}
    for start in asked or {a for a, _ in edges}:
        at = {start}
        for d in range(1, 4):
            at = {z for x in at for z in near[x]}
            for z in at:
                want.setdefault((start, z), d)
    rows = _written(monkeypatch, G)
    r = G.reach(spark.createDataFrame(edges * 2, "src string, dst string"), asked and spark.createDataFrame([(x,) for x in asked], "id string"), 3, both).collect()
    assert sorted((x.start, x.id, x.distance) for x in r) == sorted((*k, d) for k, d in want.items())
    blocks = -(-len(asked or {a for a, _ in edges}) // 64)
    assert max(rows["layer"]) <= blocks * len({x for e in edges for x in e})  # not a row a start and node


def test_relations_are_tried_where_their_phrases_are_and_found_once(spark):
    import re
    import time

    texts = ["A is Treated with b c. b\u0131g  may cause x, y causes  z; q linked to r s as side effect, t linked to u", "x managed with y\nz responds to w causes v", None, "", "causes", "a causes b can cause c\u00e9d",
             "dru\u017f i\u017f linked to pain a\u017f \u017fide effect"]
    want = []
    for i, t in enumerate(texts):
        for p, kind, base in clinical.RELATIONS:
            for m in re.finditer(p, t or ""):
                n = len(m[0].split())
                c = min(1.0, max(0.0, base + (0.1 if n > 5 else -0.1 if n < 3 else 0.0)))
                if c >= 0.7:
                    want.append((i, m[1].strip(), m[2].strip(), kind, c, m[0]))
    got = clinical.relations(spark.createDataFrame(list(enumerate(texts)), "id long, text string")).collect()
    assert want and sorted(map(tuple, got)) == sorted(want)
    start = time.perf_counter()
    assert clinical.relations(spark.createDataFrame([(0, "word " * 20_000)], "id long, text string")).count() == 0
    assert time.perf_counter() - start < 60  # not in proportion to the square of a text
    plan = catalog.queries()["clinical_answers"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan


@pytest.mark.parametrize("few", [True, False])
def test_few_needles_and_terms_are_looked_for_where_texts_are_read(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(search, "QUERY_BLOCK", 1)
        monkeypatch.setattr(search, "FEW", 1)
    texts = ["alpha beta beta", "beta", "", None, "gamma' \\d alpha", "delta", "beta"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    needles = ["a b", "eta", "'", "\\d", "none", "", "a"]
    rows = _written(monkeypatch, search)
    got = search.rows_with(docs, spark.createDataFrame([(n,) for n in needles], "needle string"), "id", "text", "needle").collect()
    assert sorted(map(tuple, got)) == sorted((i, n) for i, t in enumerate(texts) for n in needles if n and n in (t or ""))
    assert ("rowruns" in rows) != few
    index, figures = search.index_for(docs, spark.createDataFrame([(0, "beta ALPHA"), (1, "zeta")], "query_id long, text string"))
    assert sorted((r.term, r.id, r.tf, r.len) for r in index.collect()) == [("alpha", 0, 1, 3), ("alpha", 4, 1, 2), ("beta", 0, 2, 3), ("beta", 1, 1, 1), ("beta", 6, 1, 1)]
    assert figures == {"n_docs": 7, "avg_len": pytest.approx(8 / 7)}
    assert sum(rows["postings"]) == 5 + 7


def _keyed(spark):
    """(hits of a route, queries, rows, weights, both routes as rows): queries and ids that repeat, a key without rows, hits of other keys and of none, negative ids."""
    rnd = random.Random(8)
    q = [(i, i % 3) for i in range(0, 60, 5)] + [(10, 1), (70, 9)]
    x = [(i, i % 3) for i in range(-20, 40)] + [(4, 1), (4, 1), (7, 1)]
    hits = [(k, i, rnd.randrange(1, 1000) / 1000) for k in sorted({k for k, _ in q}) for i in rnd.sample(range(-25, 50), 6)]
    score = lambda k, i: np.fmod(i * 37 + k * 11, 10) / 100.0
    both = [("vec", *h) for h in hits] + [("size", k, i, float(score(k, i))) for k, a in q for i, b in x if a == b]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    w = frame([("vec", 1.0), ("size", 0.5)], "route string, weight double")
    r = frame(both, "route string, query_id long, id long, score double")
    return r.filter("route = 'vec'"), frame(q, "query_id long, key long"), frame(x, "id long, key long"), w, r, score


def _rows(df):
    return sorted((r.query_id, r.id, round(r.score, 6), *r[3:]) for r in df.collect())


def test_many_queries_copy_rows_seldom(spark):
    d = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(600)], "id long, v array<float>")
    plan = search.nearest(d, d, "id", "v", 3)._jdf.queryExecution().analyzed().toString()
    assert "explode(sequence(0, 0," in plan and "explode(sequence(0, 2," not in plan  # not once for each 256 queries
    assert "array<double>" not in plan


def test_a_route_of_all_rows_of_a_key_is_fused_where_it_is_made(spark, monkeypatch):
    monkeypatch.setattr(fusion, "QUERIES", 3)
    monkeypatch.setattr(fusion, "ROWS", 7)
    hits, q, x, w, both, score = _keyed(spark)
    assert _rows(fusion.fuse_max_keyed(fusion.fuse_max(hits, w, ["query_id"]), q, x, "key", score, 0.5)) == _rows(fusion.fuse_max(both, w, ["query_id"]).select("query_id", "id", "score"))
    got = fusion.z_scores_keyed(fusion.z_scores(hits, w, ["query_id"]), q, x, "key", score, 0.5, 6)
    assert _rows(got) == _rows(fusion.z_scores(both, w, ["query_id"]))
    assert _rows(fusion.rrf_keyed(fusion.rrf(hits, ["query_id"]), q, x, "key", score)) == _rows(fusion.rrf(both, ["query_id"]))
    same = fusion.z_scores_keyed(fusion.z_scores(hits, w, ["query_id"]), q, x, "key", lambda _, i: np.full(len(i), 0.1), 0.5, 6)
    assert _rows(same) == _rows(fusion.z_scores(both.withColumn("score", F.when(F.col("route") == "size", 0.1).otherwise(F.col("score"))), w, ["query_id"]))


def test_z_scores_of_few_rows_are_those_of_sql(spark, tmp_path):
    rows = [(i, [1.0, float(i)], label) for i, label in ((0, 0), (21, 1))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    for name in ("fuse_max", "fuse_rrf", "fuse_zscore"):
        assert compare(spark, catalog.queries()[name], catalog.oracle_sql()[name], str(tmp_path), con) is None


@pytest.mark.parametrize("name", ["fuse_max", "fuse_rrf", "fuse_zscore"])
def test_pairs_of_queries_and_rows_are_not_moved(spark, name):
    plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Union") and plan.split("\n")[1].startswith(":- MapInArrow")  # before: an aggregate or a window over pairs
