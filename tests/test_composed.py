"""Composed operators and those without SQL, against plain Python."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from spanloom.functions import phi
from spanloom.operators import chunking, clinical, composed, fusion, merge, search, stats
from spanloom.plans import catalog, retrieval
from spanloom.sources import convert
from spanloom.streaming import state
from tests.oracle import compare

SF = "/root/testdata/sf0.001"


def test_redaction_returns_every_row(spark):
    d = spark.createDataFrame([(1, None), (2, ""), (3, "call 555-123-4567"), (4, "x"), (4, "x")], "id long, text string")
    got = sorted((r.id, r.redacted) for r in clinical.redacted(d).collect())
    assert got == sorted([(1, None), (2, ""), (3, phi.redact("call 555-123-4567")), (4, "x"), (4, "x")], key=lambda r: (r[0], r[1] or "")) and "555" not in got[2][1]


def test_contained_is_a_substring_test(spark):
    r = random.Random(2)
    word = lambda n: "".join(r.choice("abc") for _ in range(n))
    values, needles = [word(r.randint(0, 12)) for _ in range(200)], [word(r.randint(0, 5)) for _ in range(40)]
    got = {(x.value, x.needle) for x in search.contained(spark.createDataFrame([(v,) for v in values], "v string"), spark.createDataFrame([(n,) for n in needles], "n string"), "v", "n").collect()}
    assert got == {(v, n) for v in values for n in needles if v and n and n in v}
    assert search.contained(spark.createDataFrame([("a",)], "v string"), spark.createDataFrame([], "n string"), "v", "n").collect() == []


def test_plan_scores_hold_the_best(spark):
    r = random.Random(4)
    words = ["alpha", "beta", "gamma", "al", "x1", "the"]
    rows = [(i, r.choice(words) + "." + r.choice(words), f"src/{r.choice(words)}.py", r.choice([None, "", r.choice(words)])) for i in range(120)]
    queries = [(0, "where is alpha and beta"), (1, "the"), (2, "al x1 x1"), (3, "nothing here")]
    stop = {"where", "is", "and", "the"}

    def score(row, q):
        t = {w for w in q.split() if w not in stop}
        return round(sum(w * sum(x in (v or "") for x in t) for w, v in zip((3.0, 2.5, 1.8), row[1:], strict=True)) + (0.5 if row[3] else 0), 3)

    got = search.top(search.plan_scores(spark.createDataFrame(rows, "id long, symbol string, path string, summary string"), spark.createDataFrame(queries, "query_id long, text string"), ["symbol", "path", "summary"]), ["query_id"], 5, F.desc("score"), F.col("id"))
    want = [(i, n + 1, x, -s) for i, q in queries for n, (s, x) in enumerate(sorted((-score(row, q), row[0]) for row in rows if score(row, q) >= 0.4)[:5])]
    assert sorted((x.query_id, x["rank"], x.id, x.score) for x in got.collect()) == want


@pytest.mark.parametrize("blocks", [(256, 1 << 13), (3, 7), (256, 5)])
@pytest.mark.parametrize("how", ["plain", "bonus", "grouped"])
def test_nearest_in_blocks(spark, monkeypatch, blocks, how):
    monkeypatch.setattr(search, "QUERY_BLOCK", blocks[0])
    monkeypatch.setattr(search, "ROW_BLOCK", blocks[1])
    rows = [(i, [float((i * 7 + k) % 5 - 2) for k in range(4)], i % 3) for i in range(60)] + [(100, [0.0] * 4, 0), (101, None, 1), (10, [1.0, 2.0, -1.0, 0.0], 1)]
    d = spark.createDataFrame(rows, "id long, v array<float>, label int")
    add = {"plain": 0.0, "bonus": 0.25, "grouped": 0.0}[how]
    options = {"plain": {}, "bonus": {"bonus": F.when(F.col("label") == 1, add).otherwise(0.0), "low": 0.0, "high": 1.0}, "grouped": {"group": F.col("label"), "other": True}}[how]
    got = sorted((r.query_id, r.grp if how == "grouped" else 0, r.id, round(r.score, 6)) for r in search.nearest(d, d.filter("id % 10 = 0"), "id", "v", 4, **options).collect())
    norm = lambda v: sum(x * x for x in v) ** 0.5
    want = []
    for q, u, _ in rows:
        if q % 10 or not norm(u):
            continue
        found = {}
        for i, v, label in rows:
            if not v or not norm(v) or how == "grouped" and i == q:
                continue
            s = round(sum(a * b for a, b in zip(u, v, strict=True)) / norm(u) / norm(v), 6)
            rank = min(1.0, max(0.0, s + (add if label == 1 else 0))) if how == "bonus" else s
            found.setdefault(label if how == "grouped" else 0, []).append((-rank, i, s))
        want += [(q, g, i, s) for g, x in found.items() for _, i, s in sorted(x)[:4]]
    assert [g for g in got if g[0] != 10] == sorted(w for w in want if w[0] != 10)  # rows that repeat a query's id ask together


def test_trimmed_search(spark):
    r = random.Random(1)
    hits = [(q, i, r.random(), " ".join(r.choice("abcdefg") for _ in range(r.randint(5, 60)))) for q in range(3) for i in range(12)]
    kept, figures = composed.trimmed(spark.createDataFrame(hits, "query_id long, id long, relevance double, text string"), 60)
    kept, figures = kept.collect(), {x.query_id: x for x in figures.collect()}
    for q in range(3):
        good = sorted((h for h in hits if h[0] == q and h[2] >= 0.3), key=lambda h: (-h[2], h[1]))
        words = {h[1]: set(h[3].split()) for h in good}
        sim = lambda a, b: len(words[a] & words[b]) / len(words[a] | words[b])  # noqa: B023, E731
        order, left = [good[0]], good[1:]
        while left:
            best = max(left, key=lambda h: (0.7 * h[2] - 0.3 * max(sim(h[1], o[1]) for o in order), -good.index(h)))  # noqa: B023
            order.append(best)
            left.remove(best)
        used, want = 0, []
        for h in order:
            used += len(h[3]) // 4
            if used > 60:
                break
            want.append(h[1])
        assert [x.id for x in sorted((k for k in kept if k.query_id == q), key=lambda k: k.pick)] == want
        f = figures[q]
        assert (f.given, f.relevant, f.kept) == (12, len(good), len(want)) and f.used == sum(len(h[3]) // 4 for h in hits if h[0] == q and h[1] in want)


def test_source_chunks_cover_the_text():
    small = "def f():\n    return 1\n"
    assert chunking.source_chunks(small) == [("whole", "", 0, 0, len(small))]
    big = "import os\n\n" + small + "\nclass C:\n    '''doc'''\n" + "".join(f"    def m{i}(self):\n        return {i} + " + "1 + " * 60 + "0\n" for i in range(12)) + "X = 1\n"
    got = chunking.source_chunks(big)
    assert [r for r in got if r[0] == "header"][0][1] == "C" and {r[1] for r in got if r[0] == "whole"} >= {"f", *[f"C.m{i}" for i in range(12)]} and got[-1][0] == "remainder"
    held = set()
    for role, _, depth, a, b in got:
        held |= set(range(a, b))
        assert b - a <= 1000 and (role != "header" or b - a <= 240) and depth <= 2
    assert all(i in held for i, c in enumerate(big) if c.strip())
    assert {r[0] for r in chunking.source_chunks("def (" * 500)} == {"fallback"}


def test_script_graph():
    t = "import x from 'a';\nconst y = require(\"b\");\nexport interface P extends Q, R {\n}\nfunction f(n) {\n  if (n) { g(n); }\n  return o.h(n); // k(n)\n}\n"
    got = set(chunking.script_graph(t, "m"))
    assert {("relation", "mod:m", "IMPORTS", "mod:a"), ("relation", "mod:m", "IMPORTS", "mod:b"), ("relation", "type:m.P", "EXTENDS", "type:Q"), ("relation", "type:m.P", "EXTENDS", "type:R"), ("entity", "type:m.P", "interface", "3-4"), ("entity", "sym:m.f", "function", "5-8"), ("relation", "sym:m.f", "CALLS", "sym:g"), ("relation", "sym:m.f", "CALLS", "sym:h")} == got


def test_sliding_rate_across_stretches(spark):
    r = random.Random(3)
    rows = [(i, "k", r.randint(0, 400), r.randint(1, 9)) for i in range(150)]
    d = spark.createDataFrame(rows, "id long, k string, s long, tok long").withColumn("ts", F.timestamp_seconds("s"))
    for x in state.sliding_rate(d, ["k"], "ts", "tok", 60).collect():
        mine = [q for q in rows if x.s - 60 <= q[2] <= x.s]
        assert (x.requests, x.used) == (len(mine), sum(q[3] for q in mine))
    assert state.sliding_rate(d, ["k"], "ts", "tok", 60).count() == 150


def test_ranks_and_quantiles_of_large_keys(spark):
    rows = [("a", i * 37 % 1000) for i in range(1000)] + [("b", i) for i in range(7)] + [("c", 1), (None, 2)]
    d = spark.createDataFrame(rows, "k string, v long").repartition(5)
    got = fusion.ranked(d.filter("k IS NOT NULL"), ["k"], ["v"]).collect()
    assert sorted((x.k, x["_rank"], x.v) for x in got) == sorted([("a", i + 1, i) for i in range(1000)] + [("b", i + 1, i) for i in range(7)] + [("c", 1, 1)])
    q = {(x.k, x.p): x.value for x in stats.quantiles_exclusive(d, "k", "v", [0.25, 0.5]).collect() if x.k}
    assert q == {("a", 0.25): 249.25, ("a", 0.5): 499.5, ("b", 0.25): 1.0, ("b", 0.5): 3.0}


def test_generations_count_up(spark):
    meta = spark.createDataFrame([(1, "g", "4"), (1, "other", "x"), (2, "other", "y")], "repo long, key string, value string")
    got = sorted(tuple(r) for r in merge.increment(meta, spark.createDataFrame([(1,), (2,), (2,)], "repo long"), ["repo"], "g").collect())
    assert got == [(1, "g", "5"), (1, "other", "x"), (2, "g", "1"), (2, "other", "y")]


def test_nav_search_of_a_stale_index_looks_up_literally(spark):
    docs = spark.createDataFrame([(1, "a.py", "alpha beta"), (2, "b.py", "beta gamma"), (3, "c.py", "betamax")], "id long, path string, text string")
    n = spark.createDataFrame([("a.py", "c.py")], "path string, other string")
    q = spark.createDataFrame([(0, "beta"), (1, "etama"), (2, "zzz")], "query_id long, text string")
    fresh = {(r.query_id, r.path): r.origin for r in composed.nav_search(docs, q, n).collect()}
    assert fresh == {(0, "a.py"): "hit", (0, "b.py"): "hit", (0, "c.py"): "neighbour", (1, "c.py"): "grep"}
    stale = {(r.query_id, r.path): r.origin for r in composed.nav_search(docs, q, n, fresh=False).collect()}
    assert stale == {(0, "a.py"): "grep", (0, "b.py"): "grep", (0, "c.py"): "grep", (1, "c.py"): "grep"}


def test_doctor_states(spark):
    c = spark.createDataFrame([(0, 0, 0, 0), (5, 0, 0, 0), (5, 1, 0, 0), (5, 0, 2, 3), (0, 1, 0, 0)], "spans long, orphans long, pending_enrichments long, pending_embeddings long")
    assert [(r.status, len(r.issues)) for r in composed.doctor(c).collect()] == [("EMPTY", 1), ("OK", 0), ("WARN", 1), ("WARN", 2), ("WARN", 2)]


def test_converted_texts_without_a_word(spark, tmp_path):
    texts = [None, "", "123 456", "日本語", "\u0130stanbul", "Kelvin par", "par x", "ß", "\u0130\u0130 a"]
    rows = [(3 * i + j, t) for i, t in enumerate(texts) for j in range(3)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert compare(spark, catalog.queries()["converted"], catalog.oracle_sql()["converted"], str(tmp_path), con) is None
    assert convert.rtf(b"{\\rtf1\\ansi\r\none\\par\r\ntwo\\par\n}") == "one\ntwo\n"


def test_routes_hold_all_of_a_label(spark):
    r, _ = retrieval.two_routes(spark, SF)
    e = [(x.vec_id, x.label) for x in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "label").collect()]
    got = sorted((x.query_id, x.id) for x in r.filter("route = 'size'").select("query_id", "id").collect())
    assert got == sorted((q, i) for q, _ in e if q % 20 == 0 for i, label in e if label == q % 5)
    few = spark.createDataFrame([(q, q % 2) for q in range(4)], "query_id long, label long"), spark.createDataFrame([(i, i % 2) for i in range(50)], "id long, label long")
    assert sorted((x.query_id, x.id) for x in search.of_key(*few, "label", 7).collect()) == [(q, i) for q in range(4) for i in range(50) if i % 2 == q % 2]


def test_sliding_rate_of_rows_without_time_or_key(spark):
    rows = [(i, k, t, i % 7) for i, (k, t) in enumerate([(k, t) for k in ("a", None) for t in (None, 0, 0, 59, 60, 61, 119, 120, 181) for _ in range(5)])]
    d = spark.createDataFrame(rows, "id long, k string, t long, tok long").withColumn("ts", F.timestamp_seconds("t"))
    got = {r.id: (r.requests, r.used) for r in state.sliding_rate(d, ["k"], "ts", "tok", 60).collect()}
    near = lambda r: [x[3] for x in rows if x[1] == r[1] and (x[2] is None if r[2] is None else x[2] is not None and r[2] - 60 <= x[2] <= r[2])]
    assert got == {r[0]: (len(near(r)), sum(near(r))) for r in rows}
