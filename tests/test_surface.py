"""The tools in SQL, packed contexts, public results and the feeder: odd rows and limits."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from spanloom import sqltools
from spanloom.operators import clinical, context

NODES = [("a", "alpha", "function", "f1.py"), ("b", "beta", "class", "f2.py"), ("c", "gamma", "class", "f3.py"), ("d", None, "class", None)]
EDGES = [("b", "a", "CALLS"), ("c", "a", "USES"), ("c", "b", "EXTENDS"), ("a", "x", "CALLS"), ("b", "c", "LIKES")]


@pytest.fixture
def tools(spark):
    sqltools.register(spark, spark.createDataFrame(NODES, "id string, name string, kind string, path string"), spark.createDataFrame(EDGES, "src string, dst string, type string"), "small")
    return lambda q: [tuple(r) for r in spark.sql(q).collect()]


def test_functions_of_symbols(tools):
    assert tools("SELECT * FROM where_used('alpha', 10) ORDER BY rank") == [("f2.py", 1), ("f3.py", 2)]
    assert tools("SELECT * FROM where_used('alpha', 1)") == [("f2.py", 1)]
    assert tools("SELECT * FROM where_used('nothing', 5)") == tools("SELECT * FROM where_used(NULL, 5)") == []
    assert tools("SELECT * FROM lineage('c', 5) ORDER BY rank") == [("f1.py", 1), ("f2.py", 2)]
    twice = tools("SELECT s, w.path FROM VALUES ('alpha'), ('alpha'), ('zeta') t(s), LATERAL where_used(s, 1) w")
    assert twice == [("alpha", "f2.py")] * 2
    assert tools("SELECT * FROM neighbours('b', 1) ORDER BY direction") == [("in", "EXTENDS", "c", 1), ("out", "CALLS", "a", 1)]
    assert dict(tools("SELECT * FROM rag_stats()")) == {"nodes": 4, "edges": 5, "CALLS": 2, "USES": 1, "EXTENDS": 1, "LIKES": 1}


def test_functions_of_tables(spark, tools):
    rows = [("k1", 3, 5), ("k1", 1, None), ("k1", 2, 4), ("k2", 1, 100), (None, 1, 1)]
    spark.createDataFrame(rows, "k string, v int, c int").createOrReplaceTempView("some_rows")
    first = tools("SELECT * FROM first_of(TABLE(some_rows), key => 'k', sorted_by => 'v', n => 2)")
    assert sorted(first, key=str) == sorted([("k1", 1, None, 1), ("k1", 2, 4, 2), ("k2", 1, 100, 1), (None, 1, 1, 1)], key=str)
    spent = tools("SELECT * FROM take_budget(TABLE(some_rows) PARTITION BY k ORDER BY v, cost => 'c', budget => 8)")
    assert sorted(spent, key=str) == sorted([("k1", 1, None, 0), ("k1", 2, 4, 4), (None, 1, 1, 1)], key=str)
    assert tools("SELECT * FROM first_of(TABLE(SELECT * FROM some_rows WHERE false), key => 'k', sorted_by => 'v', n => 2)") == []
    for bad in ("first_of(TABLE(some_rows), key => 'none', sorted_by => 'v', n => 2)", "first_of(TABLE(some_rows), key => 'k', sorted_by => 'v', n => 0)", "take_budget(TABLE(some_rows) WITH SINGLE PARTITION, cost => 'zz', budget => 1)"):
        with pytest.raises(AnalysisException):
            spark.sql(f"SELECT * FROM {bad}").collect()


def packed(spark, hits, budget, limit=20):
    t = spark.createDataFrame([(1, "p", "do it")], "query_id int, project string, task string")
    h = spark.createDataFrame(hits, "query_id int, rank int, path string, relevance double, text string")
    r = context.task_context(t, h, budget, limit).collect()
    assert len(r) == 1
    return r[0]


def test_contexts(spark):
    head = "# Project: p\n# Task: do it\n\n## Relevant Code Context:\n## Files referenced: {}\n\n"
    r = packed(spark, [(1, 1, "a.py", 0.625, "x y"), (1, 2, None, 0.5, None), (1, 3, "a.py", 0.25, "z")], 1000)
    assert r.context == head.format(2) + "\n\n### a.py (relevance: 0.63)\n```\nx y\n```\n\n\n### unknown (relevance: 0.50)\n```\n\n```\n\n\n### a.py (relevance: 0.25)\n```\nz\n```\n"
    assert (r.words, r.files) == (11 + 8 + 6 + 7, 2)
    assert packed(spark, [(1, 1, "a.py", 0.5, "x y"), (1, 2, "b.py", 0.5, "z " * 99), (1, 3, "c.py", 0.4, "w")], 30).words == 19  # the first that does not fit ends it
    assert packed(spark, [(1, 1, "a.py", 0.5, "x " * 99)], 30).context == head.format(0)
    assert packed(spark, [(1, i, "a.py", 0.5, "x") for i in range(1, 9)], 1000, 3).words == 11 + 3 * 7
    none = packed(spark, [(2, 1, "a.py", 0.5, "x")], 30)
    assert none.context == "Project: p\nNo relevant context found.\n" and (none.words, none.files) == (0, 0)


def test_public_results(spark):
    r = spark.createDataFrame([(1, 2, 3, 4)], "id int, _score int, slice_id int, `a.b` int")
    assert context.public(r).columns == ["id", "a.b"] and context.public(r).collect() == [(1, 4)]


def test_feed(spark):
    s = spark.createDataFrame([(i, f"r{i % 2}", f"p{i}{'.py' if i % 3 else '.md'}", f"h{i // 4}") for i in range(20)] + [(99, None, "n.py", "h")], "id long, repo string, path string, span_hash string")
    done = spark.createDataFrame([("r0", "h0")], "repo string, span_hash string")
    queued = spark.createDataFrame([("r1", "h1")], "repo string, span_hash string")
    got = {tuple(r) for r in context.feed(s, done, queued, 4).collect()}
    assert got == {("r0", "h1", "p4.py", 3), ("r0", "h2", "p8.py", 3), ("r1", "h0", "p1.py", 3), (None, "h", "n.py", 3)}


def test_relations_of_every_expression(spark):
    said = [("flu can be treated with rest", "TREATED_BY", 1.0), ("flu therapy includes rest", "TREATED_BY", 0.8), ("flu monitoring includes x", "MONITORED_BY", 0.8), ("a avoid in b", "CONTRAINDICATES", 0.8), ("a can exacerbate b", "CONTRAINDICATES", 0.7), ("a side effects include b", "ADVERSE_EVENT", 0.8), ("a linked to b as adverse event", "ADVERSE_EVENT", 0.8), ("nothing here", None, None), (None, None, None)]
    rows = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(said)], "id int, text string")
    got = {r.id: (r.type, round(r.confidence, 6)) for r in clinical.relations(rows).filter(F.col("type").isNotNull()).collect()}
    assert got == {i: (k, c) for i, (_, k, c) in enumerate(said) if k}
