"""Plans of enrichment, attachments, callers, vector indexes, training examples: odd rows, ties, limits."""

import json

import pytest
from pyspark.sql import functions as F

from spanloom.functions import ignore
from spanloom.operators import analyze, work
from spanloom.operators.composed import trimmed

SPANS = "id long, path string, span_hash string, mtime double, lang string, kind string, start_line int, end_line int"


def test_plan(spark):
    rows = [(5, "a.py", "h5", 10.0, "py", None, 2, 3), (1, "a.py", "h1", 10.0, "py", "class", 1, 1), (2, "b.md", "h2", 10.0, "md", "doc", 1, 1), (3, "gone.py", "h3", 10.0, "py", "x", 1, 9), (4, "new.py", "h4", 99.0, "py", "x", 1, 1),
            (6, "a.py", "h1", 10.0, "py", "again", 3, 3), (7, "a.py", "done", 10.0, "py", "x", 1, 1), (8, None, "h8", None, None, None, 1, 1), (9, "a.py", "h9", None, "py", "empty", 9, 7)]
    spans = spark.createDataFrame(rows, SPANS)
    texts = spark.createDataFrame([("a.py", "one\ntwo\n" + "x" * 50), ("b.md", None)], "path string, text string")
    done = spark.createDataFrame([("done",)], "span_hash string")
    skip = ignore.ignored(F.col("path"), ignore.rules(["*.md"]))
    plan, missing = work.plan(spans, texts, done, skip, 100.0, 50.0, 10, 20)
    got = {r.span_hash: (r.lines, r.code_snippet, r.content_type) for r in plan.collect()}
    assert got == {"h1": ([1, 1], "one", "class"), "h5": ([2, 3], "two\n" + "x" * 15 + "…", "other"), "h9": ([9, 7], "", "empty")}
    assert sorted(str(r.path) for r in missing.collect()) == ["None", "gone.py"]
    assert plan.first().llm_contract.word_caps.usage_snippet == 12
    assert {r.span_hash for r in work.plan(spans, texts, done, skip, 100.0, 0, 3)[0].collect()} == {"h1"}  # the limit comes before what is skipped
    assert work.plan(spans.limit(0), texts, done, skip, 1.0)[0].count() == 0


def test_attached(spark):
    items = spark.createDataFrame([(1, "p", 3, "h"), (2, "p", 3, None), (3, "p", 99, "zz"), (4, "q", 1, None), (5, None, None, None), (6, None, None, "h")], "item int, path string, line int, span_hash string")
    known = spark.createDataFrame([("h", "p", 1, "first"), ("h", "o", 2, "second"), ("g", "p", 3, "third"), ("g", "p", 3, "fourth"), (None, None, None, "lost")], "span_hash string, path string, line int, summary string")
    got = sorted((r.item, r.strategy, r.n, r.summary, r.truncated) for r in work.attached(items, known, 2, 5).collect())
    assert got == [(1, "span", 1, "first", False), (1, "span", 2, "seco…", True), (2, "line", 1, "four…", True), (2, "line", 2, "third", False), (3, "path", 1, "first", False), (3, "path", 2, "four…", True), (6, "span", 1, "first", False), (6, "span", 2, "seco…", True)]
    assert work.attached(items, known).count() == 4


def test_who(spark):
    e = spark.createDataFrame([("a", "b", "CALLS"), ("c", "b", "CALLS"), ("d", "b", "CALLS"), ("b", "x", "IMPORTS"), (None, "b", "USES")], "src string, dst string, type string")
    got = {(r.id, r.title): (r.n, r.first) for r in work.who(spark.createDataFrame([("b",), ("b",), ("z",)], "id string"), e, 2).collect()}
    assert got[("b", "CALLED BY")] == (3, "a,c") and got[("b", "IMPORTS")] == (1, "x") and got[("b", "CALLS")] == (0, None) and got[("z", "CALLED BY")] == (0, None) and len(got) == 8


def test_indexes(spark):
    kind = "index_name string, span_hash string, vector array<float>, route string, profile string"
    old = spark.createDataFrame([("embeddings", "a", [1.0], "r", "old"), ("emb_code", "a", [1.0], "r", "old")], kind)
    new = spark.createDataFrame([("emb_code", "a", [2.0], "r", "new"), ("emb_code", "b", [2.0], "r", "new")], kind)
    assert sorted((r.index_name, r.span_hash, r.profile) for r in work.upsert_vectors(old, new).collect()) == [("emb_code", "a", "new"), ("emb_code", "b", "new"), ("embeddings", "a", "old")]
    for name in ("emb; drop", None):
        with pytest.raises(Exception, match="no such index"):
            work.upsert_vectors(old, new.withColumn("index_name", F.lit(name).cast("string"))).collect()
    r = spark.range(1).select(work.index_name("emb", F.lit("repo"), "shared").alias("a"), work.index_name("emb", F.lit("repo"), "per-repo", "_v2").alias("b")).first()
    assert (r.a, r.b) == ("emb", "emb_repo_v2")


def test_examples(spark):
    c = spark.createDataFrame([("t", {"q": 'a "b"'}, "user\nline", "out"), ("t", None, None, None)], "tool string, arguments map<string,string>, query string, output string")
    a, b = (json.loads(r.value)["messages"] for r in work.tool_examples(c).collect())
    assert [m["role"] for m in a] == ["user", "assistant", "tool"] and a[0]["content"] == "user\nline"
    call = a[1]["tool_calls"][0]
    assert json.loads(call["function"]["arguments"]) == {"q": 'a "b"'} and call["id"] == a[2]["tool_call_id"] and len(call["id"]) == 17
    assert [m["role"] for m in b] == ["user", "assistant", "tool"]


def test_kept_rows_agree_with_their_figures(spark):
    h = spark.createDataFrame([(1, 1, 0.9, "a b c d" * 4), (1, 2, 0.8, "a b c d" * 4), (1, 3, 0.7, "x y z w" * 4), (1, 4, 0.2, "low"), (1, 5, 0.5, None)], "query_id int, id int, relevance double, text string")
    kept, stats = trimmed(h, 14)
    assert {r.id: (r.pick, r.used) for r in kept.collect()} == {1: (1, 7), 3: (2, 14), 5: (3, 14)}  # a null text is like no other and has no tokens
    assert stats.first().asDict() == {"query_id": 1, "given": 5, "relevant": 4, "kept": 3, "used": 14}


def test_analyzer(spark):
    q = spark.createDataFrame([(1, "Who calls getUser and 'Repo.save'?"), (2, "Nothing Here"), (3, None), (4, "trace user_id x übers all of it")], "query_id int, text string")
    assert sorted(q.filter("query_id IN (1, 4)").select(analyze.identifiers(F.col("text")).alias("i")).collect()[0].i) == ["and", "calls", "getuser", "repo.save", "save"]
    e = spark.createDataFrame([("a.GetUser",), ("b.getUser",), ("c.getuser",), ("d.getuser",), ("x.Repo.save",), ("m.user_id",), (None,)], "id string")
    got = {r.query_id: tuple(r)[1:] for r in analyze.analyzed(q, e, e.filter("id LIKE 'a%' OR id LIKE 'x%'")).collect()}
    # words count wherever they occur: call, calls and use are in the first query, and so is all; trace and use are in the last
    assert got == {1: (True, 4, 0.5, 4 + 3 + 2), 2: (False, 0, 0.0, 0), 3: (False, 0, 0.0, 0), 4: (True, 1, 0.0, 1 + 2 + 2)}
    assert analyze.analyzed(q.limit(0), e, e).count() == 0
