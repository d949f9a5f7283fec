"""Single operators with exact values, on small tables."""

import math
import random

import pytest
from pyspark.sql import functions as F

from spanloom.functions import classify, paths, phi, symbols, text, times, vectors
from spanloom.operators import chunking, clinical, embed, fusion, graph, merge, metrics, ranges, search, stats
from spanloom.sources import convert, grep
from spanloom.streaming import state


def values(spark, expr, rows, schema="x string"):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_fusion(spark):
    r = spark.createDataFrame([("r1", "a", 10.0), ("r1", "b", 5.0), ("r1", "c", 0.0), ("r2", "c", 100.0), ("r2", "d", 50.0)], "route string, id string, score double").withColumn("q", F.lit(1))
    w = spark.createDataFrame([("r1", 0.5), ("r2", 0.8)], "route string, weight double")
    got = {x.id: x.score for x in fusion.fuse_max(r, w, ["q"]).collect()}
    assert got == {"a": 5.0, "b": 2.5, "c": 80.0, "d": 40.0}
    zero = spark.createDataFrame([("r2", 0.0)], "route string, weight double")
    assert {x.id for x in fusion.fuse_max(r, zero, ["q"]).collect()} == {"a", "b", "c"}
    got = {x.id: (round(x.score, 9), x.best_rank) for x in fusion.rrf(r, ["q"]).collect()}
    assert got["c"] == (round(1 / 63 + 1 / 61, 9), 1) and got["a"] == (round(1 / 61, 9), 1)
    n = {(x.route, x.id): x.normalized for x in fusion.min_max(r, ["q", "route"]).collect()}
    assert n["r1", "a"] == 1 and n["r1", "b"] == 0.5 and n["r1", "c"] == 0
    same = spark.createDataFrame([(1, 2.0), (1, 2.0), (2, 0.0)], "k int, score double")
    assert sorted(x.normalized for x in fusion.min_max(same, ["k"]).collect()) == [0, 1, 1]
    z = {x.id: x.score for x in fusion.fuse_z(r, w, ["q"]).collect()}
    assert z["a"] == pytest.approx(0.5) and z["d"] == pytest.approx(-0.8 * math.sqrt(0.5))
    few = {x.id: x.score for x in fusion.fuse_z(r.filter("route = 'r2'"), w, ["q"]).collect()}
    assert few == {"c": pytest.approx(1 / 61), "d": pytest.approx(1 / 62)}


def test_interleave(spark):
    r = spark.createDataFrame([(i, i < 12) for i in range(15)], "id int, high boolean")
    order = [x.high for x in fusion.interleave(r, "high", ["id"]).orderBy("slot").collect()]
    assert order == [True] * 5 + [False] + [True] * 5 + [False] + [True] * 2 + [False]


def test_bm25_has_no_stop_words(spark):
    words = ["model", "system", "data", "select", "train", "router", "pipeline"]
    docs = spark.createDataFrame([(i, f"the {w} of it") for i, w in enumerate(words)], "id long, text string")
    q = spark.createDataFrame([(i, w) for i, w in enumerate(words)] + [(99, "model data"), (100, "")], "query_id long, text string")
    got = sorted((r.query_id, r.id) for r in search.bm25(search.postings(docs), q, 7, 4.0).collect())
    assert got == [(i, i) for i in range(7)]
    some = search.bm25(search.postings(docs), q.filter("query_id = 99"), 7, 4.0, every=False).collect()
    assert len(some) == 2 and all(r.score_pos > 0 and r.bm25 == -r.score_pos for r in some)


def test_rerank_and_weights(spark):
    assert sum(search.normalize_weights({"bm25": 2, "uni": -1}).values()) == pytest.approx(1)
    assert search.normalize_weights({}) == search.RERANK and search.normalize_weights({"bm25": 0, "uni": 0, "bi": 0, "path": 0, "lit": 0, "ext": 0}) == search.RERANK
    h = spark.createDataFrame([(1, "foo bar", "src/foo.py", "foo bar baz", -2.0), (2, "foo bar", "tests/test_foo.py", "other text", None)], "id int, query string, path string, text string, bm25 double")
    s = {r.id: r.rerank for r in search.rerank(h).collect()}
    assert s[1] == pytest.approx(0.55 + 0.18 * 2 / 3 + 0.12 * 0.5 + 0.07 * 0.25 + 0.02 + 0.06) and s[1] > s[2]
    hits = spark.createDataFrame([(1, c, i) for i, c in enumerate("abc", 1)], "query_id int, id string, rank int")
    a = spark.createDataFrame([(1, '["2","1"]')], "query_id int, response string")
    assert [r.id for r in search.setwise(hits, a, 3).orderBy("rank").collect()] == ["b", "a", "c"]
    bad = spark.createDataFrame([(1, "none")], "query_id int, response string")
    assert [r.id for r in search.setwise(hits, bad, 3).orderBy("rank").collect()] == ["a", "b", "c"]


def test_expand(spark):
    hits = spark.createDataFrame([(1, 1, "a.py", "f", 10.0), (1, 2, "b.py", "hub", 8.0)], "query_id int, rank int, path string, symbol string, score double")
    ix = spark.createDataFrame([("f", p) for p in ("z.py", "c.py", "d.py", "e.py", "a.py")] + [("hub", f"h{i}.py") for i in range(100)], "key string, path string")
    got = {(r.path, r.score) for r in search.expand(hits, ix).filter("origin = 'neighbour'").collect()}
    assert got == {("c.py", 4.0), ("d.py", 4.0)}


def test_mmr(spark):
    d = spark.createDataFrame([(1, "a", 1.0, "x y z"), (1, "b", 0.9, "x y z"), (1, "c", 0.8, "p q r"), (2, "d", 0.5, None)], "query_id int, id string, relevance double, text string")
    assert [r.id for r in search.mmr(d).orderBy("query_id", "pick").collect()] == ["a", "c", "b", "d"]


def test_metrics(spark):
    r = spark.createDataFrame([(1, "a", 1, False, 0), (1, "b", 2, True, 2), (2, "c", 1, True, 1), (3, "d", 1, False, 0)], "query_id int, id string, rank int, rel boolean, grade int")
    assert metrics.mrr(r).first().mrr == pytest.approx((0.5 + 1) / 3)
    assert metrics.hit_rate(r, 1).first()[0] == pytest.approx(1 / 3) and metrics.precision(r, 10).first()[0] == pytest.approx(0.2 / 3)
    n = {x.query_id: x.ndcg for x in metrics.ndcg(r, 10).collect()}
    assert n[1] == pytest.approx(1 / math.log2(3)) and n[2] == 1 and n[3] == 0
    t = spark.createDataFrame([(1, 2), (2, 1)], "query_id int, truth long")
    a = {x.query_id: (x.ap, x.recall) for x in metrics.average_precision(r, t).collect()}
    assert a == {1: (0.25, 0.5), 2: (1.0, 1.0), 3: (0.0, 1.0)}


def test_ranges_against_loops(spark):
    g = random.Random(2)
    rows = [(g.randrange(4), a := g.randrange(600), a + g.randrange(300)) for _ in range(200)]
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, k int, a int, b int")
    got = sorted((r.i, r.j) for r in ranges.overlap_join(d, d.toDF("j", "k", "c", "d"), "k", ("a", "b"), ("c", "d")).collect())
    assert got == sorted((i, j) for i, x in enumerate(rows) for j, y in enumerate(rows) if x[0] == y[0] and x[1] <= y[2] and y[1] <= x[2])
    want = []
    for k in range(4):
        for a, b in sorted((a, b) for q, a, b in rows if q == k):
            if want and want[-1][0] == k and a <= want[-1][2] + 1:
                want[-1][2] = max(want[-1][2], b)
            else:
                want.append([k, a, b])
    assert sorted([r.k, r.a, r.b] for r in ranges.merge_ranges(d.drop("i"), ["k"], "a", "b").collect()) == sorted(want)
    budget = ranges.prefix_within(spark.createDataFrame([(1, 1, 5), (1, 2, 5), (1, 3, 1)], "k int, n int, c int"), ["k"], [F.col("n")], F.col("c"), 9)
    assert [r.n for r in budget.collect()] == [1]


def test_merge(spark):
    old = spark.createDataFrame([("f1", "a"), ("f1", "b"), ("f2", "c")], "f string, h string")
    new = spark.createDataFrame([("f1", "b"), ("f1", "d")], "f string, h string")
    assert sorted(map(tuple, merge.replace_groups(old, new, "f", "h").collect())) == [("f1", "a", "delete"), ("f1", "b", "keep"), ("f1", "d", "insert"), ("f2", "c", "keep")]
    assert sorted(map(tuple, merge.upsert(old, spark.createDataFrame([("f2", "z")], "f string, h string"), ["f"]).collect())) == [("f1", "a"), ("f1", "b"), ("f2", "z")]
    n = spark.createDataFrame([("x", {"a": "1", "b": "2"})], "id string, meta map<string,string>")
    p = spark.createDataFrame([("x", {"b": "3"}), ("y", {})], "id string, meta map<string,string>")
    e = spark.createDataFrame([("x", "y"), ("x", "gone")], "src string, dst string")
    out, edges, conflicts = merge.patch_graph(n, e.limit(0), p, e)
    assert {r.id: r.meta for r in out.collect()} == {"x": {"a": "1", "b": "3"}, "y": {}}
    assert edges.collect() == [("x", "y")] and conflicts.collect() == [("x", "b")]


def test_quantiles_are_exclusive(spark):
    import statistics

    v = [float(x) for x in (3, 1, 4, 1, 5, 9, 2, 6)]
    d = spark.createDataFrame([("a", x) for x in v] + [("b", 1.0)] * 3, "k string, v double")
    got = sorted((r.p, r.value) for r in stats.quantiles_exclusive(d, "k", "v", [0.25, 0.5, 0.75]).collect())
    assert [x for _, x in got] == pytest.approx(statistics.quantiles(v, n=4))


def test_graph(spark):
    e = spark.createDataFrame([("a", "b", "CALLS"), ("b", "c", "CALLS"), ("c", "a", "CALLS"), ("c", "d", "CALLS"), ("x", "x", "CALLS")], "src string, dst string, type string")
    n = spark.createDataFrame([(i, i, "function", f"{i}.py") for i in "abcd"], "id string, name string, kind string, path string")
    start = spark.createDataFrame([("a",)], "id string")
    assert sorted((r.id, r.distance) for r in graph.reach(e, start, 5).collect()) == [("a", 3), ("b", 1), ("c", 2), ("d", 3)]
    assert {r.id for r in graph.with_stubs(n, e).filter("kind = 'stub'").collect()} == {"x"}
    assert sorted(r.path for r in graph.cycles(e, 3).collect()) == [["a", "b", "c"], ["x"]]
    p = spark.createDataFrame([("a", "d"), ("d", "a")], "src string, dst string")
    assert [tuple(r) for r in graph.shortest_paths(e, p).collect()] == [("a", "d", 3, ["a", "b", "c", "d"])]
    used = graph.where_used(graph.user_files(n, e, ["CALLS"]), spark.createDataFrame([("c",), ("a",)], "symbol string"), 5)
    assert sorted(map(tuple, used.collect())) == [("a", 1, "c.py"), ("c", 1, "b.py")]


def test_pagerank_against_loop(spark):
    links = [("a", "b"), ("a", "c"), ("b", "c"), ("c", "a"), ("d", "c"), ("e", "d")]
    ids = "abcdef"
    r = dict.fromkeys(ids, 1 / 6)
    for _ in range(200):
        lost = sum(r[i] for i in ids if not any(s == i for s, _ in links))
        r = {i: 0.15 / 6 + 0.85 * lost / 6 + 0.85 * sum(r[s] / sum(a == s for a, _ in links) for s, d in links if d == i) for i in ids}
    got = graph.pagerank(spark.createDataFrame(links, "src string, dst string"), spark.createDataFrame([(i,) for i in ids], "id string"), tolerance=1e-9)
    assert {x.id: x.score for x in got.collect()} == pytest.approx(r, abs=1e-6)


def test_symbols_and_paths(spark):
    assert values(spark, symbols.candidate_keys(F.col("x")), [("tools.auth.jwt:Cls.verify",), ("pkg.mod.f",), ("f",)]) == [["tools.auth.jwt:Cls.verify", "Cls.verify", "jwt.verify", "verify"], ["pkg.mod.f", "f"], ["f"]]
    assert values(spark, paths.any_glob(F.col("x"), ["*.pyc", "build/", "a[!b]?"]), [("x/y.pyc",), ("build/z",), ("acd",), ("abd",), ("n",)]) == [True, True, True, False, False]
    assert values(spark, paths.priority(F.col("x")), [("a.py",), ("b.md",), ("c",), (".py",)]) == [3, 7, 5, 5]
    assert values(spark, classify.filename_score(F.lit("Router.py"), F.col("x")), [("a/router.py",), ("a/my_router.py",), ("b.py",)]) == [0.35, 0.08, 0.0]
    assert values(spark, symbols.match_score(F.lit("Foo"), F.col("x")), [("Foo",), ("foo",), ("a.FOO",), ("xfoox",), ("bar",)]) == [1.0, 0.9, 0.7, 0.5, None]


def test_classifiers(spark):
    assert values(spark, classify.summary_quality(F.col("x")), [("",), (" — ",), ("...",), ("TODO: later",), ("、。",), ("短い",), ("とても長い日本語の要約です",), ("word",), ("two words",), (None,)]) == ["EMPTY", "PLACEHOLDER", "PLACEHOLDER", "PLACEHOLDER", "EMPTY", "SHORT", "OK", "SHORT", "OK", "EMPTY"]
    r = classify.route(F.col("x"))
    got = values(spark, F.struct(r["route"], r["confidence"]), [("",), (None,), ("where is cli.py",), ("price of AB-1234",), ("return the invoice",), ("hello there",), ("```py\nx = 1\n```",)])
    assert [tuple(g) for g in got] == [("docs", 0.2), ("docs", 0.2), ("code", 0.95), ("erp", 0.85), ("code", 0.8), ("docs", 0.5), ("code", 0.95)]
    assert values(spark, classify.route(F.lit("x"), F.col("x"))["route"], [("code_tool",), ("product_lookup",), ("x",)]) == ["code", "erp", "docs"]
    assert values(spark, classify.slice_type(F.col("x"), F.lit("sku: 1"))["type"], [("a/erp/x.json",), ("b.json",), ("c.py",), ("d",)]) == ["erp_product", "erp_product", "code", "other"]
    assert values(spark, classify.forced_tier(F.col("x")), [("fix it",), ("write tests",), ("design",), ("hm",)]) == ["local", "mid", "premium", None]
    assert values(spark, classify.tool_tier(F.col("x")), [("please fix",), ("show me",), ("hm",)]) == ["run", "walk", "crawl"]
    assert values(spark, classify.freshness(F.col("x"), F.lit("a")), [("a",), ("b",), (None,)]) == ["FRESH", "STALE", "UNKNOWN"]


def test_text(spark):
    assert values(spark, text.bigrams(text.tokens(F.col("x"))), [("Foo bar_1 a baz",), ("x",), (None,)]) == [["foo bar_1", "bar_1 baz"], [], []]
    assert values(spark, text.ellipsis(F.col("x"), 4), [("abcd",), ("abcde",)]) == ["abcd", "abc…"]
    assert values(spark, text.first_sentence(F.col("x")), [("One two. Three",), ("v1.2 is. small",)]) == ["One two.", "v1.2 is. small"]
    assert values(spark, text.slug(F.col("x")), [(" A b--C! ",)]) == ["a-b-c"]
    assert values(spark, text.score_confidence(F.col("x")), [(0.0,), (4.0,), (1e9,)], "x double") == [0.0, 0.5, 0.99]
    assert values(spark, search.normalize_bm25(F.col("x")), [(-5.0,), (1.0,), (float("nan"),), (None,)], "x double") == [1.0, 0.5, 1.0, 1.0]
    assert values(spark, vectors.cosine(F.col("x"), F.array(F.lit(1.0), F.lit(0.0))), [([2.0, 0.0],), ([0.0, 0.0],)], "x array<float>") == [1.0, 0.0]
    assert values(spark, times.within_schedule(F.col("x").cast("timestamp"), 1320, 360), [("2024-01-01 23:00:00",), ("2024-01-01 05:59:00",), ("2024-01-01 06:00:00",)]) == [True, True, False]


def test_phi():
    t = "SSN 123-45-6789, call 555-123-4567 or mail a.b@c.org on 01/31/2024, MRN: AB12345"
    kinds = [k for _, _, k in phi.find(t)]
    assert kinds[:1] == ["SSN"] and "PHONE" in kinds and "EMAIL" in kinds and "DATE" in kinds
    assert all(a[1] <= b[0] for a, b in zip(phi.find(t), phi.find(t)[1:], strict=False))
    days = phi.day_offset("p1")
    assert -365 <= days < 365 and phi.shift_date("01/31/2024", 1) == "02/01/2024" and phi.shift_date("x", 1) is None
    out = phi.redact(t, "p1")
    assert "[REDACTED_SSN]" in out and phi.shift_date("01/31/2024", days) in out
    assert phi.redact("12/01/2023", None) == "[REDACTED_DATE]" and phi.redact("12/01/2023", None, frozenset(["DATE"])) == "[REDACTED]"
    names = phi.redact("1.2.3.4: Mr. John Smith; 5.6.7.8: Mr. Jane Roe")
    assert names.index("[NAME_2]") < names.index("[NAME_1]")


def test_clinical(spark):
    n = spark.createDataFrame([(1, "intro\nMEDICATIONS\nAspirin 5mg\n\nLabs:\nNa 140\n10 am\nPlan:\n"), (2, "text")], "id int, text string")
    s = [(r.id, r.section, r.start_line) for r in clinical.sections(n).orderBy("id", "start_line").collect()]
    assert s == [(1, "unknown", 0), (1, "medications", 1), (1, "labs", 4), (1, "plan", 7), (2, "unknown", 0)]
    assert sorted((r.kind, r["name"], r["value"]) for r in clinical.items(n).collect()) == [("lab", "Na", 140.0), ("medication", "Aspirin", None)]
    r = clinical.relations(spark.createDataFrame([(1, "Asthma is treated with steroids")], "id int, text string")).collect()
    assert [(x.source, x.target, x.type, x.confidence) for x in r] == [("Asthma", "steroids", "TREATED_BY", 0.9)]
    assert values(spark, phi.section_of(F.col("x")), [("HPI:",), ("Clinical impression today",), ("zzz",)]) == ["subjective", "assessment", None]
    assert values(spark, phi.negation_factor(F.col("x")), [("no evidence of it",), ("evidence of it",), ("it",)]) == [0.3, 1.5, 1.0]


def test_chunking(spark):
    assert chunking.fill(["aa", "bb", "cc"], 6, 1) == [["aa", "bb"], ["cc"]] and chunking.fill(["x" * 9], 3, 1) == [["x" * 9]]
    t = "".join(f"line {i} of a text\n" for i in range(200))
    w = chunking.windows(t, 300, 50)
    assert w[0][0] == 0 and w[-1][1] == len(t) and all(b - a <= 300 for a, b in w) and all(w[i + 1][0] == w[i][1] - 50 for i in range(len(w) - 1))
    md = "intro\n# A\ntext\n## B\n```\n# no heading\n```\n# A\nend"
    assert [(p, a, b) for p, _, a, b, _ in chunking.sections_of(md)] == [("", 1, 1), ("A", 2, 3), ("A > B", 4, 7), ("A", 8, 9)]
    r = chunking.markdown_sections(spark.createDataFrame([(1, md)], "id int, text string")).collect()
    assert [x.slug for x in r] == ["", "a", "b", "a-1"]
    py = "class A:\n    '''Doc.'''\n    def f(self):\n        return g()\n\ndef g():\n    def h(): pass\n"
    assert [(s, k, a, b) for s, k, a, b, _ in chunking.python_spans(py)] == [("A", "class", 1, 4), ("A.f", "method", 3, 4), ("g", "function", 6, 7), ("g.h", "function", 7, 7)]
    assert chunking.python_spans("def (") == []
    js = "export class A {\n  run(x) {\n    if (x) {\n    }\n  }\n}\nfunction f() {\n}\n"
    assert [(s, k, a, b) for s, k, a, b, _ in chunking.brace_spans(js, "javascript")] == [("A", "class", 1, 6), ("A.run", "method", 2, 5), ("f", "function", 7, 8)]
    go = "type T struct {\n}\nfunc (t *T) Run() {\n}\nfunc f() {\n}\n"
    assert [(s, k) for s, k, *_ in chunking.brace_spans(go, "go")] == [("T", "type"), ("T.Run", "method"), ("f", "function")]
    g = set(chunking.python_graph("import os\nclass B(os.PathLike):\n    def f(self):\n        return h()\ndef h(): pass\n", "m"))
    assert {("entity", "type:m.B", "class", "2-4"), ("relation", "type:m.B", "EXTENDS", "type:os.PathLike"), ("relation", "sym:m.B.f", "CALLS", "sym:m.h"), ("relation", "mod:m", "IMPORTS", "mod:os")} <= g
    assert "return" not in chunking.skeleton(py) and "def f(self):" in chunking.skeleton(py)
    s = chunking.spans(spark.createDataFrame([(1, py, "python")], "id int, text string, lang string"))
    assert chunking.symbol_at(s, spark.createDataFrame([(1, 4)], "id int, line int")).first().symbol == "A.f"
    assert chunking.fences("```py\nx\n```\n```\ny") == 1
    assert chunking.regex_hits(spark.createDataFrame([(1, "a\nba")], "id int, text string"), "a").collect()[1].start_line == 2
    assert "invalid" in chunking.regex_hits(spark.createDataFrame([(1, "a")], "id int, text string"), "(").first().hit


def test_sources(spark, tmp_path):
    f = spark.createDataFrame([(1, "one\ntwo\nthree")], "id int, text string")
    assert [(r.line_no, r.line) for r in grep.grep(f, "t[wh]").collect()] == [(2, "two"), (3, "three")]
    assert f.select(grep.snippet(F.col("text"), F.lit(1), F.lit(1), 1)).first()[0] == "one\ntwo"
    assert values(spark, convert.html_text(F.col("x")), [("<p>a &lt; b</p><script>x</script><div>c<br>d</div>",)]) == ["a < b\nc\nd"]
    assert convert.rtf(rb"{\rtf1{\fonttbl{\f0 Arial;}}\f0 Hi \b there\b0\par caf\'e9}") == "Hi there\ncafé"
    b = spark.createDataFrame([("a.txt", bytearray(b"hi")), ("b.docx", bytearray(b"broken"))], "path string, content binary")
    assert {r.path: r.text for r in convert.convert(b, paths.extension(F.concat(F.lit("x/"), "path"))).collect()} == {"a.txt": "hi", "b.docx": None}
    from spanloom.sources import files

    (tmp_path / "g.json").write_text('{"schema_graph": {"entities": {"e1": {"name": "f", "kind": "function", "file_path": "a.py"}}, "relations": [{"src": "e1", "edge": "calls", "dst": "e2"}]}}')
    n, e = files.graph_json(spark, str(tmp_path / "g.json"))
    assert [tuple(r) for r in n.collect()] == [("e1", "f", "function", "a.py")] and [tuple(r) for r in e.collect()] == [("e1", "e2", "CALLS")]
    (tmp_path / "h.json").write_text('{"nodes": [{"id": "n1", "path": "b.py"}], "links": [{"source": "n1", "target": "n2", "type": "uses"}]}')
    n, e = files.graph_json(spark, str(tmp_path / "h.json"))
    assert n.first().id == "n1" and tuple(e.first()) == ("n1", "n2", "USES")
    (tmp_path / "q.json").write_text('{"queries": [{"query_id": "1", "text": "t", "judgments": [{"doc_id": "d", "score": 2}]}]}')
    assert tuple(files.query_set(spark, str(tmp_path / "q.json")).first()) == ("1", "t", "d", 2.0)
    (tmp_path / "r.yml").write_text("main:\n  path: /x\n  lang: 'py'\n")
    assert files.registry(spark, str(tmp_path / "r.yml")).count() == 2
    (tmp_path / "j.jsonl").write_text('{"q": "a"}\nnot json\n')
    assert files.jsonl(spark, str(tmp_path / "j.jsonl"), "q string").cache().filter("_corrupt IS NOT NULL").count() == 1


def test_embedding(spark):
    v = embed.hash_vector("text", 40)
    assert len(v) == 40 and sum(x * x for x in v) == pytest.approx(1) and v == embed.hash_vector("text", 40) != embed.hash_vector("other", 40)
    assert embed.hash_vectors(spark.createDataFrame([(1, None), (2, "a")], "id int, text string"), "id", 8).count() == 2


def test_state(spark):
    f = spark.createDataFrame([("a",)] * 7 + [("b",)] * 2 + [("c",)] * 4, "k string")
    got = {r.k: (r.tier, r.attempts, r.permanent) for r in state.escalation(f, ["k"]).collect()}
    assert got == {"a": (1, 3, True), "b": (0, 2, False), "c": (1, 1, False)}
    q = spark.createDataFrame([(1, 5, "2024-01-01", None), (2, 3, "2024-01-02", None), (3, 1, "2024-01-01", "w")], "id int, priority int, created string, claimed_by string")
    c = state.claim(q, "me", 1)
    assert [r.id for r in c.collect()] == [2]
    assert {r.id for r in state.acknowledge(q, spark.createDataFrame([(3, "w"), (1, "x")], "id int, worker string")).collect()} == {1, 2}
    e = spark.createDataFrame([("a", i, ok) for i, ok in enumerate([True, False, False, True, False])], "k string, i int, ok boolean")
    assert [r.streak for r in state.failure_runs(e, "k", ["i"], "ok", 2).orderBy("i").collect()] == [0, 1, 2, 0, 1]
    t = spark.createDataFrame([("a", f"2024-01-01 00:00:{s:02}") for s in (0, 1, 5, 6)], "k string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted(r.n for r in state.debounce(t, "k", "ts", "2 seconds").collect()) == [2, 2]


def test_text_scan_of_names_with_marks_and_long_ones(spark):
    long = "x" * 40
    texts = ["def foo-bar(a):\ndef b,(\nclass two words:\n", f"def {long}(\n  my{long}(1)", "a foo-bar(1) c,b,(2)", "see two words(3) bar(4) words(5)", f"y{'x' * 39}(6)", "no call foo-bar"]
    got = {(r.src, r.dst) for r in graph.text_scan(spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(texts)], "path string, text string"))[1].collect()}
    names = ["foo-bar", "b,", "two words", long]
    want = {(f"f{i}", n) for i, t in enumerate(texts) for n in names if n + "(" in t}
    assert got == want | {(n, p) for p, n in want}
