"""The inverted index, the span store and the graph searches, on small exact cases."""

import itertools
import math
import random
import re
import uuid

import pytest
from pyspark.sql import functions as F

from spanloom.operators import composed, graph, ranges, search, textindex
from spanloom.runtime import scratch_dir
from spanloom.streaming import leases, sync


def tokens(text):
    return [t for t in re.findall("[a-z0-9_]+", (text or "").lower()) if len(t) > 1]


def bm25(docs, query, weights, every=True):
    """{id: score} over {id: {field: text}}."""
    out, terms = {}, list(dict.fromkeys(tokens(query)))
    hit = {}
    for f, w in weights.items():
        lens = {i: len(tokens(d[f])) for i, d in docs.items()}
        avg = sum(lens.values()) / len(docs)
        for t in terms:
            tf = {i: tokens(d[f]).count(t) for i, d in docs.items()}
            df = sum(n > 0 for n in tf.values())
            for i, n in tf.items():
                if n:
                    idf = math.log(1 + (len(docs) - df + 0.5) / (df + 0.5))
                    out[i] = out.get(i, 0) + w * idf * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * lens[i] / avg))
                    hit.setdefault(i, set()).add(t)
    return {i: s for i, s in out.items() if not every or len(hit[i]) == len(terms)}


def some_docs(rnd, ids):
    words = ["alpha", "beta", "gamma", "delta", "x1", "rare", "a", "of"]
    return {i: {"title": rnd.choice([None, "", "alpha beta", "rare Alpha", " ".join(rnd.choices(words, k=3))]), "body": " ".join(rnd.choices(words, [9, 5, 3, 2, 1, 0.2, 4, 6], k=rnd.randrange(30)))} for i in ids}


def frame(spark, docs):
    return spark.createDataFrame([(i, d["title"], d["body"]) for i, d in docs.items()], "id long, title string, body string")


@pytest.mark.parametrize("block", [2])
def test_index_through_updates_and_merge(spark, monkeypatch, block):
    monkeypatch.setattr(textindex, "BLOCK", block)
    monkeypatch.setattr(textindex, "BUCKETS", 4)
    rnd = random.Random(block)
    docs = some_docs(rnd, range(200))
    queries = ["alpha", "alpha beta", "rare gamma", "Alpha of RARE alpha", "nothing", "x1 delta", ""]
    q = spark.createDataFrame(list(enumerate(queries)), "query_id long, text string")
    weights = {"title": 2.0, "body": 1.0}

    def check(index, every=True):
        every_hit = {(r.query_id, r.id): r.score_pos for r in index.hits(q, weights, every=every).collect()}
        want = {(k, i): s for k, text in enumerate(queries) for i, s in bm25(docs, text, weights, every).items()}
        assert every_hit == pytest.approx(want)
        for fields in ({"body": 1.0}, weights):
            best = {}
            for r in index.hits(q, fields, 5, every).collect():
                best.setdefault(r.query_id, []).append((-round(r.score_pos, 6), r.id))
            for k, text in enumerate(queries):
                w = sorted((-round(s, 6), i) for i, s in bm25(docs, text, fields, every).items())[:5]
                assert sorted(best.get(k, []))[:5] == w

    index = textindex.index_of(frame(spark, docs), f"{scratch_dir(spark)}/ix-{uuid.uuid4().hex}", ["title", "body"])
    check(index)
    new = some_docs(rnd, [3, 5, 7, 500, 501])
    index.update(frame(spark, new), ["title", "body"], spark.createDataFrame([(9,), (11,), (999,)], "id long"))
    docs = {i: d for i, d in (docs | new).items() if i not in (9, 11)}
    check(index)
    again = some_docs(rnd, [3, 9])  # replaced twice, and back after it was removed
    index.update(frame(spark, again), ["title", "body"])
    docs |= again
    check(index, every=False)
    assert len(index.manifest["segments"]) == 3
    figures = dict(index.manifest["figures"])
    index.merge()
    check(index)
    check(textindex.TextIndex(spark, index.path))  # what another reader sees
    assert len(index.manifest["segments"]) == 1 and index.manifest["figures"] == figures
    assert figures["body"] == [len(docs), sum(len(tokens(d["body"])) for d in docs.values())]


def test_blocks_that_cannot_reach_the_best_stay_closed(spark, monkeypatch):
    monkeypatch.setattr(textindex, "BLOCK", 10)
    docs = {i: {"title": "", "body": "word " * (1 + 30 * (i < 12)) + "filler " * 40} for i in range(600)}
    index = textindex.index_of(frame(spark, docs), f"{scratch_dir(spark)}/ix-{uuid.uuid4().hex}", ["title", "body"])
    q = spark.createDataFrame([(0, "word")], "query_id long, text string")
    assert index.hits(q, {"body": 1.0}).count() == 600
    assert 5 <= index.hits(q, {"body": 1.0}, 5).count() < 60  # only what was opened comes out


def test_two_writers_of_one_version(spark):
    path = f"{scratch_dir(spark)}/ix-{uuid.uuid4().hex}"
    docs = frame(spark, some_docs(random.Random(1), range(5)))
    textindex.index_of(docs, path, ["body"])
    a, b = textindex.TextIndex(spark, path), textindex.TextIndex(spark, path)
    a.update(docs, ["body"])
    with pytest.raises(Exception, match="(?i)exist"):
        b.update(docs, ["body"])
    assert textindex.TextIndex(spark, path).manifest == a.manifest


def lines(texts):
    return texts.select("path", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def test_span_store(spark):
    store = sync.SpanStore(spark, f"{scratch_dir(spark)}/st-{uuid.uuid4().hex}", lines, 8)
    files = {f"d{i}/f{i}.py": f"a{i}\nb{i}" for i in range(40)}
    batch = lambda rows: spark.createDataFrame(rows, "path string, seq int, text string")

    def check():
        got = {(r.path, r.pos, r.line) for r in store.spans().collect()}
        assert got == {(p, n, x) for p, t in files.items() for n, x in enumerate(t.split("\n"))}
        assert {r.path for r in store.files().collect()} == set(files)

    assert store.apply(batch([(p, 1, t) for p, t in files.items()] + [(None, 1, "x")]), 0)["changed"] == 40
    check()
    version, at = store.version, dict(store.manifest["at"])
    one = "d3/f3.py"
    done = store.apply(batch([(one, 1, "old"), (one, 2, "new\ntext\nhere"), ("d5/f5.py", 1, files["d5/f5.py"]), ("none", 1, None)]), 1)
    assert done == {"skipped": 0, "changed": 1, "deleted": 0, "buckets": 1}  # equal hashes are skipped, one bucket is written
    files[one] = "new\ntext\nhere"
    check()
    assert sum(store.manifest["at"][b] != at[b] for b in at) == 1
    assert store.apply(batch([(one, 9, "replayed")]), 1)["skipped"] == 1 and store.version == version + 1
    store.apply(batch([("d7/f7.py", 1, None), ("z", 1, "")]), 2)
    del files["d7/f7.py"]
    files["z"] = ""
    check()
    few = dict(list(files.items())[:3])
    assert store.apply(batch([(p, 5, t) for p, t in few.items()]), 3, full=True)["deleted"] == len(files) - 3
    files.clear()
    files.update(few)
    check()
    assert sync.SpanStore(spark, store.path, lines).manifest == store.manifest
    store.apply(batch([(p, 6, None) for p in few]), 4)
    assert store.spans() is None and store.files().collect() == []


def test_stream_resumes_where_it_was(spark):
    base = f"{scratch_dir(spark)}/st-{uuid.uuid4().hex}"
    store = sync.SpanStore(spark, f"{base}/store", lines, 4)
    write = lambda k, rows: spark.createDataFrame(rows, "path string, seq int, text string").write.parquet(f"{base}/in/part={k}")
    follow = lambda check: sync.follow(spark.readStream.schema("path string, seq int, text string").parquet(f"{base}/in/part=*"), store, check)
    write(1, [("a", 1, "x\ny"), ("b", 1, "z")])
    follow(f"{base}/c")
    write(2, [("a", 2, None), ("c", 1, "w")])
    follow(f"{base}/c")
    assert {(r.path, r.line) for r in store.spans().collect()} == {("b", "z"), ("c", "w")} and store.manifest["batch"] == 1
    follow(f"{base}/c")
    assert store.version == 2


def random_graph(rnd, n, m):
    return [(f"n{rnd.randrange(n):02}", f"n{rnd.randrange(n):02}") for _ in range(m)]


@pytest.mark.parametrize("seed", [1, 2])
def test_shortest_paths_are_least(spark, seed):
    rnd = random.Random(seed)
    edges = random_graph(rnd, 25, 45)
    ids = sorted({x for e in edges for x in e})
    pairs = [(a, b) for a in ids[::3] for b in ids[::2]] + [("none", ids[0])]
    got = {(r.src, r.dst): r.path for r in graph.shortest_paths(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame(pairs, "src string, dst string"), 6).collect()}
    want = {}
    for a in {p[0] for p in pairs}:
        paths = [[a]]
        seen = {a: [a]}
        for _ in range(6):
            nxt = {}
            for p in paths:
                for s, d in edges:
                    if s == p[-1] and d not in seen:
                        nxt[d] = min(nxt.get(d, [*p, d]), [*p, d])
            seen |= nxt
            paths = list(nxt.values())
        want |= {(a, b): seen[b] for x, b in pairs if x == a and b in seen and (b in ids)}
    assert got == {k: v for k, v in want.items() if k != ("none", "none")}


@pytest.mark.parametrize("seed", [3, 4])
def test_components_and_cycles(spark, seed):
    rnd = random.Random(seed)
    edges = random_graph(rnd, 14, 24) + [("n03", "n03")]
    df = spark.createDataFrame(edges, "src string, dst string")
    ids = sorted({x for e in edges for x in e})
    reach = {a: {a} for a in ids}
    for _ in ids:
        for a, b in edges:
            for x in ids:
                if a in reach[x]:
                    reach[x].add(b)
    want = {frozenset(y for y in ids if y in reach[x] and x in reach[y]) for x in ids}
    got = {}
    for r in graph.components(df).collect():
        got.setdefault(r.scc, set()).add(r.id)
    assert {frozenset(v) for v in got.values() if len(v) > 1} == {w for w in want if len(w) > 1}
    out, e = [], set(edges)

    def walk(path):
        for d in ids:
            if (path[-1], d) in e:
                if d == path[0]:
                    out.append(path)
                elif d > path[0] and d not in path and len(path) < 5:
                    walk([*path, d])

    for x in ids:
        walk([x])
    assert sorted(r.path for r in graph.cycles(df, 5, None).collect()) == sorted(out)
    assert [r.path for r in graph.cycles(df, 5, 4).collect()] == sorted(out, key=lambda p: (len(p), p))[:4]


def test_text_scan(spark):
    texts = {
        "a.py": "def foo(x):\n    return bar(1) + my_foo(2)\nclass Baz:\n  pass\r\n\tdef odd name (y): z",
        "b.py": "  def bar(q): foo(bar(q))\nx = Bazaar(1); Baz (2)\ndefine(foo)",
        "c.py": "odd name(3) ünïfoo(4)\nclass Täst(Baz): pass\ndef  :\nclass (x)",
        "d.py": None, "e.py": "", "f.py": "(Täst(1)) def foo(",
    }
    files = spark.createDataFrame(list(texts.items()), "path string, text string")
    nodes, edges = graph.text_scan(files)
    names, places = set(), []
    for p, t in texts.items():
        for n, x in enumerate((t or "").splitlines(), 1):
            s = x.lstrip()
            if s.startswith(("def ", "class ")):
                name = s.split(" ", 1)[1].split("(", 1)[0].split(":", 1)[0].strip()
                if name:
                    names.add(name)
                    places.append((name, p, n))
    want = {(p, s) for p, t in texts.items() for s in names if f"{s}(" in (t or "")}
    assert {(r.src, r.dst) for r in edges.collect()} == want | {(s, p) for p, s in want} and edges.count() == 2 * len(want)
    assert sorted((r.id, r.path, r.line) for r in nodes.filter("line IS NOT NULL").collect()) == sorted(places)
    assert nodes.filter("line IS NULL").count() == len(texts) and len(list(itertools.chain(want))) > 6


def test_stitching_fills_quotas_over_hops(spark):
    rnd = random.Random(6)
    edges = {(f"n{rnd.randrange(30):02}", f"n{rnd.randrange(30):02}") for _ in range(45)}
    seeds = [(q, f"n{rnd.randrange(30):02}", quota) for q, quota in enumerate([1, 2, 5, 100, 3, 100]) for _ in range(2)]
    got = {}
    for r in composed.stitch_hops(spark.createDataFrame(seeds, "query_id long, path string, quota int"), spark.createDataFrame(sorted(edges), "a string, b string"), 3).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.hop, r.path))
    for q in {s[0] for s in seeds}:
        quota = next(s[2] for s in seeds if s[0] == q)
        seen = front = {s[1] for s in seeds if s[0] == q}
        want = []
        for hop in (1, 2, 3):
            front = {b for a, b in edges if a in front} - seen
            seen = seen | front
            want += [(hop, p) for p in sorted(front)]
        assert sorted(got.get(q, [])) == [(n, *x) for n, x in enumerate(want[:quota], 1)]


def test_rows_with_needles(spark):
    rnd = random.Random(8)
    text = lambda n: "".join(rnd.choices("abc é\n", k=n))
    rows = [(i, text(rnd.randrange(40))) for i in range(150)] + [(150, None), (151, "")]
    needles = [text(rnd.randrange(1, 6)) for _ in range(60)] + ["", "zzzz"]
    got = {(r.id, r.needle) for r in search.rows_with(spark.createDataFrame(rows, "id long, t string"), spark.createDataFrame([(n,) for n in needles], "n string"), "id", "t", "n").collect()}
    assert got == {(i, n) for i, t in rows for n in needles if n and t and n in t}


def test_leases_over_batches(spark):
    base = f"{scratch_dir(spark)}/le-{uuid.uuid4().hex}"
    beats = [  # a batch each: (item, worker, second)
        [("a", "w1", 0), ("a", "w1", 50), ("b", "w1", 10), (None, "w1", 5)],
        [("a", "w2", 140), ("c", "w1", 100), ("c", "w2", 160)],  # c falls silent in between
        [("d", "w1", 400)],
        [("a", "w1", 1000), ("d", "w1", 1010)],
    ]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", leases.PROVIDER)
    try:
        for k, rows in enumerate(beats):
            spark.createDataFrame(rows, "item string, worker string, s long").select("item", "worker", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.parquet(f"{base}/in/part={k}")
            stream = spark.readStream.schema("item string, worker string, ts timestamp").parquet(f"{base}/in/part=*")
            out = leases.releases(stream, "item", "worker", "ts", 55, "1 second")
            q = out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/c").trigger(availableNow=True).start()
            q.awaitTermination()
        got = sorted((r.item, r.worker, int(r.released_at.timestamp())) for r in spark.read.parquet(f"{base}/out").collect())
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert got == [("a", "w1", 105), ("a", "w2", 195), ("b", "w1", 65), ("c", "w1", 155), ("c", "w2", 215), ("d", "w1", 455)]


@pytest.mark.parametrize("width", [4, 4096])
def test_scopes_at_lines(spark, width):
    rnd = random.Random(width)
    scopes = [(f"f{rnd.randrange(4)}", f"s{n}", a := rnd.randrange(1, 40), a + rnd.randrange(-2, 12)) for n in range(60)] + [(None, "x", 1, 9), ("f1", None, 3, 50), ("f1", "y", None, 5)]
    lines = [(f"f{f}", n) for f in range(5) for n in range(-1, 55)] + [("f1", 7), (None, 3), ("f2", None)]
    got = ranges.scopes_at(spark.createDataFrame(scopes, "file string, name string, start int, end int"), spark.createDataFrame(lines, "file string, line int"), width=width)
    want = []
    for f, n in lines:
        if f is not None and n is not None:
            on = sorted((a, -b, name or "") for g, name, a, b in scopes if g == f and a is not None and a <= n <= b)
            want.append((f, n, ".".join(x[2] for x in on) if on else None, len(on)))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_paths_of_many_sources_share_a_search(spark, monkeypatch):
    edges = [(f"c{i:03d}", f"n{i % 4}") for i in range(200)] + [(f"n{i}", f"m{j}") for i in range(4) for j in range(3)] + [(f"m{j}", "r") for j in range(3)] + [("r", "q")]
    pairs = [(f"c{i:03d}", t) for i in range(200) for t in ("r", "q", "c000")]
    rows = []

    def counted(df, tag="t", write=graph.write_once):
        out = write(df, tag)
        rows.append(out.count() if tag in ("layer", "met", "open") else 0)
        return out

    monkeypatch.setattr(graph, "write_once", counted)
    got = {(r.src, r.dst): r.path for r in graph.shortest_paths(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame(pairs, "src string, dst string"), 5).collect()}
    want = {(f"c{i:03d}", t): [f"c{i:03d}", f"n{i % 4}", "m0", "r"] + ["q"] * (t == "q") for i in range(200) for t in ("r", "q")} | {("c000", "c000"): ["c000"]}
    assert got == want and max(rows) <= 250


def test_stitching_takes_of_a_hub_what_a_query_may_need(spark):
    near = composed._numbered(spark.createDataFrame([("hub", f"x{i:04d}") for i in range(3000)], "path string, to string"))
    front = spark.createDataFrame([(q, "hub", q) for q in (1, 2, 3, 8, 40)], "query_id long, path string, most long")
    got = sorted((r.query_id, r.to) for r in composed._first(front, near).collect())
    assert got == sorted((q, f"x{i:04d}") for q in (1, 2, 3, 8, 40) for i in range(q))
