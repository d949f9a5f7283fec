"""The tool surface over a small code base that the ingest cycle has read."""

import pytest
from pyspark.sql import functions as F

from spanloom import tools
from spanloom.functions.paths import language

FILES = [
    (1, "app/store.py", "import json\n\ndef load(path):\n    '''Load a store.'''\n    return json.loads(path)\n"),
    (2, "app/main.py", "from app.store import load\n\nclass Runner:\n    def run(self):\n        return load('x')\n"),
    (3, "docs/guide.md", "# Guide\nHow to load a store.\n"),
    (4, "web/ui.js", "function draw() {\n  return 1;\n}\n"),
]


@pytest.fixture(scope="module")
def engine(spark):
    return tools.cycle(spark, spark.createDataFrame(FILES, "id long, path string, text string"), language)


def test_cycle(engine):
    e, health = engine
    assert {(r.path, r.symbol) for r in e.spans.collect()} >= {("app/store.py", "load"), ("app/main.py", "Runner.run"), ("docs/guide.md", "Guide"), ("web/ui.js", "draw")}
    s = e.rag_stats().first()
    assert s.files == 4 and s.spans == s.enrichments == 5 and s.nodes == 3 and s.edges >= 3
    assert [r.quality for r in health.collect()] == ["PLACEHOLDER"]


def test_search_and_lookup(spark, engine):
    e, _ = engine
    assert e.rag_search("load store").first().path in ("app/store.py", "docs/guide.md")
    assert e.rag_search("nothing at all like it").count() == 0
    assert e.rag_search_enriched("load store").filter("origin = 'hit'").count() >= 1
    assert e.rag_plan("run the runner").orderBy("rank").first().score > 3
    assert e.read_symbol("Runner.run").first().source == "    def run(self):\n        return load('x')"
    assert e.inspect("Runner").first().score == 0.7
    assert e.route("fix load()").first().route == "code"
    v = e.vectors.first()
    assert e.rag_query(v.vector, 1).first().id == v.id
    assert [r.path for r in e.rag_where_used("app.store.load").collect()] == ["app/main.py"]
    assert [r.path for r in e.rag_lineage("app.main.Runner.run").collect()] == ["app/store.py"]


def test_views_table_function_and_handles(spark, engine):
    e, _ = engine
    e.register()
    assert spark.sql("SELECT symbol FROM files, LATERAL extract_spans(text) WHERE path = 'app/main.py'").count() == 2
    h = tools.store_result(e.spans.select("path", "symbol"))
    a = tools.load_result(spark, h, "symbol", 0, 2).collect() + tools.load_result(spark, h, "symbol", 2, 10).collect()
    assert sorted(r.symbol for r in a) == sorted(r.symbol for r in e.spans.select(F.col("symbol")).collect())
