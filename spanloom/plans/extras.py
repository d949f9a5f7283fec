"""Sources and sinks, topic resolution, descriptions, vectors as bytes, backends, and the ingest cycle."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from spanloom.operators import embed, enrich
from spanloom.plans.base import EDGES, ENR, FILES, NODES, SPANS, edges, enrichments, files, nodes, spans
from spanloom.plans.catalog import register
from spanloom.runtime import scratch_dir, table
from spanloom.sources import files as io


def _folder(spark) -> str:
    return f"{scratch_dir(spark)}/io-{uuid.uuid4().hex[:12]}"


@register("graph_json_roundtrip", "S12 M9", f"WITH {NODES}, {EDGES} SELECT 'node' AS part, id AS a, name AS b, kind AS c, path AS d FROM nodes UNION ALL SELECT 'edge', src, dst, type, NULL FROM edges")
def graph_json_roundtrip(spark, sf):
    p = _folder(spark)
    io.write_graph(nodes(spark, sf), edges(spark, sf), p)
    n = spark.read.schema("id string, name string, kind string, path string").json(f"{p}/nodes").select(F.lit("node").alias("part"), F.col("id").alias("a"), F.col("name").alias("b"), F.col("kind").alias("c"), F.col("path").alias("d"))
    e = spark.read.schema("src string, dst string, type string").json(f"{p}/edges")
    return n.unionByName(e.select(F.lit("edge").alias("part"), F.col("src").alias("a"), F.col("dst").alias("b"), F.col("type").alias("c"), F.lit(None).cast("string").alias("d")))


@register("jsonl_queries", "S15 S30", "SELECT item_id AS id, text AS q FROM benchmark")
def jsonl_queries(spark, sf):
    p = _folder(spark)
    io.append_log(table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("q")), p)
    return io.jsonl(spark, p, "id long, q string").filter("_corrupt IS NULL").drop("_corrupt")


@register("csv_sink", "S29 S20", "SELECT event_type AS bench_id, count(*) AS n FROM events GROUP BY 1")
def csv_sink(spark, sf):
    p = _folder(spark)
    io.write_csv(table(spark, sf, "events").groupBy(F.col("event_type").alias("bench_id")).agg(F.count("*").alias("n")), p)
    return spark.read.schema("bench_id string, n long").option("header", True).csv(p)


@register("graded_set", "S16", "SELECT CAST(item_id AS VARCHAR) AS query_id, 'd' || (item_id % 5) AS doc_id, CAST(item_id % 3 AS DOUBLE) AS grade FROM benchmark")
def graded_set(spark, sf):
    p = _folder(spark)
    j = F.array(F.struct(F.concat(F.lit("d"), F.col("item_id") % 5).alias("doc_id"), (F.col("item_id") % 3).cast("double").alias("score")))
    table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), "text", j.alias("judgments")).write.json(p)
    q = spark.read.schema("query_id string, text string, judgments array<struct<doc_id:string,score:double>>").json(p)
    return q.select("query_id", F.explode("judgments").alias("j")).select("query_id", "j.doc_id", F.col("j.score").alias("grade"))


@register("symbol_source", "S25", f"WITH {SPANS} SELECT s.id, s.text AS source FROM spans s WHERE s.kind = 'class'")
def symbol_source(spark, sf):
    from spanloom.sources.grep import snippet

    s = spans(spark, sf).filter("kind = 'class'").select("id", F.col("file_id").alias("f"), (F.col("pos") + 1).alias("n"))
    return s.join(files(spark, sf).select(F.col("id").alias("f"), "text"), "f").select("id", snippet(F.col("text"), F.col("n"), F.col("n")).alias("source"))


@register("topic_resolution", "J19", f"""WITH {SPANS}, t AS (SELECT DISTINCT regexp_extract(lower(text), '([a-z]+)', 1) AS topic FROM benchmark WHERE regexp_extract(lower(text), '([a-z]+)', 1) <> ''), s AS (SELECT id, symbol, string_split(symbol, '.')[-1] AS leaf FROM spans),
m AS (SELECT topic, id, length(symbol) AS n, CASE WHEN leaf = topic THEN 0 ELSE 1 END AS stage FROM t JOIN s ON starts_with(leaf, topic)) SELECT topic, min(struct_pack(stage, n, id)).id AS id, CAST(min(struct_pack(stage, n, id)).stage AS INTEGER) AS stage FROM m GROUP BY topic""")
def topic_resolution(spark, sf):
    t = table(spark, sf, "benchmark").select(F.regexp_extract(F.lower("text"), "([a-z]+)", 1).alias("topic")).filter("topic <> ''").distinct()
    return enrich.resolve_topics(t, spans(spark, sf))


@register("cheap_description", "R27 M11", f"""WITH {ENR}, s AS (SELECT f.path, s.span_hash, s.start_line, CASE WHEN regexp_matches(e.summary, '\\.\\s+[A-Z]') THEN regexp_extract(e.summary, '^(?s)(.*?\\.)\\s+[A-Z]', 1) ELSE e.summary END AS x, CASE s.kind WHEN 'module' THEN 1 WHEN 'class' THEN 2 ELSE 4 END AS o FROM spans s JOIN files f ON f.id = s.file_id JOIN enrichments e USING (span_hash)),
w AS (SELECT *, row_number() OVER v AS i, sum(len(list_filter(regexp_split_to_array(x, '\\s+'), lambda t: t <> ''))) OVER (PARTITION BY path ORDER BY o, start_line, span_hash ROWS UNBOUNDED PRECEDING) AS u FROM s WINDOW v AS (PARTITION BY path ORDER BY o, start_line, span_hash))
SELECT path, string_agg(CASE WHEN i = 1 THEN array_to_string(list_filter(regexp_split_to_array(x, '\\s+'), lambda t: t <> '')[1:20], ' ') ELSE x END, ' ' ORDER BY i) AS description FROM w WHERE u <= 20 OR i = 1 GROUP BY path""")
def cheap_description(spark, sf):
    f = files(spark, sf).select(F.col("id").alias("file_id"), "path")
    s = spans(spark, sf).join(f, "file_id").join(enrichments(spark, sf).select("span_hash", "summary"), "span_hash")
    return enrich.describe(s, F.when(F.col("kind") == "module", 1).when(F.col("kind") == "class", 2).otherwise(4), 20)


@register("description_refresh", "M11", f"WITH {FILES} SELECT path, CASE WHEN id % 3 = 0 OR id % 2 = 0 THEN 'new' ELSE 'old' END AS description, id % 3 = 0 OR id % 2 = 0 AS changed FROM files")
def description_refresh(spark, sf):
    f = files(spark, sf)
    old = f.filter("id % 3 <> 0").select("path", F.lit("old").alias("description"), F.col("file_hash").alias("input_hash"))
    new = f.select("path", F.lit("new").alias("description"), F.when(F.col("id") % 2 == 0, F.reverse("file_hash")).otherwise(F.col("file_hash")).alias("input_hash"))
    return enrich.refresh(old, new).select("path", "description", "changed")


@register("vector_bytes", "F19", "SELECT vec_id, 4 * len(embedding) AS n_bytes, round(CAST(embedding[1] AS DOUBLE), 6) AS first FROM embeddings")
def vector_bytes(spark, sf):
    p = embed.pack(table(spark, sf, "embeddings"), "vec_id", "embedding")
    n = p.select("vec_id", F.octet_length("blob").cast("long").alias("n_bytes"))
    return n.join(embed.unpack(p, "vec_id"), "vec_id").select("vec_id", "n_bytes", F.round(F.col("vector")[0].cast("double"), 6).alias("first"))


@register("latin1_and_fences", "F41 U24", "SELECT doc_id, NOT regexp_matches(text, '[^\\x00-\\x{FF}]') AS latin1, CAST(doc_id % 3 AS BIGINT) AS fences FROM documents")
def latin1_and_fences(spark, sf):
    from spanloom.functions.text import latin1

    t = F.concat(F.lit("x\n"), F.repeat(F.lit("```py\na = 1\n```\n"), (F.col("doc_id") % 3).cast("int")), F.lit("``` \nopen"))
    n = F.regexp_count(t, F.lit(r"(?s)(?:^|[\s:,(){}\[\]])```[\w-]*\s*\n.*?```"))
    return table(spark, sf, "documents").select("doc_id", latin1(F.col("text")).alias("latin1"), n.cast("long").alias("fences"))


@register("backend_cascade", "X5 X6 T-15 T-16", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'first' ELSE 'second' END AS backend FROM documents")
def backend_cascade(spark, sf):
    def make():
        def first(prompt: str) -> str:
            if int(prompt) % 2:
                raise TimeoutError("busy")
            return "a"

        return [("first", first), ("second", lambda prompt: "b")]

    d = table(spark, sf, "documents").select("doc_id", F.col("doc_id").cast("string").alias("text"))
    return enrich.cascade(d, make, "doc_id").select("doc_id", "backend")


@register("ingest_cycle", "T-14 X9 X12 X10", None)
def ingest_cycle(spark, sf):
    """The whole cycle over generated Python files, one per document; its health and the engine's figures."""
    from spanloom import tools
    from spanloom.functions.paths import language

    w = F.regexp_extract(F.lower("text"), "([a-z]+)", 1)
    code = F.concat(F.lit("def f_"), w, F.lit("(x):\n    return g(x)\n\ndef g(x):\n    return x + "), F.col("doc_id"), F.lit("\n"))
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("src/m"), "doc_id", F.lit(".py")).alias("path"), code.alias("text"))
    engine, health = tools.cycle(spark, d, language)
    return engine.rag_stats().crossJoin(health)  # one row, and a row per quality class


