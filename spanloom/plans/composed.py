"""Queries that compose several operators, and those over small stores: searches, checks, graphs of notes and sources, exports."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.operators import chunking, composed, search
from spanloom.plans.base import EDGES, ENR, FILES, QUEUE, SPANS, TELE, edges, enrichments, files, queue, spans, telemetry
from spanloom.plans.catalog import register
from spanloom.plans.extras import _folder
from spanloom.plans.retrieval import ALL, BM25, COS, METRIC, RERANK, bm25_hits, judged, nearest, semantic_search
from spanloom.runtime import table, write_once
from spanloom.sources import convert
from spanloom.sources import files as io
from spanloom.streaming import state


def word():
    """The first word of a to z; a capital I with a dot is an i, without the combining dot that Java's lower case adds."""
    return F.regexp_extract(F.lower(F.replace("text", F.lit("\u0130"), F.lit("i"))), "([a-z]+)", 1)


NAV = """qs AS (SELECT item_id AS query_id, CASE WHEN item_id % 4 = 0 THEN substr(string_split(text, ' ')[2], 2) ELSE array_to_string(string_split(text, ' ')[2:3], ' ') END AS text FROM benchmark)"""


@register("stitch_hops", "R18", f"""WITH RECURSIVE {EDGES}, u AS (SELECT src, dst FROM edges WHERE type IN ('USES', 'EXTENDS') UNION SELECT dst, src FROM edges WHERE type IN ('USES', 'EXTENDS')),
q AS (SELECT c_custkey AS query_id, 'c:' || c_custkey AS path, [1, 3, 40, 4000][c_custkey // 10 % 4 + 1] AS quota FROM customer WHERE c_custkey % 10 = 0),
w(query_id, id, d) AS (SELECT query_id, path, 0 FROM q UNION SELECT w.query_id, u.dst, d + 1 FROM w JOIN u ON u.src = w.id WHERE d < 3),
m AS (SELECT query_id, id, min(d) AS d FROM w GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS n FROM m WHERE d > 0)
SELECT query_id, id AS path, CAST(d AS INTEGER) AS hop, CAST(n AS INTEGER) AS "rank" FROM r JOIN q USING (query_id) WHERE n <= quota""")
def stitch_hops(spark, sf):
    """From every tenth customer along uses and extensions, either way, until 1, 3, 40 or 4,000 neighbours are found, three hops at most."""
    e = edges(spark, sf).filter("type IN ('USES', 'EXTENDS')")
    u = e.select("src", "dst").unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    k = F.col("c_custkey").cast("long")
    quota = F.element_at(F.array(*map(F.lit, (1, 3, 40, 4000))), (F.floor(k / 10) % 4 + 1).cast("int"))
    q = table(spark, sf, "customer").filter("c_custkey % 10 = 0").select(k.alias("query_id"), F.concat(F.lit("c:"), k).alias("path"), quota.alias("quota"))
    return composed.stitch_hops(q, u, 3)


@register("nav_search", "R19 R18 C15", f"""WITH {FILES}, {NAV}, {BM25}, {RERANK},
best AS (SELECT query_id, path, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS k FROM s QUALIFY k <= 10),
nb AS (SELECT a.path, z.path AS other FROM files a JOIN files z ON z.id = xor(a.id, 1)),
sti AS (SELECT query_id, path, 0 AS stage, k AS a, 'hit' AS origin FROM best
  UNION ALL SELECT query_id, other, 1, min(k), 'neighbour' FROM best JOIN nb USING (path) WHERE (query_id, other) NOT IN (SELECT (query_id, path) FROM best) GROUP BY query_id, other),
fts AS (SELECT query_id, path, row_number() OVER (PARTITION BY query_id ORDER BY stage, a, path) AS n, origin FROM sti QUALIFY n <= 10),
gr AS (SELECT query_id, path, row_number() OVER (PARTITION BY query_id ORDER BY path) AS n FROM qs JOIN files f ON qs.text <> '' AND contains(lower(f.text), lower(qs.text))
  WHERE query_id NOT IN (SELECT query_id FROM best) QUALIFY n <= 10)
SELECT query_id, path, CAST(n AS INTEGER) AS "rank", origin FROM fts UNION ALL SELECT query_id, path, CAST(n AS INTEGER), 'grep' FROM gr""")
def nav_search(spark, sf):
    f = files(spark, sf).select("id", "path", "text")
    words = F.split("text", " ")
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.when(F.col("item_id") % 4 == 0, F.substring(F.get(words, F.lit(1)), F.lit(2), F.length("text"))).otherwise(F.array_join(F.slice(words, 2, 2), " ")).alias("text"))
    n = f.select("path", F.col("id").bitwiseXOR(F.lit(1)).alias("o")).join(f.select(F.col("id").alias("o"), F.col("path").alias("other")), "o").select("path", "other")
    return composed.nav_search(f, q, n)


@register("hybrid_retrieve", "R20", f"""WITH {COS.format(n=ALL)}, {EDGES}, vh AS (SELECT query_id, 'v:' || id AS id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, c.id) AS pl FROM c QUALIFY pl <= 10),
qe AS (SELECT DISTINCT query_id, 'n:' || (query_id // 20 % 25) AS entity FROM c WHERE query_id % 60 <> 0),
b AS (SELECT DISTINCT src AS entity, dst AS id FROM edges UNION SELECT dst, src FROM edges), g AS (SELECT query_id, b.id, row_number() OVER (PARTITION BY query_id ORDER BY b.id) AS n FROM qe JOIN b USING (entity) QUALIFY n <= 15),
m AS (SELECT query_id, id, 0 AS stage, pl FROM vh UNION ALL SELECT query_id, id, 1, 1 FROM g),
d AS (SELECT query_id, (SELECT count(*) FROM g WHERE g.query_id = m.query_id) * 1.0 / count(*) AS density FROM m GROUP BY query_id)
SELECT m.query_id, m.id, CASE stage WHEN 0 THEN 'vector' ELSE 'graph' END AS origin, CAST(row_number() OVER (PARTITION BY m.query_id ORDER BY stage, pl, m.id) AS INTEGER) AS "rank", CAST(density AS DOUBLE) AS density FROM m JOIN d USING (query_id)""")
def hybrid_retrieve(spark, sf):
    """Of queries that are relational (all but every third), the entity's neighbours join the ten nearest vectors."""
    c = nearest(spark, sf, 10)
    v = search.top(c, ["query_id"], 10, F.desc("score"), F.col("id")).select("query_id", F.concat(F.lit("v:"), "id").alias("id"), "rank")
    v = write_once(v, "nearest")  # a result and the source of entities
    q = v.select("query_id").distinct().filter("query_id % 60 <> 0").select("query_id", F.concat(F.lit("n:"), F.floor(F.col("query_id") / 20) % 25).alias("entity"))
    e = edges(spark, sf)
    b = e.select(F.col("src").alias("entity"), F.col("dst").alias("id")).unionByName(e.select(F.col("dst").alias("entity"), F.col("src").alias("id"))).distinct()
    return composed.hybrid(v, q, b.withColumn("distance", F.lit(1)))


HITS = "hits AS (SELECT file_id AS file, id AS query_id, start_line AS a, end_line + 3 AS b FROM spans WHERE pos < 3)"


@register("debug_enrichment", "R21 J11", f"""WITH {ENR}, {HITS},
o AS (SELECT h.*, min(struct_pack(s := s.end_line - s.start_line, entity := s.id)).entity AS entity FROM hits h LEFT JOIN spans s ON s.file_id = h.file AND s.end_line >= h.a AND s.start_line <= h.b GROUP BY ALL)
SELECT o.query_id, o.entity, CASE WHEN z.pos > 0 THEN CAST(z.id - 1 AS VARCHAR) END AS parents, CASE WHEN EXISTS (SELECT 1 FROM spans n WHERE n.file_id = z.file_id AND n.pos = z.pos + 1) THEN CAST(z.id + 1 AS VARCHAR) END AS children, e.summary
FROM o JOIN spans z ON z.id = o.entity LEFT JOIN enrichments e ON e.span_hash = z.span_hash""")
def debug_enrichment(spark, sf):
    """The first three spans of each file as hits; spans follow each other in the graph."""
    s = spans(spark, sf)
    h = s.filter("pos < 3").select(F.col("file_id").alias("file"), F.col("id").alias("query_id"), F.col("start_line").alias("start"), (F.col("end_line") + 3).alias("end"))
    n = s.select("file_id", "id", "pos")
    e = n.join(n.select("file_id", F.col("id").alias("to"), (F.col("pos") - 1).alias("pos")), ["file_id", "pos"]).select(F.col("id").alias("src"), F.col("to").alias("dst"))
    text = s.join(enrichments(spark, sf).select("span_hash", "summary"), "span_hash").select(F.col("id").alias("entity"), "summary")
    return composed.explained(h, s.select(F.col("file_id").alias("file"), "id", F.col("start_line").alias("start"), F.col("end_line").alias("end")), e, text).select("query_id", "entity", "parents", "children", "summary")


@register("enriched_search", "R22", f"""WITH {ENR}, {COS.format(n=ALL)}, t AS (SELECT query_id, id, round(greatest(0.0, least(100.0, score * 100)), 4) AS s, row_number() OVER (PARTITION BY query_id ORDER BY round(greatest(0.0, least(100.0, score * 100)), 4) DESC, id) AS n FROM c QUALIFY n <= 10),
x AS (SELECT file_id, min(summary) AS summary FROM spans JOIN enrichments USING (span_hash) GROUP BY file_id)
SELECT query_id, id, CAST(n AS INTEGER) AS "rank", x.summary, 2 AS graph_depth FROM t LEFT JOIN x ON x.file_id = t.id""")
def enriched_search(spark, sf):
    """Semantic hits with their file's summary; the graph depth is passed on."""
    x = spans(spark, sf).join(enrichments(spark, sf).select("span_hash", "summary"), "span_hash").groupBy(F.col("file_id").alias("id")).agg(F.min("summary").alias("summary"))
    return semantic_search(spark, sf).select("query_id", "id", "rank").join(x, "id", "left").withColumn("graph_depth", F.lit(2))


@register("trimmed_search", "R15 R16", None)
def trimmed_search(spark, sf):
    """Twenty full-text hits a query, those of a third of the best one's score at least, made diverse, in 2,000 tokens: how many were kept."""
    h = search.top(bm25_hits(spark, sf, k=20), ["query_id"], 20, F.desc(F.round("score_pos", 5)), F.col("id"))
    h = h.withColumn("relevance", F.col("score_pos") / F.max("score_pos").over(W.partitionBy("query_id")))
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return composed.trimmed(h.join(d, "id").select("query_id", "id", "relevance", "text"), 2000)[1]


@register("export_all", "S28 S27 S31", f"""WITH {SPANS} SELECT 'chunk' AS part, f.path AS a, s.span_hash AS b, CAST(s.start_line AS BIGINT) AS n FROM spans s JOIN files f ON f.id = s.file_id
UNION ALL SELECT 'vector', CAST(vec_id AS VARCHAR), md5(CAST(vec_id AS VARCHAR)), len(embedding) FROM embeddings
UNION ALL SELECT 'meta', 'chunks', '', (SELECT count(*) FROM spans) UNION ALL SELECT 'meta', 'vectors', '', (SELECT count(*) FROM embeddings)""")
def export_all(spark, sf):
    """Chunks as JSON lines in order of path and line, vectors by hash, counts; read back."""
    p = _folder(spark)
    s = spans(spark, sf).join(files(spark, sf).select(F.col("id").alias("file_id"), "path"), "file_id").select("path", "start_line", "end_line", "symbol", "kind", "span_hash", "text")
    s.repartitionByRange("path", "start_line").sortWithinPartitions("path", "start_line").write.json(f"{p}/chunks")
    table(spark, sf, "embeddings").select(F.md5(F.col("vec_id").cast("string")).alias("hash"), "vec_id", "embedding").write.parquet(f"{p}/vectors")
    chunks, vectors = spark.read.schema(s.schema).json(f"{p}/chunks"), spark.read.parquet(f"{p}/vectors")
    count = lambda d, name: d.agg(F.count("*").alias("n")).select(F.lit(name).alias("a"), "n")
    count(chunks, "chunks").unionByName(count(vectors, "vectors")).coalesce(1).write.json(f"{p}/metadata")
    meta = spark.read.schema("a string, n long").json(f"{p}/metadata")
    out = chunks.select(F.lit("chunk").alias("part"), F.col("path").alias("a"), F.col("span_hash").alias("b"), F.col("start_line").cast("long").alias("n"))
    out = out.unionByName(vectors.select(F.lit("vector").alias("part"), F.col("vec_id").cast("string").alias("a"), F.col("hash").alias("b"), F.size("embedding").cast("long").alias("n")))
    return out.unionByName(meta.select(F.lit("meta").alias("part"), "a", F.lit("").alias("b"), "n"))


@register("graph_retrofit", "S33", f"WITH {ENR} SELECT 'e' || s.id AS id, s.symbol AS name, e.summary FROM spans s LEFT JOIN enrichments e USING (span_hash)")
def graph_retrofit(spark, sf):
    """A stored graph is read, its entities get their summaries, and it is stored again."""
    p = _folder(spark)
    s = spans(spark, sf)
    io.write_graph(s.select(F.concat(F.lit("e"), "id").alias("id"), F.col("symbol").alias("name"), "span_hash"), edges(spark, sf), p)
    g = spark.read.schema("id string, name string, span_hash string").json(f"{p}/nodes")
    io.write_graph(g.join(enrichments(spark, sf).select("span_hash", "summary"), "span_hash", "left"), spark.read.schema("src string, dst string, type string").json(f"{p}/edges"), f"{p}/enriched")
    return spark.read.schema("id string, name string, summary string").json(f"{p}/enriched/nodes")


@register("doctor_report", "A4", f"""WITH {ENR}, c AS (SELECT (SELECT count(*) FROM spans) AS spans, (SELECT count(*) FROM enrichments e WHERE NOT EXISTS (SELECT 1 FROM spans s WHERE s.span_hash = e.span_hash AND s.pos = 0)) AS orphans,
 (SELECT count(*) FROM spans s WHERE NOT EXISTS (SELECT 1 FROM enrichments e WHERE e.span_hash = s.span_hash)) AS pending_enrichments, (SELECT count(*) FROM spans s WHERE NOT EXISTS (SELECT 1 FROM embeddings v WHERE v.vec_id = s.id)) AS pending_embeddings)
SELECT *, CASE WHEN orphans > 0 THEN 'WARN' WHEN spans = 0 THEN 'EMPTY' WHEN pending_enrichments > 0 OR pending_embeddings > 0 THEN 'WARN' ELSE 'OK' END AS status,
 array_to_string(list_filter([CASE WHEN spans = 0 THEN 'no spans' END, CASE WHEN orphans > 0 THEN orphans || ' enrichments without span' END, CASE WHEN pending_enrichments > 0 THEN pending_enrichments || ' spans without enrichment' END,
  CASE WHEN pending_embeddings > 0 THEN pending_embeddings || ' spans without embedding' END], lambda x: x IS NOT NULL), '; ') AS issues FROM c""")
def doctor_report(spark, sf):
    s, e = spans(spark, sf).select("id", "pos", "span_hash"), enrichments(spark, sf).select("span_hash")
    n = lambda d, name: d.agg(F.count("*").alias(name))
    c = n(s, "spans").crossJoin(n(e.join(s.filter("pos = 0"), "span_hash", "left_anti"), "orphans")).crossJoin(n(s.join(e, "span_hash", "left_anti"), "pending_enrichments"))
    c = c.crossJoin(n(s.join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("id")), "id", "left_anti"), "pending_embeddings"))  # one row each
    return composed.doctor(c).withColumn("issues", F.array_join("issues", "; "))


@register("graph_integrity", "A33 A35 G18", f"""WITH {ENR}, x AS (SELECT s.kind, e.span_hash FROM spans s LEFT JOIN enrichments e USING (span_hash))
SELECT kind, count(*) AS entities, count(span_hash) AS linked, round(count(span_hash) * 100.0 / count(*), 4) AS coverage FROM x GROUP BY kind""")
def graph_integrity(spark, sf):
    x = spans(spark, sf).select("kind", "span_hash").join(enrichments(spark, sf).select("span_hash", F.lit(1).alias("has")), "span_hash", "left")
    return x.groupBy("kind").agg(F.count("*").alias("entities"), F.count("has").alias("linked"), F.round(F.count("has") * 100.0 / F.count("*"), 4).alias("coverage"))


@register("generations", "M10 J14", """WITH m AS (SELECT n_nationkey AS repo, CASE WHEN n_nationkey % 4 > 0 THEN n_nationkey * 3 END AS gen, n_regionkey AS stored, n_nationkey % 7 AS mtime, n_nationkey % 5 AS n FROM nation)
SELECT repo, CAST(coalesce(gen, 0) + 1 AS VARCHAR) AS generation, CASE WHEN coalesce(gen, 0) + 1 > stored * 10 THEN 'generation' WHEN mtime > 3 THEN 'mtime' WHEN n <> 2 THEN 'count' ELSE 'fresh' END AS reason FROM m""")
def generations(spark, sf):
    """The counter of every repository goes up; a graph of an older generation is stale, then one with older or other files."""
    from spanloom.operators.merge import increment

    k = F.col("n_nationkey").cast("long")
    n = table(spark, sf, "nation").select(k.alias("repo"), F.when(k % 4 > 0, (k * 3).cast("string")).alias("value"), (F.col("n_regionkey") * 10).alias("stored"), (k % 7).alias("mtime"), (k % 5).alias("n"))
    m = increment(n.filter("value IS NOT NULL").select("repo", F.lit("index_generation").alias("key"), "value"), n.select("repo"), ["repo"], "index_generation")
    r = n.drop("value").join(m.select("repo", F.col("value").alias("generation")), "repo")
    reason = F.when(F.col("generation").cast("long") > F.col("stored"), "generation").when(F.col("mtime") > 3, "mtime").when(F.col("n") != 2, "count").otherwise("fresh")
    return r.select("repo", "generation", reason.alias("reason"))


@register("freshness_gate", "M16 M17", f"""WITH {FILES}, d AS (SELECT id, file_hash AS doc_hash FROM files WHERE id % 3 <> 1), i AS (SELECT id, CASE WHEN id % 5 = 0 THEN md5(file_hash) ELSE file_hash END AS index_hash FROM files WHERE id % 7 <> 2)
SELECT f.id, doc_hash IS NOT NULL AND (f.id % 2 = 0) AS skip, CASE WHEN doc_hash IS NULL THEN 'no document' WHEN f.id % 2 = 0 THEN 'unchanged' ELSE 'changed' END AS reason,
 CASE WHEN index_hash IS NULL THEN 'not indexed' WHEN index_hash <> f.file_hash THEN 'stale' ELSE 'fresh' END AS indexed FROM files f LEFT JOIN d USING (id) LEFT JOIN i USING (id)""")
def freshness_gate(spark, sf):
    f = files(spark, sf).select("id", "file_hash")
    d = f.filter("id % 3 <> 1").select("id", F.when(F.col("id") % 2 == 0, F.col("file_hash")).otherwise(F.reverse("file_hash")).alias("doc_hash"))
    i = f.filter("id % 7 <> 2").select("id", F.when(F.col("id") % 5 == 0, F.md5("file_hash")).otherwise(F.col("file_hash")).alias("index_hash"))
    same = F.col("doc_hash") == F.col("file_hash")
    r = f.join(d, "id", "left").join(i, "id", "left")
    reason = F.when(F.col("doc_hash").isNull(), "no document").when(same, "unchanged").otherwise("changed")
    state_ = F.when(F.col("index_hash").isNull(), "not indexed").when(F.col("index_hash") != F.col("file_hash"), "stale").otherwise("fresh")
    return r.select("id", F.coalesce(same, F.lit(False)).alias("skip"), reason.alias("reason"), state_.alias("indexed"))


@register("chain_choice", "C12 C5", """WITH d AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'special' WHEN doc_id % 11 = 0 THEN 'missing' END AS o, CASE lang WHEN 'en' THEN 'code' WHEN 'de' THEN 'docs' ELSE 'other' END AS t FROM documents),
w AS (SELECT doc_id, coalesce(o, CASE t WHEN 'code' THEN 'coder' WHEN 'docs' THEN 'empty' END, 'base') AS w FROM d), c AS (SELECT doc_id, CASE WHEN w IN ('base', 'coder', 'special') THEN w ELSE 'base' END AS chain FROM w)
SELECT doc_id, chain, CASE chain WHEN 'base' THEN 'tiny,small' WHEN 'coder' THEN 'local7' ELSE 'big' END AS backends, CASE WHEN chain <> 'special' THEN 'mid' END AS tier FROM c""")
def chain_choice(spark, sf):
    i = F.col("doc_id")
    d = table(spark, sf, "documents").select(i, F.when(i % 7 == 0, "special").when(i % 11 == 0, "missing").alias("o"), F.when(F.col("lang") == "en", "code").when(F.col("lang") == "de", "docs").otherwise("other").alias("t"))
    chains = {"base": [("tiny", "local"), ("small", "mid"), ("large", "premium")], "coder": [("local7", "local"), ("remote", "premium")], "special": [("big", "premium")], "empty": []}
    return d.select("doc_id", composed.choose_chain(F.col("o"), F.col("t"), {"code": "coder", "docs": "empty"}, chains, "base", "mid").alias("x")).select("doc_id", "x.*")


@register("symbol_listing", "U14", f"WITH {SPANS} SELECT id, symbol FROM spans WHERE starts_with(symbol, 'mod3.') AND length(symbol) - length(replace(symbol, '.', '')) = 1")
def symbol_listing(spark, sf):
    return chunking.listing(spans(spark, sf), "mod3").select("id", "symbol")


@register("context_search", "U13 U12", """WITH t AS (SELECT doc_id, regexp_extract_all(text, '[Ll]icen[sc]e\\w*|\\b[Tt]he\\b') AS m, regexp_split_to_array(text, '[Ll]icen[sc]e\\w*|\\b[Tt]he\\b') AS p FROM documents),
h AS (SELECT doc_id, m, p, unnest(range(0, least(20, len(m)))) AS n FROM t), b AS (SELECT doc_id, n, m[n + 1] AS hit, array_to_string(p[1:n + 1], '') || array_to_string(m[1:n], '') AS x FROM h)
SELECT doc_id, CAST(n AS INTEGER) AS nth, CAST(length(x) - length(replace(x, chr(10), '')) + 1 AS INTEGER) AS line, substr(hit, 1, 200) AS hit FROM b""")
def context_search(spark, sf):
    return chunking.context_hits(table(spark, sf, "documents").select("doc_id", "text"), r"[Ll]icen[sc]e\w*|\b[Tt]he\b", "doc_id")


@register("ast_chunks", "U9", None)
def ast_chunks(spark, sf):
    """A module per document: a small function, and a class with a method as long as the document's first hundred words."""
    body = F.array_join(F.transform(F.slice(F.split("text", r"\s+"), 1, 100), lambda w: F.concat(F.lit("        x = '"), F.regexp_replace(w, "[^a-zA-Z]", ""), F.lit("'"))), "\n")
    code = F.concat(F.lit("import os\n\ndef f(a):\n    return a\n\nclass C:\n    def g(self):\n"), body, F.lit("\n        return x\n"))
    return chunking.ast_chunks(table(spark, sf, "documents").select("doc_id", code.alias("text")), "doc_id").select("doc_id", "ordinal", "role", "symbol", "depth", "start", "end")


SCRIPT = """import {{ a }} from './lib_{w}';
export class A_{w} extends Base {{
  run(x) {{
    return this.make(x);
  }}
}}
interface I_{w} {{
}}
export function go() {{
  start(1);
}}
"""


@register("script_graph", "U18 G17", """WITH w AS (SELECT 'm' || doc_id AS module, regexp_extract(lower(text), '([a-z]+)', 1) AS w FROM documents)
SELECT module, 'relation' AS what, 'mod:' || module AS a, 'IMPORTS' AS edge, 'mod:./lib_' || w AS b FROM w
UNION ALL SELECT module, 'entity', 'type:' || module || '.A_' || w, 'class', '2-6' FROM w UNION ALL SELECT module, 'entity', 'sym:' || module || '.A_' || w || '.run', 'method', '3-5' FROM w
UNION ALL SELECT module, 'entity', 'type:' || module || '.I_' || w, 'interface', '7-8' FROM w UNION ALL SELECT module, 'entity', 'sym:' || module || '.go', 'function', '9-11' FROM w
UNION ALL SELECT module, 'relation', 'type:' || module || '.A_' || w, 'EXTENDS', 'type:Base' FROM w UNION ALL SELECT module, 'relation', 'sym:' || module || '.A_' || w || '.run', 'CALLS', 'sym:make' FROM w
UNION ALL SELECT module, 'relation', 'sym:' || module || '.go', 'CALLS', 'sym:start' FROM w""")
def script_graph(spark, sf):
    parts = SCRIPT.replace("{{", "{").replace("}}", "}").split("{w}")
    code = F.concat(*[x for i, p in enumerate(parts) for x in ([word()] if i else []) + [F.lit(p)]])
    return chunking.schema_graph(table(spark, sf, "documents").select(F.concat(F.lit("m"), "doc_id").alias("module"), code.alias("text")), extract=chunking.script_graph)


@register("skeletons", "U15", "SELECT doc_id, 'import os' || chr(10) || chr(10) || 'class B:' || chr(10) || '    ' || repeat(chr(34), 3) || 'first line' || repeat(chr(34), 3) || chr(10) || chr(10) || '    def f_' || regexp_extract(lower(text), '([a-z]+)', 1) || '(self, a=1):' || chr(10) || '        ...' AS skeleton FROM documents")
def skeletons(spark, sf):
    code = F.concat(F.lit("import os\nclass B:\n    '''first line'''\n    def f_"), word(), F.lit("(self, a=1):\n        b = a\n        return b\n"))
    return chunking.skeletons(table(spark, sf, "documents").select("doc_id", code.alias("text")), "doc_id")


CLINICAL = """r AS (SELECT DISTINCT 'Condition' || (doc_id % 40) AS s, 'drug ' || (doc_id % 9) AS t, CASE doc_id % 3 WHEN 0 THEN 'TREATED_BY' WHEN 1 THEN 'MONITORED_BY' ELSE 'ADVERSE_EVENT' END AS k, CAST(round((doc_id % 5) / 10.0 + 0.5, 1) AS DOUBLE) AS c FROM documents)"""


@register("clinical_lookups", "J20 H10", f"""WITH {CLINICAL}, n AS (SELECT 'drug:' || replace(lower(t), ' ', '_') AS id, min(struct_pack(k := CASE k WHEN 'MONITORED_BY' THEN 'test' WHEN 'ADVERSE_EVENT' THEN 'symptom' ELSE 'drug' END, t := t)) AS x FROM r GROUP BY 1)
SELECT s AS name, x.t AS target, x.k AS type, c AS confidence, CAST(row_number() OVER (PARTITION BY s ORDER BY c DESC, x.t) AS INTEGER) AS "rank" FROM r JOIN n ON n.id = 'drug:' || replace(lower(r.t), ' ', '_') WHERE r.k = 'TREATED_BY' AND c >= 0.6""")
def clinical_lookups(spark, sf):
    """Treatments of every condition, from a graph of relations."""
    i = F.col("doc_id")
    r = table(spark, sf, "documents").select(F.concat(F.lit("Condition"), i % 40).alias("source"), F.concat(F.lit("drug "), i % 9).alias("target"), F.when(i % 3 == 0, "TREATED_BY").when(i % 3 == 1, "MONITORED_BY").otherwise("ADVERSE_EVENT").alias("type"), F.round(i % 5 / 10.0 + 0.5, 1).alias("confidence"))
    n, e = composed.clinical_graph(r)
    return composed.clinical_lookup(e, n, r.select(F.col("source").alias("name")).distinct(), "TREATED_BY", "condition", 0.6)


@register("edge_filters", "H11", f"WITH {CLINICAL} SELECT s AS src, t AS dst, k AS edge_type, c AS score FROM r WHERE c >= 0.7 AND k IN ('TREATED_BY', 'ADVERSE_EVENT') AND length(s) % 2 = 0")
def edge_filters(spark, sf):
    """Edges of enough confidence, of two types, that a model has found."""
    i = F.col("doc_id")
    s = F.concat(F.lit("Condition"), i % 40)
    e = table(spark, sf, "documents").select(s.alias("src"), F.concat(F.lit("drug "), i % 9).alias("dst"), F.when(i % 3 == 0, "TREATED_BY").when(i % 3 == 1, "MONITORED_BY").otherwise("ADVERSE_EVENT").alias("edge_type"), F.round(i % 5 / 10.0 + 0.5, 1).alias("score"), F.when(F.length(s) % 2 == 0, "llm").otherwise("rule").alias("origin")).distinct()
    return composed.edges_like(e, 0.7, ["TREATED_BY", "ADVERSE_EVENT"], "llm").drop("origin")


@register("monthly_spend", "A38 A39", f"""WITH {TELE}, t AS (SELECT cmd AS model, CAST(date_trunc('month', ts) AS DATE) AS month, CAST(ts AS DATE) AS day, count(*) AS calls, CAST(sum(k) AS BIGINT) AS tokens FROM tele GROUP BY ALL),
c AS (SELECT *, tokens * CASE model WHEN 'purchase' THEN 15.0 WHEN 'view' THEN 0.15 ELSE 1.0 END / 1000000.0 AS cost FROM t)
SELECT model, month, day, calls, tokens, round(cost, 9) AS cost, round(sum(cost) OVER (PARTITION BY model, month ORDER BY day), 9) AS spent, sum(cost) OVER (PARTITION BY model, month ORDER BY day) <= 0.01 AS allowed FROM c""")
def monthly_spend(spark, sf):
    """Cost by model and day, and what a model has spent of its month's budget."""
    price = F.when(F.col("model") == "purchase", 15.0).when(F.col("model") == "view", 0.15).otherwise(1.0)
    c = telemetry(spark, sf).groupBy(F.col("cmd").alias("model"), F.trunc("ts", "month").alias("month"), F.to_date("ts").alias("day")).agg(F.count("*").alias("calls"), F.sum("k").alias("tokens")).withColumn("cost", F.col("tokens") * price / 1e6)
    spent = F.sum("cost").over(W.partitionBy("model", "month").orderBy("day"))  # a row per day
    return c.select("model", "month", "day", "calls", "tokens", F.round("cost", 9).alias("cost"), F.round(spent, 9).alias("spent"), (spent <= 0.01).alias("allowed"))


@register("collection_stats", "A41", f"WITH {FILES} SELECT regexp_extract(path, '(\\.[a-z]+)$', 1) AS ext, count(*) AS chunks, count(DISTINCT split_part(path, '/', 1)) AS projects, (SELECT count(*) FROM files) AS total FROM files GROUP BY 1")
def collection_stats(spark, sf):
    from spanloom.functions.paths import extension

    f = files(spark, sf)
    g = f.groupBy(extension(F.col("path")).alias("ext")).agg(F.count("*").alias("chunks"), F.count_distinct(F.substring_index("path", "/", 1)).alias("projects"))
    return g.withColumn("total", F.sum("chunks").over(W.partitionBy()))  # a row per extension


@register("changed_sources", "A44", f"WITH {FILES}, c AS (SELECT f.path, max(e.ts) AS seen FROM events e JOIN files f ON f.id = e.user_id WHERE f.path LIKE '%.py' GROUP BY f.path) SELECT path, CAST(row_number() OVER (ORDER BY seen DESC, path) AS INTEGER) AS n FROM c QUALIFY n <= 10")
def changed_sources(spark, sf):
    """The ten Python files that changed last; an event's user stands for the file it changed."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("id"), "ts")
    c = e.join(files(spark, sf).select("id", "path").filter("path LIKE '%.py'"), "id").groupBy("path").agg(F.max("ts").alias("at"))
    return c.orderBy(F.desc("at"), "path").limit(10).withColumn("n", F.row_number().over(W.orderBy(F.desc("at"), "path"))).select("path", "n")


@register("model_texts", "A16", f"""WITH {ENR} SELECT model, count(*) AS n, round(avg(length(summary)), 4) AS chars, count(*) FILTER (WHERE quality = 0) AS empty, round(avg(length(summary) / 4 / (1.0 + quality)), 4) AS speed FROM enrichments GROUP BY model""")
def model_texts(spark, sf):
    n = F.length("summary")
    return enrichments(spark, sf).groupBy("model").agg(F.count("*").alias("n"), F.round(F.avg(n), 4).alias("chars"), F.count_if(F.col("quality") == 0).alias("empty"), F.round(F.avg(n / 4 / (1.0 + F.col("quality"))), 4).alias("speed"))


@register("converted", "S17 X7", "SELECT 'd/' || doc_id || ['.rtf', '.pdf', '.txt'][doc_id % 3 + 1] AS path, CASE doc_id % 3 WHEN 0 THEN 'one' || chr(10) || regexp_extract(lower(text), '([a-z]+)', 1) ELSE regexp_extract(lower(text), '([a-z]+)', 1) END AS text FROM documents")
def converted(spark, sf):
    i = F.col("doc_id")
    rtf = F.concat(F.lit("{\\rtf1\\ansi one\\par "), word(), F.lit("}"))
    pdf = F.concat(F.lit("%PDF-1.4\nstream\n("), word(), F.lit(") Tj\nendstream\n"))
    d = table(spark, sf, "documents").select(F.when(i % 3 == 0, ".rtf").when(i % 3 == 1, ".pdf").otherwise(".txt").alias("ext"), F.encode(F.when(i % 3 == 0, rtf).when(i % 3 == 1, pdf).otherwise(word()), "UTF-8").alias("content"), "doc_id")
    return convert.convert(d.withColumn("path", F.concat(F.lit("d/"), "doc_id", "ext")), F.col("ext"))


@register("graph_payload", "S10", "SELECT 's:' || s_suppkey AS src, 'n:' || s_nationkey AS dst, 'IMPORTS' AS type, s_name AS name FROM supplier")
def graph_payload(spark, sf):
    """A graph file with entities by id, and relations by other names."""
    p = _folder(spark)
    s = table(spark, sf, "supplier")
    k = F.concat(F.lit("s:"), F.col("s_suppkey").cast("long"))
    rows = s.select(F.to_json(F.struct(F.array(F.struct(k.alias("symbol"), F.col("s_name").alias("label"))).alias("vertices"), F.array(F.struct(k.alias("from"), F.concat(F.lit("n:"), F.col("s_nationkey").cast("long")).alias("to"), F.lit("imports").alias("relation"))).alias("links"))).alias("value"))
    rows.write.text(p)
    n, e = io.graph_json(spark, p, multi_line=False)
    return e.join(n.select(F.col("id").alias("src"), "name"), "src").select("src", "dst", "type", "name")


@register("registry_rows", "S21", "SELECT 'repo' || n_nationkey AS name, 'path' AS key, '/srv/' || n_name AS value FROM nation UNION ALL SELECT 'repo' || n_nationkey, 'lang', 'en' FROM nation")
def registry_rows(spark, sf):
    p = _folder(spark)
    n = table(spark, sf, "nation")
    n.select(F.concat(F.lit("repo"), F.col("n_nationkey").cast("long"), F.lit(":\n  path: \"/srv/"), "n_name", F.lit("\"\n  lang: en\n")).alias("value")).coalesce(1).write.text(p)
    return io.registry(spark, p)


@register("queue_claims", "T-6 T-7", f"""WITH {QUEUE}, c AS (SELECT id, row_number() OVER (ORDER BY priority, created, id) AS n FROM queue WHERE claimed_by IS NULL QUALIFY n <= 50)
SELECT id FROM c WHERE id % 2 = 1""")
def queue_claims(spark, sf):
    """Fifty items are claimed; of those the worker has completed the even ones, and another worker's word does not count."""
    q = state.claim(queue(spark, sf), "me", 50)
    done = q.select("id", F.when(F.col("id") % 2 == 0, "me").otherwise("you").alias("worker"))
    return state.acknowledge(q, done).select("id")


@register("code_metrics", "Q8 Q9", f"""WITH {METRIC}, p AS (SELECT query_id, n, id % 3 = 0 AS code, 'src/' || id || CASE WHEN id % 3 = 0 THEN '.py' ELSE '.md' END AS path FROM t)
SELECT query_id, round(count(*) FILTER (WHERE code AND n <= 5) / CAST(count(*) FILTER (WHERE n <= 5) AS DOUBLE), 6) AS code_at_5, round(CAST(coalesce(1.0 / min(CASE WHEN code THEN n END), 0) AS DOUBLE), 6) AS mrr_code,
 round(count(*) FILTER (WHERE n <= 5 AND regexp_matches(path, '^src/.*1.*[.]py$')) / 5.0, 6) AS by_globs, round(count(*) FILTER (WHERE n <= 5 AND (contains(path, '2') OR contains(path, '.py'))) / 5.0, 6) AS by_tokens FROM p GROUP BY query_id""")
def code_metrics(spark, sf):
    from spanloom.functions.paths import any_glob, is_code
    from spanloom.operators import metrics as M

    path = F.concat(F.lit("src/"), "id", F.when(F.col("id") % 3 == 0, ".py").otherwise(".md"))
    r = judged(spark, sf).select("query_id", "rank", path.alias("path"))
    return M.by_query(r, 5, is_code(F.col("path")), any_glob(F.col("path"), ["src/*1*.py"]), F.col("path").contains("2") | F.col("path").contains(".py"))


@register("compared_arms", "Q10 Q11 Q12", f"""WITH {METRIC}, qa AS (SELECT query_id, CASE WHEN query_id % 40 = 0 THEN 'rag' ELSE 'fallback' END AS arm, count(*) FILTER (WHERE rel AND n <= 5) / 5.0 AS p, min(CASE WHEN rel THEN n END) AS f FROM t GROUP BY ALL)
SELECT arm, count(*) AS queries, round(avg(p), 6) AS precision, round(avg(CASE WHEN f <= 5 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, round(avg(coalesce(1.0 / f, 0)), 6) AS mrr, round(avg(CASE WHEN (query_id // 20) % 3 = 0 THEN 1.0 ELSE 0.0 END), 6) AS routed FROM qa GROUP BY arm""")
def compared_arms(spark, sf):
    """Precision, hit rate, mean reciprocal rank and routing accuracy of two arms."""
    from spanloom.operators import metrics as M

    r = judged(spark, sf).withColumn("arm", F.when(F.col("query_id") % 40 == 0, "rag").otherwise("fallback"))
    return M.by_arm(r, 5, F.floor(F.col("query_id") / 20) % 3 == 0)


