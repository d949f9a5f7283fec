"""Plans of enrichment, attachments, callers, indexes of vectors, dictionaries in files, training examples, trimmed results."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from spanloom.functions import classify as C
from spanloom.functions import ignore
from spanloom.operators import analyze, composed, work
from spanloom.operators.search import top
from spanloom.plans.base import EDGES, ENR, NODES, edges, enrichments, files, nodes, spans
from spanloom.plans.catalog import register
from spanloom.plans.retrieval import ALL, COS, nearest
from spanloom.plans.scalars import ASKED, asked, sql_any, sql_count
from spanloom.runtime import scratch_dir, table
from spanloom.sources import files as io


def _folder(spark) -> str:
    return f"{scratch_dir(spark)}/work-{uuid.uuid4().hex[:12]}"


@register("enrichment_plan", "P1 P3 O12 O8 S2", f"""WITH {ENR}, s AS (SELECT s.id, s.file_id, s.pos, f.path, s.span_hash, f.mtime, s.lang, s.kind, s.start_line, s.end_line, s.text FROM spans s JOIN files f ON f.id = s.file_id),
o AS (SELECT *, row_number() OVER (PARTITION BY span_hash ORDER BY id) AS n FROM s WHERE span_hash NOT IN (SELECT span_hash FROM enrichments)),
p AS (SELECT * FROM o WHERE n = 1 AND 100000 - mtime >= 99000 ORDER BY id LIMIT 500)
SELECT CASE WHEN file_id % 9 = 4 THEN 'missing' ELSE 'plan' END AS part, CASE WHEN file_id % 9 = 4 THEN NULL ELSE span_hash END AS span_hash, path, CASE WHEN file_id % 9 <> 4 THEN kind END AS content_type,
 CASE WHEN file_id % 9 <> 4 THEN pos + 1 END AS line, CASE WHEN file_id % 9 <> 4 THEN CASE WHEN length(text) > 60 THEN substr(text, 1, 59) || '…' ELSE text END END AS code_snippet,
 CASE WHEN file_id % 9 <> 4 THEN 7 END AS fields FROM p WHERE path NOT LIKE '%.md' GROUP BY ALL""")
def enrichment_plan(spark, sf):
    """The first 500 spans that wait, of files not touched lately; Markdown is ignored, and every ninth file is gone."""
    f = files(spark, sf).select(F.col("id").alias("file_id"), "path", "mtime", "text")
    s = spans(spark, sf).join(f.drop("text"), "file_id").withColumn("start_line", F.col("pos") + 1).withColumn("end_line", F.col("pos") + 1)
    rows, missing = work.plan(s, f.filter("file_id % 9 <> 4"), enrichments(spark, sf), ignore.ignored(F.col("path"), ignore.rules(["*.md"])), 100_000, 99_000, 500, 60)
    a = rows.select(F.lit("plan").alias("part"), "span_hash", "path", "content_type", F.col("lines")[0].alias("line"), "code_snippet", F.size("llm_contract.fields").alias("fields"))
    return a.unionByName(missing.select(F.lit("missing").alias("part"), "path"), allowMissingColumns=True)


@register("attached_snippets", "J10 J9", f"""WITH {ENR}, k AS (SELECT DISTINCT s.span_hash, f.path, s.start_line AS line, e.summary FROM spans s JOIN files f ON f.id = s.file_id JOIN enrichments e ON e.span_hash = s.span_hash),
i AS (SELECT s.id AS item, f.path, CASE WHEN s.pos % 3 <> 2 THEN s.start_line END AS line, CASE WHEN s.pos % 2 = 1 THEN s.span_hash END AS span_hash FROM spans s JOIN files f ON f.id = s.file_id),
a AS (SELECT item, 0 AS way, 'span' AS strategy, k.* FROM i JOIN k ON i.span_hash = k.span_hash UNION ALL SELECT item, 1, 'line', k.* FROM i JOIN k ON i.path = k.path AND i.line = k.line UNION ALL SELECT item, 2, 'path', k.* FROM i JOIN k ON i.path = k.path),
r AS (SELECT *, row_number() OVER (PARTITION BY item, way ORDER BY line, summary, span_hash) AS n, min(way) OVER (PARTITION BY item) AS best FROM a)
SELECT item, strategy, CAST(n AS INTEGER) AS n, CASE WHEN length(summary) > 40 THEN substr(summary, 1, 39) || '…' ELSE summary END AS summary, length(summary) > 40 AS truncated FROM r WHERE way = best AND n <= 2""")
def attached_snippets(spark, sf):
    """Two snippets at most for every line of a document, of 40 characters at most."""
    f = files(spark, sf).select(F.col("id").alias("file_id"), "path")
    s = spans(spark, sf).select("id", "file_id", "pos", "start_line", "span_hash").join(f, "file_id")
    k = s.join(enrichments(spark, sf).select("span_hash", "summary"), "span_hash").select("span_hash", "path", F.col("start_line").alias("line"), "summary").distinct()
    i = s.select(F.col("id").alias("item"), "path", F.when(F.col("pos") % 3 != 2, F.col("start_line")).alias("line"), F.when(F.col("pos") % 2 == 1, F.col("span_hash")).alias("span_hash"))
    return work.attached(i, k, 2, 40)


SIDES = [("CALLED BY", "CALLS", "dst", "src"), ("CALLS", "CALLS", "src", "dst"), ("IMPORTED BY", "IMPORTS", "dst", "src"), ("IMPORTS", "IMPORTS", "src", "dst")]


@register("who_calls", "G21 J16 J17", f"""WITH {EDGES}, q AS (SELECT 's:' || s_suppkey AS id FROM supplier UNION ALL SELECT 'n:' || n_nationkey FROM nation),
e AS ({" UNION ALL ".join(f"SELECT {h} AS id, {o} AS other, '{t}' AS title FROM edges WHERE type = '{k}'" for t, k, h, o in SIDES)}),
r AS (SELECT *, row_number() OVER (PARTITION BY id, title ORDER BY other) AS n FROM e), g AS (SELECT id, title, count(*) AS n, string_agg(CASE WHEN n <= 5 THEN other END, ',' ORDER BY other) AS first FROM r GROUP BY ALL)
SELECT q.id, t.title, coalesce(g.n, 0) AS n, g.first FROM q CROSS JOIN (VALUES {", ".join(f"('{t}')" for t, *_ in SIDES)}) t(title) LEFT JOIN g ON g.id = q.id AND g.title = t.title""")
def who_calls(spark, sf):
    e = edges(spark, sf)
    ids = table(spark, sf, "supplier").select(F.concat(F.lit("s:"), F.col("s_suppkey").cast("long")).alias("id")).unionByName(table(spark, sf, "nation").select(F.concat(F.lit("n:"), F.col("n_nationkey").cast("long")).alias("id")))
    return work.who(ids, e, 5)


@register("vector_indexes", "M4 F36 S9", f"""WITH {ENR}, s AS (SELECT s.span_hash, f.path, s.symbol, s.kind, s.pos, s.file_id FROM spans s JOIN files f ON f.id = s.file_id),
v AS (SELECT DISTINCT span_hash FROM s WHERE pos = 0), c AS (SELECT span_hash FROM s GROUP BY 1 HAVING bool_or(pos = 0) AND min(file_id) % 2 = 0),
x AS (SELECT 'embeddings' AS index_name, span_hash, CASE WHEN span_hash IN (SELECT span_hash FROM c) THEN 'second' ELSE 'first' END AS profile FROM v UNION ALL SELECT 'emb_code', span_hash, 'second' FROM c)
SELECT x.index_name, x.profile, s.path, s.symbol, s.kind, coalesce(e.summary, '') AS summary FROM x JOIN s USING (span_hash) LEFT JOIN enrichments e ON e.span_hash = x.span_hash WHERE x.index_name = 'emb_code' OR s.pos = 0""")
def vector_indexes(spark, sf):
    """Vectors in two indexes, a folder each; a second batch replaces some. One index is scanned whole, of the other what begins a document, with spans and summaries."""
    s = spans(spark, sf).select("span_hash", "file_id", "symbol", "kind", "start_line", "end_line", F.lit(None).cast("string").alias("doc_hint"), "pos")
    h = s.groupBy("span_hash").agg(F.bool_or(F.col("pos") == 0).alias("first"), F.min("file_id").alias("f")).filter("first")
    row = lambda d, index, profile: d.select(F.lit(index).alias("index_name"), "span_hash", F.array(F.length("span_hash").cast("float")).alias("vector"), F.lit("docs").alias("route"), F.lit(profile).alias("profile"))
    again = h.filter("f % 2 = 0")
    p = _folder(spark)
    work.upsert_vectors(row(h, "embeddings", "first"), row(again, "embeddings", "second").unionByName(row(again, "emb_code", "second"))).write.partitionBy("index_name").parquet(p)
    v = spark.read.parquet(p)
    out = None
    for name in work.INDEXES:
        one = v.filter(F.col("index_name") == name).select("span_hash", F.struct("vector", "profile").alias("vector"))
        scan = work.vector_scan(one, s.filter(F.col("pos") == 0) if name == "embeddings" else s, files(spark, sf), enrichments(spark, sf))
        scan = scan.select(F.lit(name).alias("index_name"), "vector.profile", "path", "symbol", "kind", "summary")
        out = scan if out is None else out.unionByName(scan)
    return out


@register("dictionary_files", "S19 S20 F40", """WITH o(ontology, code, term) AS (SELECT 'icd10', 'n' || n_nationkey, n_name FROM nation UNION ALL SELECT 'loinc', 'r' || r_regionkey, r_name FROM region),
a(short, long) AS (SELECT substr(n_name, 1, 3) || n_nationkey, n_name FROM nation)
SELECT c_custkey AS id, o.ontology, o.term, a.short FROM customer JOIN o ON o.code IN ('n' || c_nationkey, 'r' || (c_nationkey % 5)) LEFT JOIN a ON a.long = o.term""")
def dictionary_files(spark, sf):
    """Dictionaries as JSON files and acronyms as a file of tabs without a header, written and read back; every customer's nation and another code looked up in them."""
    p = _folder(spark)
    made = {"icd10": ("nation", "n", "n_nationkey", "n_name"), "loinc": ("region", "r", "r_regionkey", "r_name")}
    for name, (t, tag, key, label) in made.items():  # one file holds a dictionary, as a user's does
        d = table(spark, sf, t).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit(tag), F.col(key).cast("long")), F.col(label))))).alias("value"))
        d.write.text(f"{p}/{name}.json")
    table(spark, sf, "nation").select(F.concat(F.substring("n_name", 1, 3), F.col("n_nationkey").cast("long")), "n_name").write.option("sep", "\t").csv(f"{p}/acronyms")
    o = io.ontology(spark, p, list(made))
    a = io.tsv(spark, f"{p}/acronyms", "short string, term string")
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.explode(F.array(F.concat(F.lit("n"), F.col("c_nationkey").cast("long")), F.concat(F.lit("r"), (F.col("c_nationkey") % 5).cast("long")))).alias("code"))
    return c.join(o, "code").join(a, "term", "left").select("id", "ontology", "term", "short")


@register("training_lines", "S31", """SELECT 'look up ' || item_id AS query, 'rag_search' AS tool, CAST(item_id AS VARCHAR) AS argument, text AS output, 3 AS messages FROM benchmark""")
def training_lines(spark, sf):
    """A training example for every benchmark item, written as lines of JSON and read back."""
    p = _folder(spark)
    c = table(spark, sf, "benchmark").select(F.lit("rag_search").alias("tool"), F.create_map(F.lit("query"), F.col("item_id").cast("string")).alias("arguments"), F.concat(F.lit("look up "), "item_id").alias("query"), F.col("text").alias("output"))
    work.tool_examples(c).write.text(p)
    m = spark.read.schema("messages array<struct<role:string,content:string,name:string,tool_call_id:string,tool_calls array<struct<id:string,function:struct<name:string,arguments:string>>>>>".replace("tool_calls array", "tool_calls:array")).json(p)
    call = F.col("messages")[1]["tool_calls"][0]
    same = m.filter(call["id"] == F.col("messages")[2]["tool_call_id"])
    return same.select(F.col("messages")[0]["content"].alias("query"), call["function"]["name"].alias("tool"), F.get_json_object(call["function"]["arguments"], "$.query").alias("argument"), F.col("messages")[2]["content"].alias("output"), F.size("messages").alias("messages"))


@register("trimmed_rows", "R15 R16", f"""WITH RECURSIVE {COS.format(n=ALL)}, h AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS n FROM c QUALIFY n <= 20),
d AS (SELECT h.query_id, h.id, h.score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, h.id) AS i, list_distinct(list_filter(string_split_regex(lower(t.text), '\\s+'), lambda x: x <> '')) AS w, length(t.text) // 4 AS tok
  FROM h JOIN documents t ON t.doc_id = h.id WHERE score >= 0.3),
s AS (SELECT a.query_id, a.i AS a, b.i AS b, CASE WHEN len(a.w) > 0 AND len(b.w) > 0 THEN len(list_intersect(a.w, b.w)) / CAST(len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)) AS DOUBLE) ELSE 0.0 END AS sim FROM d a JOIN d b ON a.query_id = b.query_id),
p(query_id, picks) AS (SELECT DISTINCT query_id, [1] FROM d UNION ALL
 SELECT query_id, max_by(picks, v) || [-(max(v)).m] FROM (SELECT p.query_id, p.picks, d.i, struct_pack(v := 0.7 * d.score - (1 - 0.7) * max(s.sim), m := -d.i) AS v
   FROM p JOIN d ON d.query_id = p.query_id AND NOT list_contains(p.picks, d.i) JOIN s ON s.query_id = p.query_id AND s.a = d.i AND list_contains(p.picks, s.b) GROUP BY p.query_id, p.picks, d.i, d.score) GROUP BY query_id),
l AS (SELECT query_id, max_by(picks, len(picks)) AS picks FROM p GROUP BY query_id), u AS (SELECT query_id, unnest(picks) AS i, generate_subscripts(picks, 1) AS pick FROM l),
r AS (SELECT u.query_id, d.id, pick, sum(tok) OVER (PARTITION BY u.query_id ORDER BY pick) AS used FROM u JOIN d ON d.query_id = u.query_id AND d.i = u.i)
SELECT query_id, id, CAST(pick AS INTEGER) AS pick, CAST(used AS BIGINT) AS used FROM r WHERE used <= 2000""")
def trimmed_rows(spark, sf):
    """The twenty nearest of every query, of enough relevance, made diverse, in 2,000 tokens."""
    h = top(nearest(spark, sf, 20), ["query_id"], 20, F.desc("score"), F.col("id"))
    h = h.join(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), "id").select("query_id", "id", F.col("score").alias("relevance"), "text")
    return composed.trimmed(h, 2000)[0]


@register("analyzed_queries", "C14 C18", f"""WITH {ASKED}, {NODES}, e AS (SELECT DISTINCT name || ':' || kind AS id, kind FROM nodes),
t AS (SELECT DISTINCT item_id, lower(w) AS w FROM (SELECT item_id, unnest(list_concat(list_filter(regexp_extract_all(q, '[\\p{{L}}\\p{{N}}_]+'), lambda x: regexp_full_match(x, '[a-z][a-zA-Z0-9_]*[a-zA-Z0-9]')),
 regexp_extract_all(q, '[''"`]([a-zA-Z_][a-zA-Z0-9_.]*)[''"`]', 1))) AS w FROM asked)),
m AS (SELECT w, id, kind, row_number() OVER (PARTITION BY w ORDER BY id) AS n FROM (SELECT DISTINCT w FROM t) JOIN e ON contains(lower(id), w)),
f AS (SELECT DISTINCT item_id, id, kind FROM t JOIN m USING (w) WHERE n <= 3), g AS (SELECT item_id, count(*) AS n, count(*) FILTER (WHERE kind <> 'module') AS held FROM f GROUP BY item_id)
SELECT item_id AS query_id, {sql_any('lower(q)', C.RELATION)} AS relation_task, coalesce(n, 0) AS n_entities, CASE WHEN n > 0 THEN held / CAST(n AS DOUBLE) ELSE 0.0 END AS coverage,
 CAST(least(least(coalesce(n, 0), 4) + least({sql_count('lower(q)', C.RELATION)}, 3) + CASE WHEN {sql_any('lower(q)', C.MULTI_HOP)} THEN 2 ELSE 0 END
  + CASE WHEN len(list_filter(regexp_split_to_array(q, '\\s+'), lambda w: w <> '')) > 15 THEN 1 ELSE 0 END, 10) AS INTEGER) AS complexity FROM asked LEFT JOIN g USING (item_id)""")
def analyzed_queries(spark, sf):
    """Entities are named by name and kind; the graph lacks the modules."""
    e = nodes(spark, sf).select(F.concat("name", F.lit(":"), "kind").alias("id"), "kind").distinct()
    return analyze.analyzed(asked(spark, sf).select(F.col("item_id").alias("query_id"), F.col("q").alias("text")), e, e.filter("kind <> 'module'"))
