"""File trees, ignore rules, the tools in SQL, packed contexts, the feeder, and clinical questions over texts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from spanloom import sqltools
from spanloom.functions import ignore
from spanloom.operators import clinical, composed, context
from spanloom.operators.search import top
from spanloom.plans.base import EDGES, ENR, EXT, FILES, NODES, edges, enrichments, files, nodes, spans
from spanloom.plans.catalog import register
from spanloom.plans.graphs import INDEX
from spanloom.plans.retrieval import ALL, COS, nearest
from spanloom.runtime import scratch_dir, spread, table, write_once
from spanloom.sources import tree as T

FOLDERS = ["src", "src/gen", "node_modules/lib", "docs", "build/out", "lib/core", "lib/build/x", "tools"]


def _ext():
    out = F.lit(".json")
    for k, v in EXT.items():
        out = F.when(F.col("lang") == k, v).otherwise(out)
    return out


def laid_out(spark, sf):
    """(id, repo, lang, path, text): documents in the folders of a repository."""
    folder = F.element_at(F.array(*map(F.lit, FOLDERS)), (F.col("doc_id") % 8 + 1).cast("int"))
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("id"), F.col("source").alias("repo"), "lang", F.concat_ws("", folder, F.lit("/"), F.coalesce("lang", F.lit("und")), F.lit("/doc"), "doc_id", _ext()).alias("path"), F.coalesce("text", F.lit("")).alias("text"))


LAID = f"""laid AS (SELECT doc_id AS id, source AS repo, lang, doc_id % 8 AS f, {FOLDERS}[doc_id % 8 + 1] || '/' || coalesce(lang, 'und') || '/doc' || doc_id
 || CASE lang WHEN 'en' THEN '.py' WHEN 'de' THEN '.ts' WHEN 'fr' THEN '.md' ELSE '.json' END AS path, coalesce(text, '') AS text FROM documents)"""


def written(spark, sf) -> str:
    """The root of a tree of the documents in the shared folder."""
    root = f"{scratch_dir(spark)}/tree-{uuid.uuid4().hex[:12]}"
    T.write_tree(laid_out(spark, sf), root)
    return root


@register("file_tree", "S1 S2 S3", f"""WITH {LAID} SELECT path, regexp_extract(path, '(\\.[a-z]+)$', 1) AS extension, CAST(octet_length(encode(text)) AS BIGINT) AS size, sha256(text) AS file_hash FROM laid
WHERE f IN (0, 3, 5, 7) AND (path NOT LIKE '%.md' OR f = 3) AND NOT (f = 7 AND lang = 'de')""")
def file_tree(spark, sf):
    """A tree is written and walked: excluded directories, ignore rules and more globs are pruned on the way."""
    t = T.tree(spark, written(spark, sf), rules=["gen/", "*.md", "!/docs/**/*.md"], globs=["tools/de/"], content="true")
    return t.select("path", "extension", "size", F.sha2("text", 256).alias("file_hash"))


@register("graph_sources", "S6", f"""WITH {LAID} SELECT path, extension, count(*) OVER (PARTITION BY extension) AS n FROM (SELECT path, regexp_extract(path, '(\\.[a-z]+)$', 1) AS extension FROM laid WHERE f NOT IN (2, 5, 6))
WHERE extension IN ('.py', '.ts')""")
def graph_sources(spark, sf):
    """Sources of the schema graph, outside node_modules and lib, and how many have their extension."""
    t = T.tree(spark, written(spark, sf), extensions=T.GRAPH_SOURCES, exclude=["node_modules", "lib"])
    n = t.groupBy("extension").agg(F.count("*").alias("n"))
    return t.select("path", "extension").join(n, "extension").select("path", "extension", "n")


RULE_FILES = ["*.json\n!/docs/**/*.json\ngen/\n/build/\n# tools but for one language\ntools/*\n!tools/en/\n", "*\n!*/\n!*.py\n/node_modules\n**/core/**\n"]


@register("ignore_rules", "S2 S3 B21", f"""WITH {LAID} SELECT repo, path, CASE WHEN length(repo) % 2 = 0 THEN path LIKE '%.json' AND f <> 3 OR f = 1 OR f = 4 OR f = 7 AND coalesce(lang, '') <> 'en'
 ELSE path NOT LIKE '%.py' OR f = 2 OR f = 5 END AS ignored FROM laid""")
def ignore_rules(spark, sf):
    """Every repository has an ignore file of its own; all paths are judged by their repository's."""
    d = laid_out(spark, sf)
    held = d.select("repo").distinct().withColumn("text", F.when(F.length("repo") % 2 == 0, RULE_FILES[0]).otherwise(RULE_FILES[1]))
    r = held.select("repo", ignore.parsed("text").alias("rules"))
    return d.join(r, "repo", "left").select("repo", "path", ignore.ignored_by(F.col("path"), F.col("rules")).alias("ignored"))


USED = INDEX.replace("'IMPORTS', 'EXTENDS'", ", ".join(f"'{t}'" for t in sqltools.EDGE_TYPES))
MADE = USED.replace("d.id = e.dst", "d.id = e.src").replace("u.id = e.src", "u.id = e.dst")
ASKED = "q(symbol) AS (SELECT n_name FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT s_name FROM supplier)"
FIRST = 'SELECT symbol, path, CAST(n AS INTEGER) AS "rank" FROM (SELECT symbol, path, row_number() OVER (PARTITION BY symbol ORDER BY path) AS n FROM q JOIN ix ON ix.key = symbol) WHERE n <= {n}'


def tools(spark, sf) -> None:
    """The functions, and a view of the symbols that are asked for: nations, regions and suppliers."""
    n = nodes(spark, sf)
    sqltools.register(spark, n, edges(spark, sf))
    n.filter("kind IN ('class', 'module', 'function')").selectExpr("name AS symbol").createOrReplaceTempView("asked_symbols")


@register("sql_where_used", "X9 G2 G21", f"WITH {NODES}, {EDGES}, {USED}, {ASKED} {FIRST.format(n=10)}")
def sql_where_used(spark, sf):
    tools(spark, sf)
    return spark.sql("SELECT s.symbol, w.path, w.rank FROM asked_symbols s, LATERAL where_used(s.symbol, 10) w")


@register("sql_lineage", "X9 G3", f"WITH {NODES}, {EDGES}, {MADE}, {ASKED} {FIRST.format(n=5)}")
def sql_lineage(spark, sf):
    tools(spark, sf)
    return spark.sql("SELECT s.symbol, w.path, w.rank FROM asked_symbols s, LATERAL lineage(s.symbol, 5) w")


@register("sql_neighbours", "X9 O11 J16 J17 J18 G15", f"""WITH {EDGES}, s AS (SELECT 's:' || s_suppkey AS id FROM supplier), r AS (
SELECT s.id AS symbol, 'in' AS direction, type, src AS id, row_number() OVER (PARTITION BY dst ORDER BY src, type) AS n FROM s JOIN edges ON dst = s.id
UNION ALL SELECT s.id, 'out', type, dst, row_number() OVER (PARTITION BY src ORDER BY dst, type) FROM s JOIN edges ON src = s.id)
SELECT symbol, direction, type, id, CAST(n AS INTEGER) AS "rank" FROM r WHERE n <= 10""")
def sql_neighbours(spark, sf):
    """Of every supplier the first ten neighbours on either side."""
    tools(spark, sf)
    nodes(spark, sf).filter("kind = 'function'").select("id").createOrReplaceTempView("asked_ids")
    return spark.sql("SELECT s.id AS symbol, w.direction, w.type, w.id, w.rank FROM asked_ids s, LATERAL neighbours(s.id, 10) w")


@register("sql_stats", "X9 X10 G22", f"WITH {NODES}, {EDGES} SELECT 'nodes' AS what, count(*) AS n FROM nodes UNION ALL SELECT 'edges', count(*) FROM edges UNION ALL SELECT type, count(*) FROM edges GROUP BY type")
def sql_stats(spark, sf):
    tools(spark, sf)
    return spark.sql("SELECT * FROM rag_stats()")


@register("sql_first_of", "X9 X10", f"WITH {NODES}, {EDGES}, {USED}, {ASKED} {FIRST.format(n=3)}")
def sql_first_of(spark, sf):
    """The same by a function of a table, which asks for its partitioning."""
    tools(spark, sf)
    return spark.sql("SELECT * FROM first_of(TABLE(SELECT s.symbol, u.path FROM asked_symbols s JOIN rag_used_by u ON u.key = s.symbol), key => 'symbol', sorted_by => 'path', n => 3)")


@register("sql_take_budget", "X9 W7", f"""WITH {FILES}, c AS (SELECT lang, id, size, sum(size) OVER (PARTITION BY lang ORDER BY size, id ROWS UNBOUNDED PRECEDING) AS spent FROM files)
SELECT lang, id, CAST(size AS BIGINT) AS size, CAST(spent AS BIGINT) AS spent FROM c WHERE spent <= 20000""")
def sql_take_budget(spark, sf):
    """Of every language the smallest files, up to 20,000 characters."""
    tools(spark, sf)
    files(spark, sf).selectExpr("lang", "id", "CAST(size AS BIGINT) AS size").createOrReplaceTempView("sized_files")
    return spark.sql("SELECT * FROM take_budget(TABLE(sized_files) PARTITION BY lang ORDER BY (size, id), cost => 'size', budget => 20000)")


@register("task_context", "R34 O8", f"""WITH {COS.format(n=ALL)}, {FILES}, h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS n FROM c),
k AS (SELECT query_id, n, f.path, chr(10) || '### ' || f.path || ' (relevance: ' || CAST(round(CAST(score AS DECIMAL(38, 18)), 2) AS DECIMAL(20, 2)) || ')' || chr(10) || '```' || chr(10) || f.text || chr(10) || '```' || chr(10) AS chunk
  FROM h JOIN files f ON f.id = h.id WHERE n <= 20),
t AS (SELECT DISTINCT query_id, '# Project: spanloom' || chr(10) || '# Task: look for ' || query_id || chr(10) || chr(10) || '## Relevant Code Context:' || chr(10) AS head FROM c),
w AS (SELECT k.*, len(list_filter(string_split_regex(head, '\\s+'), lambda x: x <> '')) + sum(len(list_filter(string_split_regex(chunk, '\\s+'), lambda x: x <> ''))) OVER (PARTITION BY query_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS s FROM k JOIN t USING (query_id)),
g AS (SELECT query_id, string_agg(chunk, chr(10) ORDER BY n) AS body, max(s) AS words, count(DISTINCT path) AS files FROM w WHERE s <= 2000 GROUP BY query_id)
SELECT query_id, CASE WHEN query_id IN (SELECT query_id FROM k) THEN head || '## Files referenced: ' || coalesce(files, 0) || chr(10) || chr(10) || CASE WHEN body IS NULL THEN '' ELSE chr(10) || body END
  ELSE 'Project: spanloom' || chr(10) || 'No relevant context found.' || chr(10) END AS context,
 CAST(CASE WHEN query_id IN (SELECT query_id FROM k) THEN coalesce(words, len(list_filter(string_split_regex(head, '\\s+'), lambda x: x <> ''))) ELSE 0 END AS BIGINT) AS words, coalesce(files, 0) AS files FROM t LEFT JOIN g USING (query_id)""")
def task_context(spark, sf):
    """The texts of the twenty nearest of every query, packed into 2,000 words."""
    h = top(nearest(spark, sf, 20), ["query_id"], 20, F.desc("score"), F.col("id"))
    h = h.join(files(spark, sf).select("id", "path", "text"), "id").select("query_id", "rank", "path", F.col("score").alias("relevance"), "text")
    q = table(spark, sf, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id")).distinct()
    return context.task_context(q.select("query_id", F.lit("spanloom").alias("project"), F.concat(F.lit("look for "), "query_id").alias("task")), h, 2000)


@register("public_results", "B4", f"WITH {COS.format(n=ALL)} SELECT query_id, id, score, label FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS n FROM c) WHERE n <= 5")
def public_results(spark, sf):
    """Hits with fields of fusion and expansion, which stay inside."""
    h = top(nearest(spark, sf, 5), ["query_id"], 5, F.desc("score"), F.col("id")).withColumnRenamed("rank", "_rank")
    return context.public(h.withColumn("slice_id", F.xxhash64("id")).withColumn("_route", F.lit("vec")).select("query_id", "id", "score", "label", "slice_id", "_route", "_rank"))


@register("feed_repos", "T-11 J3 F30 T-5", f"""WITH {ENR}, s AS (SELECT s.id, split_part(f.path, '/', 1) AS repo, f.path, s.pos, s.span_hash FROM spans s JOIN files f ON f.id = s.file_id),
d AS (SELECT DISTINCT repo, span_hash FROM s WHERE span_hash IN (SELECT span_hash FROM enrichments)), u AS (SELECT DISTINCT repo, span_hash FROM s WHERE pos = 1),
p AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY id) AS n FROM s WHERE (repo, span_hash) NOT IN (SELECT (repo, span_hash) FROM d)),
x AS (SELECT repo, span_hash, min_by(path, id) AS path FROM p WHERE n <= 100 GROUP BY ALL)
SELECT repo, span_hash, path, CAST(CASE WHEN path LIKE '%.py' OR path LIKE '%.ts' THEN 3 WHEN path LIKE '%.md' THEN 7 ELSE 5 END AS INTEGER) AS priority FROM x WHERE (repo, span_hash) NOT IN (SELECT (repo, span_hash) FROM u)""")
def feed_repos(spark, sf):
    """Sources are repositories; the second line of every document is in the queue already."""
    f = files(spark, sf).select(F.col("id").alias("file_id"), "path", F.substring_index("path", "/", 1).alias("repo"))
    s = spans(spark, sf).select("id", "file_id", "pos", "span_hash").join(f, "file_id")
    done = s.join(enrichments(spark, sf).select("span_hash"), "span_hash", "left_semi")
    return context.feed(s.select("id", "repo", "path", "span_hash"), done, s.filter("pos = 1"), 100)


SENTENCES = [("{0} is treated with {1}", "TREATED_BY", 0, 1, 0.9), ("{1} is contraindicated in {2}", "CONTRAINDICATES", 1, 2, 0.9), ("{1} is linked to {3} as side effect", "ADVERSE_EVENT", 1, 3, 0.8),
             ("{2} may cause {3}", "ADVERSE_EVENT", 2, 3, 0.9), ("{0} monitored by {4}", "MONITORED_BY", 0, 4, 0.9), ("{0} responds to {3}", "TREATED_BY", 0, 3, 0.7)]
QUESTIONS = [("treatments", "TREATED_BY", "condition", 0.0), ("contraindications", "CONTRAINDICATES", "condition", 0.0), ("adverse_events", "ADVERSE_EVENT", "condition", 0.85), ("monitoring", "MONITORED_BY", "condition", 0.0)]

CLINICAL = "w AS (SELECT list_transform(range(5), lambda i: coalesce('x' || regexp_extract_all(lower(text), '([a-z]+)', 1)[i + 1], 'none')) AS w FROM documents),\nr AS (" + "\n UNION ".join(
    f"SELECT w[{a + 1}] AS s, w[{b + 1}] AS t, '{k}' AS k, CAST({c} AS DOUBLE) AS c FROM w" for _, k, a, b, c in SENTENCES) + ")"


@register("clinical_answers", "J20 H10 H11 U23", f"""WITH {CLINICAL}, n AS (SELECT id, min(struct_pack(kind := kind, name := name)) AS x FROM (
 SELECT 'condition:' || s AS id, s AS name, CASE WHEN k = 'ADVERSE_EVENT' THEN 'drug' ELSE 'condition' END AS kind FROM r
 UNION ALL SELECT 'drug:' || t, t, CASE k WHEN 'MONITORED_BY' THEN 'test' WHEN 'ADVERSE_EVENT' THEN 'symptom' ELSE 'drug' END FROM r) GROUP BY id),
a(question, k, least) AS (VALUES {", ".join(f"('{q}', '{k}', {x})" for q, k, _, x in QUESTIONS)})
SELECT question, s AS name, x.name AS target, x.kind AS type, c AS confidence, CAST(row_number() OVER (PARTITION BY question, s ORDER BY c DESC, x.name) AS INTEGER) AS "rank"
FROM r JOIN a USING (k) JOIN n ON n.id = 'drug:' || t WHERE c >= least""")
def clinical_answers(spark, sf):
    """Relations found in sentences of each document's first words, the graph of them, and what treats, forbids, follows and monitors every name in it."""
    docs = spread(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"))
    first = docs.select("id", F.regexp_extract_all(F.regexp_extract(F.lower("text"), "^(?:[^a-z]*+[a-z]++){0,5}", 0), F.lit("([a-z]+)"), F.lit(1)).alias("words"))
    first = first.groupBy("words").agg(F.min("id").alias("id"))  # equal words say the same
    word = [F.coalesce(F.concat(F.lit("x"), F.get("words", F.lit(i))), F.lit("none")) for i in range(5)]
    said = []
    for pattern, *_ in SENTENCES:
        at = pattern.replace("{", "}").split("}")
        said.append(F.concat(*[word[int(x)] if i % 2 else F.lit(x) for i, x in enumerate(at)]))
    r = clinical.relations(first.select("id", F.concat_ws(". ", *said).alias("text")))
    # nodes, edges and names of four questions read the relations: they are found once
    r = write_once(r.select("source", "target", "type", F.round("confidence", 6).alias("confidence")).distinct(), "relations")
    n, e = composed.clinical_graph(r)
    names = r.select(F.col("source").alias("name")).distinct()
    out = [composed.clinical_lookup(e, n, names, k, p, least).select(F.lit(q).alias("question"), "name", "target", "type", "confidence", "rank") for q, k, p, least in QUESTIONS]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])
