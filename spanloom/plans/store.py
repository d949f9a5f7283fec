"""Scans, joins, set operations and writes of the span store."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.operators import merge
from spanloom.plans.base import ENR, FILES, NODES, QUEUE, SPANS, TELE, edges, enrichments, files, nodes, queue, span_hash, spans, telemetry
from spanloom.plans.catalog import register
from spanloom.runtime import table


@register("files_manifest", "S1 F11 F29 F36 F26", f"WITH {FILES} SELECT id, path, lang, file_hash, size, mtime, split_part(path, ':', 1) AS norm_path, regexp_extract(path, '(\\.[a-z]+)$', 1) AS ext FROM files")
def files_manifest(spark, sf):
    return files(spark, sf).drop("text").select("*", F.substring_index("path", ":", 1).alias("norm_path"), F.regexp_extract("path", r"(\.[a-z]+)$", 1).alias("ext"))


@register("ignore_globs", "S2 S3 B21 B18", f"WITH {FILES} SELECT path, regexp_matches(path, '^src1[^/]*/') OR regexp_matches(path, '^.*\\.json$') OR regexp_matches(path, '^src2/en/') AS ignored FROM files")
def ignore_globs(spark, sf):
    from spanloom.functions.paths import any_glob

    return files(spark, sf).select("path", any_glob(F.col("path"), ["src1*/*", "*.json", "src2/en/"]).alias("ignored"))


@register("changed_paths_semi", "S4 B6", f"WITH {FILES} SELECT id, path FROM files WHERE id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def changed_paths_semi(spark, sf):
    return files(spark, sf).select("id", "path").join(table(spark, sf, "labels").filter("toxic = 1").select(F.col("doc_id").alias("id")), "id", "left_semi")


@register("rescan_changes", "S5 E4", f"""WITH {FILES}, a AS (SELECT path, file_hash AS h, size AS s, mtime AS m FROM files WHERE id % 10 <> 3),
b AS (SELECT path, CASE WHEN id % 7 = 0 THEN 'new' || file_hash ELSE file_hash END AS h, size AS s, mtime + CASE WHEN id % 14 = 0 THEN 5 ELSE 0 END AS m FROM files WHERE id % 10 <> 4),
j AS (SELECT coalesce(a.path, b.path) AS path, a.h AS h0, CASE WHEN abs(a.m - b.m) < 0.001 AND a.s = b.s THEN a.h ELSE b.h END AS h1, b.m AS m1 FROM a FULL JOIN b ON a.path = b.path)
SELECT path, CASE WHEN h0 IS NULL THEN 'added' WHEN m1 IS NULL THEN 'deleted' ELSE 'changed' END AS status, coalesce(h1, h0) AS hash FROM j WHERE h0 IS NULL OR m1 IS NULL OR h1 <> h0""")
def rescan_changes(spark, sf):
    f = files(spark, sf)
    a = f.filter("id % 10 <> 3").select("path", F.col("file_hash").alias("hash"), "size", "mtime")
    b = f.filter("id % 10 <> 4").select("path", F.when(F.col("id") % 7 == 0, F.concat(F.lit("new"), "file_hash")).otherwise(F.col("file_hash")).alias("hash"), "size", (F.col("mtime") + F.when(F.col("id") % 14 == 0, 5).otherwise(0)).alias("mtime"))
    return merge.changes(a, b).filter("status <> 'same'")


@register("all_spans", "S7 J1 B1 F12", f"WITH {SPANS} SELECT s.id, f.path, s.symbol, s.kind, s.start_line, s.end_line, s.span_hash FROM spans s JOIN files f ON s.file_id = f.id")
def all_spans(spark, sf):
    f = files(spark, sf).select(F.col("id").alias("file_id"), "path")
    return spans(spark, sf).join(f, "file_id").select("id", "path", "symbol", "kind", "start_line", "end_line", "span_hash")


@register("spans_with_enrichment", "S8 S9 J2 B2", f"WITH {ENR} SELECT s.id, f.path, s.symbol, coalesce(e.summary, '') AS summary, coalesce(e.model, 'other') AS model FROM spans s JOIN files f ON s.file_id = f.id LEFT JOIN enrichments e ON s.span_hash = e.span_hash")
def spans_with_enrichment(spark, sf):
    f = files(spark, sf).select(F.col("id").alias("file_id"), "path")
    j = spans(spark, sf).join(f, "file_id").join(enrichments(spark, sf), "span_hash", "left")
    return j.select("id", "path", "symbol", F.coalesce("summary", F.lit("")).alias("summary"), F.coalesce("model", F.lit("other")).alias("model"))


@register("pending_antijoin", "J3", f"WITH {ENR} SELECT id, span_hash, start_line FROM spans WHERE span_hash NOT IN (SELECT span_hash FROM enrichments)")
def pending_antijoin(spark, sf):
    return spans(spark, sf).select("id", "span_hash", "start_line").join(enrichments(spark, sf).select("span_hash"), "span_hash", "left_anti")


@register("double_antijoin", "J4 R29", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1) AND NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = d.doc_id)")
def double_antijoin(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    d = d.join(table(spark, sf, "labels").filter("quality = 1").select("doc_id"), "doc_id", "left_anti")
    return d.join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti")


@register("orphan_rows", "J5 S18", "SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)")
def orphan_rows(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id").join(table(spark, sf, "labels").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_anti")


@register("files_with_enriched_span", "J6", f"WITH {ENR} SELECT id, path FROM files f WHERE EXISTS (SELECT 1 FROM spans s JOIN enrichments e ON s.span_hash = e.span_hash WHERE s.file_id = f.id)")
def files_with_enriched_span(spark, sf):
    s = spans(spark, sf).join(enrichments(spark, sf).select("span_hash"), "span_hash", "left_semi").select(F.col("file_id").alias("id"))
    return files(spark, sf).select("id", "path").join(s, "id", "left_semi")


@register("customers_without_orders", "J7", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def customers_without_orders(spark, sf):
    return table(spark, sf, "customer").select("c_custkey").join(table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@register("suffix_lookup", "J8 J27", f"""WITH {ENR} SELECT DISTINCT q.item, s.id FROM (SELECT item_id AS item, regexp_extract(lower(text), '([a-z]+)', 1) AS w FROM benchmark) q
 JOIN spans s ON lower(s.symbol) = q.w OR lower(s.symbol) LIKE '%.' || q.w WHERE q.w <> ''""")
def suffix_lookup(spark, sf):
    """The suffix condition as an equality on exploded candidate keys, so that it is a hash join."""
    from spanloom.functions.symbols import suffix_keys

    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("item"), F.regexp_extract(F.lower("text"), "([a-z]+)", 1).alias("w")).filter("w <> ''")
    s = spans(spark, sf).select("id", F.explode(suffix_keys(F.lower("symbol"))).alias("w"))
    return q.join(s, "w").select("item", "id").distinct()


@register("fallback_lookup", "J9 J10", f"""WITH {ENR}, byfile AS (SELECT file_id, start_line, min(e.summary) AS x FROM spans s JOIN enrichments e USING (span_hash) GROUP BY ALL), anyf AS (SELECT file_id, min(x) AS x FROM byfile GROUP BY ALL)
SELECT s.id, CASE WHEN e.summary IS NOT NULL THEN 'hash' WHEN b.x IS NOT NULL THEN 'line' WHEN a.x IS NOT NULL THEN 'path' END AS strategy, coalesce(e.summary, b.x, a.x) AS summary
FROM spans s LEFT JOIN enrichments e ON s.span_hash = e.span_hash AND s.pos % 2 = 0 LEFT JOIN byfile b ON b.file_id = s.file_id AND b.start_line = s.start_line LEFT JOIN anyf a ON a.file_id = s.file_id""")
def fallback_lookup(spark, sf):
    from spanloom.operators.lookup import cascade

    s, e = spans(spark, sf).select("id", "file_id", "pos", "start_line", "span_hash"), enrichments(spark, sf).select("span_hash", "summary")
    by_line = s.join(e, "span_hash").groupBy("file_id", "start_line").agg(F.min("summary").alias("summary"))
    by_path = by_line.groupBy("file_id").agg(F.min("summary").alias("summary"))
    s = s.withColumn("hash_key", F.when(F.col("pos") % 2 == 0, F.col("span_hash")))
    return cascade(s, [("hash", e.withColumnRenamed("span_hash", "hash_key"), ["hash_key"]), ("line", by_line, ["file_id", "start_line"]), ("path", by_path, ["file_id"])], "summary").select("id", "strategy", "summary")


@register("interval_overlap", "J11", f"""WITH {SPANS}, r AS (SELECT file_id, pos * 5 AS a, pos * 5 + 4 AS b, id AS rid FROM spans WHERE pos % 3 = 0)
SELECT rid, min(s.id) AS entity FROM r JOIN spans s ON r.file_id = s.file_id AND NOT (s.end_line < r.a OR s.start_line > r.b) GROUP BY rid""")
def interval_overlap(spark, sf):
    from spanloom.operators.ranges import overlap_join

    s = spans(spark, sf)
    r = s.filter("pos % 3 = 0").select("file_id", (F.col("pos") * 5).alias("a"), (F.col("pos") * 5 + 4).alias("b"), F.col("id").alias("rid"))
    e = s.select("file_id", "start_line", "end_line", "id")
    return overlap_join(r, e, "file_id", ("a", "b"), ("start_line", "end_line")).groupBy("rid").agg(F.min("id").alias("entity"))


@register("innermost_scope", "U27 J12", f"""WITH {FILES}, n AS (SELECT id AS file, len(string_split(text, chr(10))) AS n FROM files),
k AS (SELECT file, n, unnest(range(0, CAST(ceil(n / 8.0) AS BIGINT))) AS k FROM n),
sc AS (SELECT file, 'doc' || file AS name, 1 AS a, n AS b FROM n UNION ALL SELECT file, 'Part' || k, k * 8 + 2, least(n, k * 8 + 8) FROM k UNION ALL SELECT file, 'run' || k, k * 8 + 4, least(n, k * 8 + 6) FROM k),
l AS (SELECT file, unnest(range(1, n + 2)) AS line FROM n)
SELECT l.file, l.line, string_agg(name, '.' ORDER BY a, b DESC, name) AS scope, CAST(count(name) AS INTEGER) AS depth FROM l LEFT JOIN sc ON sc.file = l.file AND line BETWEEN a AND b GROUP BY l.file, l.line""")
def innermost_scope(spark, sf):
    """The chain of scopes of every line (and of the one behind the last) of all documents: a document, parts of seven lines, and three lines within each."""
    from spanloom.operators.ranges import scopes_at

    n = files(spark, sf).select(F.col("id").alias("file"), F.size(F.split("text", "\n")).alias("n"))
    k = n.select("file", "n", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / 8).cast("int") - 1)).alias("k"))
    part = lambda name, a, b: k.select("file", F.concat(F.lit(name), "k").alias("name"), (F.col("k") * 8 + a).alias("start"), F.least("n", F.col("k") * 8 + b).alias("end"))
    scopes = n.select("file", F.concat(F.lit("doc"), "file").alias("name"), F.lit(1).alias("start"), F.col("n").alias("end")).unionByName(part("Part", 2, 8)).unionByName(part("run", 4, 6))
    return scopes_at(scopes, n.select("file", F.explode(F.sequence(F.lit(1), F.col("n") + 1)).alias("line")))


@register("point_in_interval", "J12", f"WITH {SPANS} SELECT f.id AS file, s.id AS span FROM files f JOIN spans s ON s.file_id = f.id AND (f.size % 30) + 1 BETWEEN s.start_line AND s.end_line")
def point_in_interval(spark, sf):
    from spanloom.operators.ranges import overlap_join

    f = files(spark, sf).select(F.col("id").alias("file_id"), (F.col("size") % 30 + 1).alias("at"))
    return overlap_join(f, spans(spark, sf).select("file_id", "start_line", "end_line", "id"), "file_id", ("at", "at"), ("start_line", "end_line")).select(F.col("file_id").alias("file"), F.col("id").alias("span"))


@register("location_join", "J13", f"WITH {ENR}, e AS (SELECT path, start_line, max(summary) AS summary FROM spans s JOIN files f ON s.file_id = f.id JOIN enrichments USING (span_hash) GROUP BY ALL) SELECT s.id, e.summary FROM spans s JOIN files f ON s.file_id = f.id JOIN e ON e.path = f.path AND e.start_line = s.start_line")
def location_join(spark, sf):
    f = files(spark, sf).select(F.col("id").alias("file_id"), "path")
    s = spans(spark, sf).join(f, "file_id")
    e = s.join(enrichments(spark, sf), "span_hash").groupBy("path", "start_line").agg(F.max("summary").alias("summary"))
    return s.join(e, ["path", "start_line"]).select("id", "summary")


@register("staleness", "C15", f"""WITH {FILES}, a AS (SELECT count(*) AS n, max(mtime) AS m FROM files), b AS (SELECT count(*) AS n, max(CAST(doc_id % 100000 AS DOUBLE)) AS m FROM labels)
SELECT CASE WHEN a.m > b.m THEN 'mtime' WHEN a.n <> b.n THEN 'count' ELSE 'fresh' END AS reason, CASE WHEN a.m > b.m OR a.n <> b.n THEN 'STALE' ELSE 'FRESH' END AS state FROM a, b""")
def staleness(spark, sf):
    a = files(spark, sf).agg(F.count("*").alias("n"), F.max("mtime").alias("m"))
    b = table(spark, sf, "labels").agg(F.count("*").alias("n2"), F.max((F.col("doc_id") % 100000).cast("double")).alias("m2"))
    reason = F.when(F.col("m") > F.col("m2"), "mtime").when(F.col("n") != F.col("n2"), "count").otherwise("fresh")
    return a.crossJoin(b).select(reason.alias("reason"), F.when(reason == "fresh", "FRESH").otherwise("STALE").alias("state"))  # one row each


@register("short_symbol_join", "J15 F28 G18", f"""WITH {ENR}, k AS (SELECT f.path, symbol, max(summary) AS x FROM spans s JOIN files f ON f.id = s.file_id JOIN enrichments USING (span_hash) GROUP BY ALL),
k2 AS (SELECT path, string_split(symbol, '.')[-1] AS leaf, max(x) AS x FROM k GROUP BY ALL) SELECT s.id, coalesce(k.x, k2.x) AS summary FROM spans s JOIN files f ON f.id = s.file_id
LEFT JOIN k ON k.path = f.path AND k.symbol = s.symbol LEFT JOIN k2 ON k2.path = f.path AND k2.leaf = string_split(s.symbol, '.')[-1]""")
def short_symbol_join(spark, sf):
    leaf = F.element_at(F.split("symbol", r"\."), -1)
    s = spans(spark, sf).join(files(spark, sf).select(F.col("id").alias("file_id"), "path"), "file_id").withColumn("leaf", leaf)
    k = s.join(enrichments(spark, sf), "span_hash").groupBy("path", "symbol").agg(F.max("summary").alias("x1"))
    k2 = k.withColumn("leaf", leaf).groupBy("path", "leaf").agg(F.max("x1").alias("x2"))
    return s.join(k, ["path", "symbol"], "left").join(k2, ["path", "leaf"], "left").select("id", F.coalesce("x1", "x2").alias("summary"))


@register("degree_counts", "J22 A29", f"WITH {NODES}, " + """e AS (SELECT * FROM edges) SELECT n.id, (SELECT count(*) FROM e WHERE e.dst = n.id) AS n_in, (SELECT count(*) FROM e WHERE e.src = n.id) AS n_out FROM nodes n""".replace("edges", "(SELECT 's:' || s_suppkey AS src, 'n:' || s_nationkey AS dst FROM supplier UNION ALL SELECT 'n:' || n_nationkey, 'r:' || n_regionkey FROM nation)"))
def degree_counts(spark, sf):
    e = edges(spark, sf).filter("type IN ('IMPORTS', 'EXTENDS')")
    i, o = e.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("i")), e.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("o"))
    return nodes(spark, sf).select("id").join(i, "id", "left").join(o, "id", "left").select("id", F.coalesce("i", F.lit(0)).alias("n_in"), F.coalesce("o", F.lit(0)).alias("n_out"))


@register("model_pairs", "J23", """WITH a AS (SELECT doc_id % 1000 AS k, min(text) AS x, max(length(text)) AS n FROM documents WHERE doc_id % 2 = 0 GROUP BY 1), b AS (SELECT doc_id % 1000 AS k, min(text) AS x, max(length(text)) AS n FROM documents WHERE doc_id % 2 = 1 OR doc_id % 3 = 0 GROUP BY 1)
SELECT a.k, a.n AS n_a, b.n AS n_b, a.n - b.n AS diff FROM a JOIN b ON a.k = b.k""")
def model_pairs(spark, sf):
    d = table(spark, sf, "documents").withColumn("k", F.col("doc_id") % 1000)
    a = d.filter("doc_id % 2 = 0").groupBy("k").agg(F.max(F.length("text")).cast("long").alias("n_a"))
    b = d.filter("doc_id % 2 = 1 OR doc_id % 3 = 0").groupBy("k").agg(F.max(F.length("text")).cast("long").alias("n_b"))
    return a.join(b, "k").select("k", "n_a", "n_b", (F.col("n_a") - F.col("n_b")).alias("diff"))


@register("route_dimension", "J24 C10 C11", f"""WITH {FILES}, cfg(lang, profile, idx) AS (VALUES ('en', 'code', 'emb_code'), ('fr', 'docs', 'embeddings')), fan(profile, route, weight) AS (VALUES ('code', 'code', 1.0), ('code', 'docs', 0.5), ('docs', 'docs', 1.0), ('default', 'docs', 1.0))
SELECT f.id, fan.route, coalesce(cfg.idx, 'embeddings') AS idx, CAST(fan.weight AS DOUBLE) AS weight FROM files f LEFT JOIN cfg USING (lang) JOIN fan ON fan.profile = coalesce(cfg.profile, 'default')""")
def route_dimension(spark, sf):
    cfg = spark.createDataFrame([("en", "code", "emb_code"), ("fr", "docs", "embeddings")], "lang string, profile string, idx string")
    fan = spark.createDataFrame([("code", "code", 1.0), ("code", "docs", 0.5), ("docs", "docs", 1.0), ("default", "docs", 1.0)], "profile string, route string, weight double")
    f = files(spark, sf).select("id", "lang").join(F.broadcast(cfg), "lang", "left").withColumn("profile", F.coalesce("profile", F.lit("default"))).withColumn("idx", F.coalesce("idx", F.lit("embeddings")))
    return f.join(F.broadcast(fan), "profile").select("id", "route", "idx", "weight")  # both sides are literal configuration


@register("path_weights", "J25 F31 P2", f"""WITH {FILES}, g(re, w) AS (VALUES ('^src1.*$', 8), ('^.*\\.py$', 6), ('^src[0-9]/en/.*$', 9), ('^.*\\.json$', 2)), w AS (SELECT id, coalesce(max(w), 5) AS weight FROM files LEFT JOIN g ON regexp_matches(path, re) GROUP BY id)
SELECT id, CAST(weight AS INTEGER) AS weight, round(5 * (11 - weight) / 10.0, 6) AS priority, CASE WHEN weight <= 3 THEN 'high' WHEN weight <= 6 THEN 'mid' ELSE 'low' END AS bucket FROM w""")
def path_weights(spark, sf):
    from spanloom.functions.paths import best_weight

    w = best_weight(F.col("path"), {"src1*": 8, "*.py": 6, "src[0-9]/en/*": 9, "*.json": 2}, 5)
    f = files(spark, sf).select("id", w.alias("weight"))
    return f.select("id", "weight", F.round(F.lit(5) * (11 - F.col("weight")) / 10.0, 6).alias("priority"), F.when(F.col("weight") <= 3, "high").when(F.col("weight") <= 6, "mid").otherwise("low").alias("bucket"))


@register("domain_override", "J26 H12", f"WITH {FILES} SELECT id, CASE WHEN path LIKE 'src1%' THEN 'medical' WHEN path LIKE '%.md' THEN 'docs' WHEN path LIKE '%/en/%' THEN 'code' ELSE 'mixed' END AS domain FROM files")
def domain_override(spark, sf):
    from spanloom.functions.paths import first_glob

    return files(spark, sf).select("id", first_glob(F.col("path"), [("src1*", "medical"), ("*.md", "docs"), ("*/en/*", "code")], "mixed").alias("domain"))


@register("manifest_by_directory", "J28 A30 B14", f"WITH {FILES} SELECT array_to_string(list_slice(string_split(path, '/'), 1, 2), '/') AS dir, count(*) AS n, min(path) AS first_path, CAST(sum(size) AS BIGINT) AS size FROM files WHERE lang IN ('en', 'de') AND NOT contains(path, 'src19') GROUP BY 1")
def manifest_by_directory(spark, sf):
    f = files(spark, sf).filter(F.col("lang").isin("en", "de") & ~F.col("path").contains("src19"))
    d = F.array_join(F.slice(F.split("path", "/"), 1, 2), "/")
    return f.groupBy(d.alias("dir")).agg(F.count("*").alias("n"), F.min("path").alias("first_path"), F.sum("size").alias("size"))


@register("summary_per_file", "J29 F24 F22", f"""WITH {ENR}, r AS (SELECT f.path, e.summary, row_number() OVER (PARTITION BY f.path ORDER BY s.pos) AS n FROM files f JOIN spans s ON s.file_id = f.id JOIN enrichments e USING (span_hash))
SELECT path, CASE WHEN length(c) > 100 THEN substr(c, 1, 99) || '…' ELSE c END AS summary FROM (SELECT path, split_part(summary, '. ', 1) AS c FROM r WHERE n = 1)""")
def summary_per_file(spark, sf):
    from spanloom.functions.text import ellipsis

    f = files(spark, sf).select(F.col("id").alias("file_id"), "path")
    r = spans(spark, sf).join(f, "file_id").join(enrichments(spark, sf), "span_hash")
    first = merge.last_by(r, ["path"], F.col("pos"))
    return first.select("path", ellipsis(F.substring_index("summary", ". ", 1), 100).alias("summary"))


@register("upsert_latest", "M1 M5 W5", f"WITH {TELE} SELECT id, agent, cmd, latency_ms FROM (SELECT *, row_number() OVER (PARTITION BY agent ORDER BY ts DESC, id DESC) AS n FROM tele) WHERE n = 1")
def upsert_latest(spark, sf):
    return merge.last_by(telemetry(spark, sf).select("id", "agent", "cmd", "latency_ms", "ts"), ["agent"], F.desc("ts"), F.desc("id")).drop("ts")


@register("upsert_merge", "M3 M4", f"WITH {FILES} SELECT path, CASE WHEN id % 5 = 0 THEN upper(file_hash) ELSE file_hash END AS hash FROM files WHERE id % 3 <> 0 OR id % 5 = 0")
def upsert_merge(spark, sf):
    f = files(spark, sf)
    return merge.upsert(f.filter("id % 3 <> 0").select("path", F.col("file_hash").alias("hash")), f.filter("id % 5 = 0").select("path", F.upper("file_hash").alias("hash")), ["path"])


@register("span_diff", "M2 E1 S27", f"""WITH {SPANS}, o AS (SELECT DISTINCT file_id, span_hash FROM spans WHERE pos % 3 <> 2), n AS (SELECT DISTINCT file_id, span_hash FROM spans WHERE pos % 3 <> 1 AND file_id % 4 <> 0)
SELECT file_id, span_hash, CASE WHEN o IS NOT NULL AND n IS NOT NULL THEN 'keep' WHEN n IS NOT NULL THEN 'insert' WHEN file_id IN (SELECT file_id FROM n) THEN 'delete' ELSE 'keep' END AS action
FROM (SELECT coalesce(o.file_id, n.file_id) AS file_id, coalesce(o.span_hash, n.span_hash) AS span_hash, o.file_id AS o, n.file_id AS n FROM o FULL JOIN n ON o.file_id = n.file_id AND o.span_hash = n.span_hash)""")
def span_diff(spark, sf):
    s = spans(spark, sf).select("file_id", "pos", "span_hash")
    return merge.replace_groups(s.filter("pos % 3 <> 2"), s.filter("pos % 3 <> 1 AND file_id % 4 <> 0"), "file_id", "span_hash")


@register("delete_cascade", "M6 M7", f"WITH {SPANS} SELECT id, file_id FROM spans WHERE file_id IN (SELECT id FROM files WHERE path NOT IN (SELECT path FROM files WHERE id % 6 = 1))")
def delete_cascade(spark, sf):
    f = files(spark, sf).select("id", "path")
    _, (kept,) = merge.delete_cascade(f, f.filter("id % 6 = 1").select("path"), "path", [(spans(spark, sf).select(F.col("id").alias("span"), "file_id"), "file_id")], parent_id="id")
    return kept.select(F.col("span").alias("id"), "file_id")


@register("stub_nodes", "S11 S10 M9", f"WITH {NODES}, e AS (SELECT 'p:' || l_partkey AS src, 's:' || l_suppkey AS dst FROM lineitem UNION SELECT 'c:' || o_custkey, 'x:' || o_orderstatus FROM orders), i AS (SELECT src AS id FROM e UNION SELECT dst FROM e) SELECT id, coalesce(kind, 'stub') AS kind, coalesce(path, '<external>') AS path FROM (SELECT id, kind, path FROM nodes UNION ALL SELECT id, NULL, NULL FROM i WHERE id NOT IN (SELECT id FROM nodes))")
def stub_nodes(spark, sf):
    from spanloom.operators.graph import with_stubs

    e = table(spark, sf, "lineitem").select(F.concat(F.lit("p:"), "l_partkey").alias("src"), F.concat(F.lit("s:"), "l_suppkey").alias("dst"))
    e = e.unionByName(table(spark, sf, "orders").select(F.concat(F.lit("c:"), "o_custkey").alias("src"), F.concat(F.lit("x:"), "o_orderstatus").alias("dst")))
    return with_stubs(nodes(spark, sf), e).select("id", "kind", "path")


@register("adjacency_reverse", "S13 G4 E2", "SELECT 's:' || s_suppkey AS src, 'n:' || s_nationkey AS dst, 'imports' AS edge FROM supplier UNION SELECT 'n:' || s_nationkey, 's:' || s_suppkey, 'imported_by' FROM supplier")
def adjacency_reverse(spark, sf):
    from spanloom.operators.graph import both_ways

    return both_ways(edges(spark, sf).filter("type = 'IMPORTS'").select("src", "dst", F.lower("type").alias("edge")), {"imports": "imported_by"})


@register("failure_counts", "M12 A23", f"WITH {QUEUE} SELECT span, repo, count(*) AS failure_count, max(created) AS last_failed FROM queue WHERE NOT ok GROUP BY span, repo")
def failure_counts(spark, sf):
    return queue(spark, sf).filter("NOT ok").groupBy("span", "repo").agg(F.count("*").alias("failure_count"), F.max("created").cast("timestamp_ntz").alias("last_failed"))


@register("insert_ignore_edges", "M13 A22", """WITH o AS (SELECT DISTINCT o_custkey AS s, o_orderstatus AS t FROM orders WHERE o_orderkey % 2 = 0), n AS (SELECT DISTINCT o_custkey AS s, o_orderstatus AS t FROM orders), u AS (SELECT s, t, 'old' AS origin FROM o UNION ALL SELECT s, t, 'new' FROM n WHERE (s, t) NOT IN (SELECT s, t FROM o))
SELECT t, origin, count(*) AS n, CAST(sum(CASE WHEN s % 2 = 0 THEN 0.8 ELSE 0.4 END) AS DOUBLE) AS confidence FROM u GROUP BY t, origin""")
def insert_ignore_edges(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("s"), F.col("o_orderstatus").alias("t"), "o_orderkey")
    old = o.filter("o_orderkey % 2 = 0").select("s", "t").distinct().withColumn("origin", F.lit("old"))
    u = merge.insert_or_ignore(old, o.select("s", "t").withColumn("origin", F.lit("new")), ["s", "t"])
    return u.groupBy("t", "origin").agg(F.count("*").alias("n"), F.sum(F.when(F.col("s") % 2 == 0, F.lit(0.8)).otherwise(0.4)).alias("confidence"))


@register("placeholder_delete", "M15", "SELECT doc_id FROM documents WHERE NOT (lower(text) LIKE '%license%' OR text LIKE 'The %')")
def placeholder_delete(spark, sf):
    return table(spark, sf, "documents").filter(~(F.col("text").ilike("%license%") | F.col("text").like("The %"))).select("doc_id")


@register("graph_patch", "M14 G19", """WITH n AS (SELECT 'n:' || n_nationkey AS id, n_name AS name, CAST(n_regionkey AS VARCHAR) AS region FROM nation), p AS (SELECT 'n:' || n_nationkey AS id, upper(n_name) || 'x' AS name FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT 'new:' || r_regionkey, r_name FROM region)
SELECT coalesce(n.id, p.id) AS id, coalesce(p.name, n.name) AS name, n.region FROM n FULL JOIN p ON n.id = p.id""")
def graph_patch(spark, sf):
    n = table(spark, sf, "nation")
    ident = F.concat(F.lit("n:"), "n_nationkey")
    old = n.select(ident.alias("id"), F.create_map(F.lit("name"), "n_name", F.lit("region"), F.col("n_regionkey").cast("string")).alias("meta"))
    new = n.filter("n_nationkey % 2 = 0").select(ident.alias("id"), F.create_map(F.lit("name"), F.concat(F.upper("n_name"), F.lit("x"))).alias("meta"))
    new = new.unionByName(table(spark, sf, "region").select(F.concat(F.lit("new:"), "r_regionkey").alias("id"), F.create_map(F.lit("name"), "r_name").alias("meta")))
    none = spark.createDataFrame([], "src string, dst string")
    out, _, _ = merge.patch_graph(old, none, new, none)
    return out.select("id", F.col("meta")["name"].alias("name"), F.col("meta")["region"].alias("region"))


@register("export_chunks", "B3", f"WITH {SPANS} SELECT span_hash, path, symbol, CAST(row_number() OVER (PARTITION BY path ORDER BY start_line, s.id) AS INTEGER) AS n FROM spans s JOIN files f ON f.id = s.file_id")
def export_chunks(spark, sf):
    s = spans(spark, sf).join(files(spark, sf).select(F.col("id").alias("file_id"), "path"), "file_id")
    return s.select("span_hash", "path", "symbol", F.row_number().over(W.partitionBy("path").orderBy("start_line", "id")).alias("n"))


@register("grep_lines", "S22 F38 O4 R23", f"WITH {SPANS} SELECT s.id, f.path, pos + 1 AS line_no, CASE WHEN regexp_matches(s.text, '^(The|Die|Les|El) ') THEN 0 ELSE 1 END AS rank_class FROM spans s JOIN files f ON f.id = s.file_id WHERE regexp_matches(s.text, '(^|[^a-z])(license|License)')")
def grep_lines(spark, sf):
    from spanloom.sources.grep import grep

    g = grep(files(spark, sf).select("id", "path", "text"), r"(^|[^a-z])(license|License)", "text")
    return g.select((F.col("id") * 100000 + F.col("line_no") - 1).alias("id"), "path", "line_no", F.when(F.col("line").rlike("^(The|Die|Les|El) "), 0).otherwise(1).alias("rank_class"))


@register("grep_context", "S23 S24 S26", f"WITH {SPANS}, h AS (SELECT file_id, pos FROM spans WHERE contains(text, 'License')) SELECT h.file_id, CAST(h.pos AS INTEGER) AS hit, string_agg(s.text, chr(10) ORDER BY s.pos) AS snippet FROM h JOIN spans s ON s.file_id = h.file_id AND s.pos BETWEEN h.pos - 2 AND h.pos + 2 GROUP BY ALL")
def grep_context(spark, sf):
    from spanloom.sources.grep import grep, snippet

    g = grep(files(spark, sf).select("id", "text"), "License", "text", keep=True)
    return g.select(F.col("id").alias("file_id"), (F.col("line_no") - 1).alias("hit"), snippet(F.col("text"), F.col("line_no"), F.col("line_no"), 2).alias("snippet"))


@register("dirty_set", "E3 E5", "SELECT DISTINCT doc_id FROM documents WHERE source = 'src1' UNION SELECT doc_id FROM labels WHERE toxic = 1")
def dirty_set(spark, sf):
    return table(spark, sf, "documents").filter("source = 'src1'").select("doc_id").union(table(spark, sf, "labels").filter("toxic = 1").select("doc_id")).distinct()


@register("entity_dedup", "E6 W5", f"WITH {SPANS} SELECT symbol, kind, id FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY file_id, pos) AS n FROM spans) WHERE n = 1")
def entity_dedup(spark, sf):
    return merge.last_by(spans(spark, sf).select("symbol", "kind", "id", "file_id", "pos"), ["symbol"], F.col("file_id"), F.col("pos")).select("symbol", "kind", "id")


@register("point_lookups", "B5 B7 B8 B13 B19 B15", f"WITH {NODES} SELECT id, name FROM nodes WHERE kind IN ('class', 'module') AND id NOT IN ('n:1', 'n:2') AND path IS NOT NULL AND path <> '' AND contains(path, 'f') AND NOT starts_with(path, 'part/')")
def point_lookups(spark, sf):
    n = nodes(spark, sf)
    return n.filter(F.col("kind").isin("class", "module") & ~F.col("id").isin("n:1", "n:2") & F.col("path").isNotNull() & (F.col("path") != "") & F.col("path").contains("f") & ~F.col("path").startswith("part/")).select("id", "name")


@register("threshold_filters", "B9 B10 B12 B17 B20 B22", f"WITH {TELE} SELECT mode, count(*) FILTER (WHERE latency_ms >= 0.3) AS kept, count(*) FILTER (WHERE latency_ms < 0.3) AS dropped, count(*) FILTER (WHERE mode <> 'raw' AND k >= 3) AS exhausted FROM tele GROUP BY mode")
def threshold_filters(spark, sf):
    t = telemetry(spark, sf)
    return t.groupBy("mode").agg(F.count_if(F.col("latency_ms") >= 0.3).alias("kept"), F.count_if(F.col("latency_ms") < 0.3).alias("dropped"), F.count_if((F.col("mode") != "raw") & (F.col("k") >= 3)).alias("exhausted"))


@register("schedule_window", "B23 T-12", f"WITH {TELE} SELECT id, (hour(ts) * 60 + minute(ts) >= 1320 OR hour(ts) * 60 + minute(ts) < 360) AS active FROM tele")
def schedule_window(spark, sf):
    from spanloom.functions.times import within_schedule

    return telemetry(spark, sf).select("id", within_schedule(F.col("ts"), 22 * 60, 6 * 60).alias("active"))


@register("json_rows", "B24 F20 F21 U25", f"WITH {TELE}, x AS (SELECT id, CASE WHEN id % 5 = 0 THEN substr(props, 2) ELSE props END AS p FROM tele) SELECT json_valid(p) AS fine, count(*) AS n FROM x GROUP BY 1")
def json_rows(spark, sf):
    t = telemetry(spark, sf).select("id", F.when(F.col("id") % 5 == 0, F.substring("props", 2, 10**6)).otherwise(F.col("props")).alias("p"))
    return t.groupBy(F.from_json("p", "map<string,string>").isNotNull().alias("fine")).agg(F.count("*").alias("n"))
