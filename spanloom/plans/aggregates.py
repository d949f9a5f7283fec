"""Aggregates over telemetry, queue, files and enrichments."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.functions.times import since
from spanloom.plans.base import AS_OF, EDGES, ENR, FILES, NODES, QUEUE, SPANS, TELE, edges, enrichments, files, nodes, queue, spans, telemetry
from spanloom.plans.catalog import register
from spanloom.runtime import table


@register("table_counts", "A1", "SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'labels', count(*) FROM labels UNION ALL SELECT 'embeddings', count(*) FROM embeddings UNION ALL SELECT 'events', count(*) FROM events")
def table_counts(spark, sf):
    out = None
    for t in ("documents", "labels", "embeddings", "events"):
        x = table(spark, sf, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n")
        out = x if out is None else out.unionByName(x)
    return out


@register("pending_stats", "A2", "SELECT count(*) AS n, min(doc_id) AS lo, max(doc_id) AS hi FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pending_stats(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left_anti").agg(F.count("*").alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))


@register("top_pending_files", "A3", f"WITH {ENR} SELECT path, count(*) AS n FROM spans s JOIN files f ON f.id = s.file_id WHERE span_hash NOT IN (SELECT span_hash FROM enrichments) GROUP BY path ORDER BY n DESC, path LIMIT 5")
def top_pending_files(spark, sf):
    s = spans(spark, sf).join(enrichments(spark, sf).select("span_hash"), "span_hash", "left_anti")
    return s.join(files(spark, sf).select(F.col("id").alias("file_id"), "path"), "file_id").groupBy("path").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "path").limit(5)


@register("health_rollup", "A4", f"""WITH {ENR}, c AS (SELECT (SELECT count(*) FROM files) AS n_files, (SELECT count(*) FROM spans) AS n_spans, (SELECT count(*) FROM enrichments) AS n_enr)
SELECT n_files, n_spans, n_enr, CASE WHEN n_files = 0 THEN 'EMPTY' WHEN n_enr < n_spans THEN 'WARN' ELSE 'OK' END AS status, round(100.0 * n_enr / n_spans, 1) AS coverage FROM c""")
def health_rollup(spark, sf):
    c = files(spark, sf).agg(F.count("*").alias("n_files")).crossJoin(spans(spark, sf).agg(F.count("*").alias("n_spans"))).crossJoin(enrichments(spark, sf).agg(F.count("*").alias("n_enr")))
    status = F.when(F.col("n_files") == 0, "EMPTY").when(F.col("n_enr") < F.col("n_spans"), "WARN").otherwise("OK")
    return c.select("*", status.alias("status"), F.round(100.0 * F.col("n_enr") / F.col("n_spans"), 1).alias("coverage"))  # one row each


@register("queue_stats", "A5", f"WITH {QUEUE} SELECT count(*) FILTER (WHERE claimed_by IS NULL AND ok) AS pending, count(*) FILTER (WHERE claimed_by IS NOT NULL) AS claimed, count(*) FILTER (WHERE NOT ok) AS failed, count(*) AS total FROM queue")
def queue_stats(spark, sf):
    return queue(spark, sf).agg(F.count_if(F.col("claimed_by").isNull() & F.col("ok")).alias("pending"), F.count_if(F.col("claimed_by").isNotNull()).alias("claimed"), F.count_if(~F.col("ok")).alias("failed"), F.count("*").alias("total"))


@register("queue_by_repo_tier", "A6", f"WITH {QUEUE} SELECT repo, tier, count(*) AS n FROM queue GROUP BY repo, tier")
def queue_by_repo_tier(spark, sf):
    return queue(spark, sf).groupBy("repo", "tier").agg(F.count("*").alias("n"))


@register("top_queries_7d", "A7 B16", f"WITH {TELE} SELECT k, count(*) AS n FROM tele WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AND ts < TIMESTAMP '{AS_OF}' GROUP BY k ORDER BY n DESC, k LIMIT 10")
def top_queries_7d(spark, sf):
    return telemetry(spark, sf).filter(since(F.col("ts"), AS_OF, "7 days")).groupBy("k").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "k").limit(10)


@register("top_files_unnest", "A8", f"WITH {FILES}, a AS (SELECT unnest(CAST(json('[\"' || replace(path, '/', '\",\"') || '\"]') AS VARCHAR[])) AS part FROM files) SELECT part, count(*) AS n FROM a GROUP BY part ORDER BY n DESC, part LIMIT 20")
def top_files_unnest(spark, sf):
    js = F.concat(F.lit('["'), F.replace(F.col("path"), F.lit("/"), F.lit('","')), F.lit('"]'))
    a = files(spark, sf).select(F.explode(F.coalesce(F.from_json(js, "array<string>"), F.array().cast("array<string>"))).alias("part"))
    return a.groupBy("part").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "part").limit(20)


@register("usage_distinct", "A9 A10", f"WITH {TELE} SELECT count(*) AS n, count(DISTINCT agent) AS agents, round(avg(latency_ms), 1) AS avg_ms, CAST(sum(size) AS BIGINT) AS size FROM tele")
def usage_distinct(spark, sf):
    return telemetry(spark, sf).agg(F.count("*").alias("n"), F.count_distinct("agent").alias("agents"), F.round(F.avg("latency_ms"), 1).alias("avg_ms"), F.sum("size").alias("size"))


@register("conditional_sums", "A11 A21", f"WITH {TELE} SELECT cmd, CAST(sum(CASE WHEN ok THEN 1 ELSE 0 END) AS BIGINT) AS n_ok, CAST(sum(CASE WHEN ts >= TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY AND ts < TIMESTAMP '{AS_OF}' THEN 1 ELSE 0 END) AS BIGINT) AS recent, round(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END), 6) AS share FROM tele GROUP BY cmd")
def conditional_sums(spark, sf):
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return telemetry(spark, sf).groupBy("cmd").agg(one(F.col("ok")).alias("n_ok"), one(since(F.col("ts"), AS_OF, "1 day")).alias("recent"), F.round(F.avg(F.when(F.col("ok"), 1.0).otherwise(0.0)), 6).alias("share"))


@register("top_commands", "A12", f"WITH {TELE} SELECT mode, cmd, count(*) AS n, round(avg(latency_ms), 4) AS avg_ms, round(avg(size), 4) AS avg_size FROM tele GROUP BY mode, cmd")
def top_commands(spark, sf):
    return telemetry(spark, sf).groupBy("mode", "cmd").agg(F.count("*").alias("n"), F.round(F.avg("latency_ms"), 4).alias("avg_ms"), F.round(F.avg("size"), 4).alias("avg_size"))


@register("routing_payloads", "A13", f"WITH {TELE} SELECT cmd AS route, k % 3 AS tier, count(*) AS n FROM tele GROUP BY ALL")
def routing_payloads(spark, sf):
    t = telemetry(spark, sf).select(F.concat(F.lit("route="), "cmd", F.lit(", tier="), F.col("k") % 3).alias("p"))
    m = t.select(F.str_to_map("p", F.lit(", "), F.lit("=")).alias("m"))
    return m.groupBy(F.col("m")["route"].alias("route"), F.col("m")["tier"].cast("long").alias("tier")).agg(F.count("*").alias("n"))


@register("tool_usage", "A14 A15", f"WITH {TELE} SELECT cmd AS tool, count(*) AS calls, count(*) FILTER (WHERE NOT ok) AS errors, round(avg(latency_ms), 4) AS avg_ms, min(latency_ms) AS min_ms, max(latency_ms) AS max_ms, round(count(*) FILTER (WHERE NOT ok) / greatest(1, count(*)), 6) AS error_rate, CAST(sum(k) AS BIGINT) AS tokens FROM tele GROUP BY cmd")
def tool_usage(spark, sf):
    e = F.count_if(~F.col("ok"))
    return telemetry(spark, sf).groupBy(F.col("cmd").alias("tool")).agg(F.count("*").alias("calls"), e.alias("errors"), F.round(F.avg("latency_ms"), 4).alias("avg_ms"), F.min("latency_ms").alias("min_ms"), F.max("latency_ms").alias("max_ms"), F.round(e / F.greatest(F.lit(1), F.count("*")), 6).alias("error_rate"), F.sum("k").alias("tokens"))


@register("exclusive_quantiles", "A17 A18", f"""WITH {TELE}, r AS (SELECT cmd, latency_ms AS v, row_number() OVER (PARTITION BY cmd ORDER BY latency_ms) AS i, count(*) OVER (PARTITION BY cmd) AS n FROM tele WHERE latency_ms IS NOT NULL),
q(p) AS (VALUES (0.25), (0.5), (0.75)), x AS (SELECT DISTINCT cmd, n, CAST(p AS DOUBLE) AS p, greatest(1, least(n - 1, CAST(floor(CAST(p AS DOUBLE) * (n + 1)) AS BIGINT))) AS j FROM r, q WHERE n >= 4)
SELECT x.cmd, x.p, round(a.v + (x.p * (x.n + 1) - x.j) * (b.v - a.v), 6) AS value, round(x.n * 1.0 / (SELECT count(*) FROM tele), 6) AS share FROM x JOIN r a ON a.cmd = x.cmd AND a.i = x.j JOIN r b ON b.cmd = x.cmd AND b.i = x.j + 1""")
def exclusive_quantiles(spark, sf):
    from spanloom.operators.stats import quantiles_exclusive

    t = telemetry(spark, sf)
    share = t.groupBy("cmd").agg(F.count("*").alias("c")).withColumn("share", F.round(F.col("c") / F.sum("c").over(W.partitionBy()), 6)).select("cmd", "share")  # a row per command
    return quantiles_exclusive(t.select("cmd", F.col("latency_ms").alias("v")), "cmd", "v", [0.25, 0.5, 0.75]).join(share, "cmd").select("cmd", "p", F.round("value", 6).alias("value"), "share")


@register("coarse_quality", "A20", "SELECT CAST(sum(CASE WHEN length(trim(text)) = 0 THEN 1 ELSE 0 END) AS BIGINT) AS empty, CAST(sum(CASE WHEN lower(text) LIKE '%placeholder%' OR lower(text) LIKE '%todo%' THEN 1 ELSE 0 END) AS BIGINT) AS placeholder, CAST(sum(CASE WHEN length(text) < 20 THEN 1 ELSE 0 END) AS BIGINT) AS short FROM documents")
def coarse_quality(spark, sf):
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    x = F.col("text")
    return table(spark, sf, "documents").agg(one(F.length(F.trim("text")) == 0).alias("empty"), one(x.ilike("%placeholder%") | x.ilike("%todo%")).alias("placeholder"), one(F.length("text") < 20).alias("short"))


@register("lang_distribution", "A24", "SELECT lang, count(*) AS n, count(DISTINCT source) AS sources FROM documents GROUP BY lang")
def lang_distribution(spark, sf):
    return table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources"))


@register("kind_histogram", "A25 A34 A42 G22", f"WITH {NODES}, {EDGES} SELECT 'kind' AS what, kind AS name, count(*) AS n FROM nodes GROUP BY kind UNION ALL SELECT 'edge', type, count(*) FROM edges GROUP BY type")
def kind_histogram(spark, sf):
    a = nodes(spark, sf).groupBy(F.col("kind").alias("name")).agg(F.count("*").alias("n")).withColumn("what", F.lit("kind"))
    b = edges(spark, sf).groupBy(F.col("type").alias("name")).agg(F.count("*").alias("n")).withColumn("what", F.lit("edge"))
    return a.unionByName(b).select("what", "name", "n")


@register("top_referenced", "A25", f"WITH {EDGES}, x AS (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) SELECT id, count(*) AS n FROM x GROUP BY id ORDER BY n DESC, id LIMIT 5")
def top_referenced(spark, sf):
    e = edges(spark, sf)
    return e.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "id").limit(5)


@register("architecture_signals", "A26", f"""WITH {NODES}, {EDGES}, t AS (SELECT id, path FROM nodes), u AS (SELECT path, count(*) AS n FROM (SELECT DISTINCT src, dst, type, t.id, path FROM edges JOIN t ON t.id = src UNION SELECT DISTINCT src, dst, type, t.id, path FROM edges JOIN t ON t.id = dst) GROUP BY path),
f AS (SELECT DISTINCT path FROM nodes), c AS (SELECT count(*) FILTER (WHERE type = 'EXTENDS') AS x, count(*) FILTER (WHERE type = 'CALLS') AS k FROM edges)
SELECT round(avg(coalesce(n, 0)), 1) AS avg_connectivity, max(coalesce(n, 0)) AS max_connectivity, (SELECT CASE WHEN k = 0 THEN NULL WHEN x / k > 0.1 THEN 'inheritance' WHEN x / k > 0.01 THEN 'mixed' ELSE 'composition' END FROM c) AS style FROM f LEFT JOIN u USING (path)""")
def architecture_signals(spark, sf):
    n, e = nodes(spark, sf).select("id", "path"), edges(spark, sf)
    ends = e.select("src", "dst", "type", F.explode(F.array_distinct(F.array("src", "dst"))).alias("id"))
    per = ends.join(n, "id").groupBy("path").agg(F.count("*").alias("n"))
    f = n.select("path").distinct().join(per, "path", "left").agg(F.round(F.avg(F.coalesce("n", F.lit(0))), 1).alias("avg_connectivity"), F.max(F.coalesce("n", F.lit(0))).alias("max_connectivity"))
    c = e.agg(F.count_if(F.col("type") == "EXTENDS").alias("x"), F.count_if(F.col("type") == "CALLS").alias("k"))
    r = F.col("x") / F.col("k")
    style = F.when(F.col("k") == 0, F.lit(None)).when(r > 0.1, "inheritance").when(r > 0.01, "mixed").otherwise("composition")
    return f.crossJoin(c).select("avg_connectivity", "max_connectivity", style.alias("style"))  # one row each


@register("code_structure", "A27", f"WITH {NODES}, c AS (SELECT count(*) FILTER (WHERE kind = 'function') AS f, count(*) FILTER (WHERE kind = 'method') AS m, count(*) FILTER (WHERE kind = 'class') AS c FROM nodes) SELECT f AS functions, m AS methods, c AS classes, round((f + m) / c, 1) AS per_class, round(m / (f + m), 2) AS method_ratio, CASE WHEN m / (f + m) > 0.7 THEN 'OOP-dominant' WHEN m / (f + m) > 0.4 THEN 'mixed' ELSE 'functional-dominant' END AS paradigm FROM c")
def code_structure(spark, sf):
    n = lambda k: F.count_if(F.col("kind") == k)
    c = nodes(spark, sf).agg(n("function").alias("functions"), n("method").alias("methods"), n("class").alias("classes"))
    both = F.col("functions") + F.col("methods")
    r = F.col("methods") / both
    return c.select("*", F.round(both / F.col("classes"), 1).alias("per_class"), F.round(r, 2).alias("method_ratio"), F.when(r > 0.7, "OOP-dominant").when(r > 0.4, "mixed").otherwise("functional-dominant").alias("paradigm"))


@register("external_dependencies", "A28", f"WITH {NODES}, e AS (SELECT 'p:' || l_partkey AS src, 'ext.mod' || (l_suppkey % 3) || '.fn' || l_linenumber AS dst FROM lineitem) SELECT array_to_string(list_slice(string_split(dst, '.'), -2, -1), '.') AS name, count(*) AS n FROM e JOIN nodes s ON s.id = e.src WHERE dst NOT IN (SELECT id FROM nodes) AND NOT contains(lower(s.path), 'test') GROUP BY 1 ORDER BY n DESC, name LIMIT 10")
def external_dependencies(spark, sf):
    n = nodes(spark, sf)
    e = table(spark, sf, "lineitem").select(F.concat(F.lit("p:"), "l_partkey").alias("src"), F.concat(F.lit("ext.mod"), F.col("l_suppkey") % 3, F.lit(".fn"), "l_linenumber").alias("dst"))
    e = e.join(n.select(F.col("id").alias("src"), "path"), "src").filter(~F.lower("path").contains("test")).join(n.select(F.col("id").alias("dst")), "dst", "left_anti")
    return e.groupBy(F.array_join(F.slice(F.split("dst", r"\."), -2, 2), ".").alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(10)


@register("hot_zone", "A31", "WITH c AS (SELECT source || '/' || lang || '/' AS zone, count(*) AS n FROM documents GROUP BY 1), t AS (SELECT sum(n) AS total FROM c) SELECT zone, n, CAST(n * 100 // total AS BIGINT) AS pct FROM c, t WHERE total >= 5 ORDER BY n DESC, zone LIMIT 1")
def hot_zone(spark, sf):
    c = table(spark, sf, "documents").groupBy(F.concat("source", F.lit("/"), "lang", F.lit("/")).alias("zone")).agg(F.count("*").alias("n"))
    c = c.withColumn("total", F.sum("n").over(W.partitionBy())).filter("total >= 5")  # a row per zone
    return c.orderBy(F.desc("n"), "zone").limit(1).select("zone", "n", F.expr("n * 100 div total").alias("pct"))


@register("directory_summary", "A32", f"WITH {FILES}, d AS (SELECT split_part(path, '/', 1) AS dir, count(*) AS n FROM files GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, dir) AS i FROM d) SELECT string_agg(dir || ' (' || n || ')', ', ' ORDER BY i) AS summary FROM r WHERE i <= 3")
def directory_summary(spark, sf):
    d = files(spark, sf).groupBy(F.substring_index("path", "/", 1).alias("dir")).agg(F.count("*").alias("n"))
    top = d.orderBy(F.desc("n"), "dir").limit(3)
    x = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.concat("dir", F.lit(" ("), "n", F.lit(")")).alias("s"))))
    return top.agg(F.array_join(F.transform(x, lambda y: y["s"]), ", ").alias("summary"))


@register("daily_budget", "A38 F35", f"""WITH {TELE}, c AS (SELECT id, ts, k * 3.0 / 1000000.0 + size * 15.0 / 1000000.0 AS cost FROM tele), r AS (SELECT id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, cost, sum(cost) OVER (PARTITION BY date_trunc('day', ts) ORDER BY ts, id) AS spent FROM c)
SELECT day, count(*) AS calls, round(CAST(sum(cost) AS DOUBLE), 6) AS cost, count(*) FILTER (WHERE CAST(spent AS DOUBLE) > 0.03) AS over FROM r GROUP BY day""")
def daily_budget(spark, sf):
    t = telemetry(spark, sf).select("id", "ts", (F.col("k") * 3.0 / 1e6 + F.col("size") * 15.0 / 1e6).alias("cost"))
    t = t.withColumn("day", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    spent = F.sum("cost").over(W.partitionBy("day").orderBy("ts", "id").rowsBetween(W.unboundedPreceding, 0))
    return t.withColumn("spent", spent).groupBy("day").agg(F.count("*").alias("calls"), F.round(F.sum("cost"), 6).alias("cost"), F.count_if(F.col("spent") > 0.03).alias("over"))


@register("pass_rate", "A40 A43", f"WITH {TELE} SELECT mode, count(*) AS total, count(*) FILTER (WHERE ok) AS passed, count(*) FILTER (WHERE NOT ok) AS failed, round(count(*) FILTER (WHERE ok) / count(*), 6) AS rate, round(sum(latency_ms), 4) AS duration FROM tele GROUP BY mode")
def pass_rate(spark, sf):
    good = F.count_if("ok")
    return telemetry(spark, sf).groupBy("mode").agg(F.count("*").alias("total"), good.alias("passed"), F.count_if(~F.col("ok")).alias("failed"), F.round(good / F.count("*"), 6).alias("rate"), F.round(F.sum("latency_ms"), 4).alias("duration"))


@register("recent_activity", "W14", f"WITH {TELE}, d AS (SELECT agent, max(ts) AS ts FROM tele GROUP BY agent) SELECT agent, ts FROM d ORDER BY ts DESC, agent LIMIT 10")
def recent_activity(spark, sf):
    d = telemetry(spark, sf).groupBy("agent").agg(F.max("ts").alias("ts"))
    return d.orderBy(F.desc("ts"), "agent").limit(10).select("agent", F.col("ts").cast("timestamp_ntz").alias("ts"))


@register("edge_stats", "A22", f"WITH {NODES}, {EDGES} SELECT type, count(*) AS n, count(n.id) AS resolved, count(*) - count(n.id) AS unresolved FROM edges e LEFT JOIN nodes n ON n.id = e.dst AND n.path NOT LIKE '%f1.py' GROUP BY type")
def edge_stats(spark, sf):
    n = nodes(spark, sf).filter(~F.col("path").like("%f1.py")).select(F.col("id").alias("dst"), F.lit(1).alias("found"))
    return edges(spark, sf).join(n, "dst", "left").groupBy("type").agg(F.count("*").alias("n"), F.count("found").alias("resolved"), (F.count("*") - F.count("found")).alias("unresolved"))


@register("spans_by_route", "A36", f"WITH {SPANS} SELECT lang AS route, kind, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM spans GROUP BY ALL")
def spans_by_route(spark, sf):
    return spans(spark, sf).groupBy(F.col("lang").alias("route"), "kind").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
