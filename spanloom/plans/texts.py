"""Personal and clinical text, chunking, conversion, and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions import phi
from spanloom.operators import chunking, clinical
from spanloom.plans.base import AS_OF, FILES, QUEUE, TELE, files, queue, telemetry
from spanloom.plans.catalog import register
from spanloom.runtime import table
from spanloom.sources import convert
from spanloom.streaming import state

NOTE = ["HPI:", "patient denies chest pain", "MEDICATIONS", "Lisinopril 10mg PO", "Labs:", "Na 140 mmol/L", "ASSESSMENT", "- hypertension, family history of it", "Plan:", "follow up, possible MRI"]


def notes(spark, sf):
    """(id, text): a clinical note per document, with its number and first words in it."""
    words = F.regexp_extract(F.lower("text"), "([a-z]+)", 1)
    lines = [F.lit(x) for x in NOTE]
    lines[1] = F.concat(F.when(F.col("doc_id") % 3 == 0, "patient denies ").otherwise("patient has "), words)
    lines[5] = F.concat(F.lit("Na "), F.col("doc_id") % 50 + 100, F.lit(" mmol/L"))
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.array_join(F.array(*lines), "\n").alias("text"))


NOTES = "w AS (SELECT doc_id AS id, regexp_extract(lower(text), '([a-z]+)', 1) AS w FROM documents)"


@register("phi_findings", "U22", None)
def phi_findings(spark, sf):
    return clinical.findings(table(spark, sf, "documents").select("doc_id", "text"))


@register("phi_redacted", "H1 H2 H3", None)
def phi_redacted(spark, sf):
    r = clinical.redacted(table(spark, sf, "documents").select("doc_id", "text"), patient="p1")
    return r.select("doc_id", F.md5("redacted").alias("md5"))


@register("redact_emails", "H2", "SELECT doc_id, regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', '[REDACTED_EMAIL]', 'g') AS text FROM documents WHERE contains(text, '@')")
def redact_emails(spark, sf):
    """One kind needs no overlap rule, so it stays JVM-side."""
    return table(spark, sf, "documents").filter(F.contains("text", F.lit("@"))).select("doc_id", F.regexp_replace("text", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[REDACTED_EMAIL]").alias("text"))


@register("date_shift", "H4 F43", f"WITH {TELE} SELECT id, strftime(CAST(ts AS DATE) + CAST(k % 365 AS INTEGER), '%m/%d/%Y') AS shifted FROM tele")
def date_shift(spark, sf):
    d = F.date_format("ts", "MM/dd/yyyy")
    t = telemetry(spark, sf)
    return t.select("id", F.date_format(F.date_add(F.to_date(d, "MM/dd/yyyy"), (F.col("k") % 365).cast("int")), "MM/dd/yyyy").alias("shifted"))


@register("note_sections", "U20 H6", f"WITH {NOTES} SELECT id, s AS section, a AS start_line, CASE WHEN s = 'subjective' THEN CASE WHEN id % 3 = 0 THEN 'patient denies ' ELSE 'patient has ' END || w WHEN s = 'labs' THEN 'Na ' || (id % 50 + 100) || ' mmol/L' WHEN s = 'medications' THEN 'Lisinopril 10mg PO' WHEN s = 'assessment' THEN '- hypertension, family history of it' ELSE 'follow up, possible MRI' END AS content FROM w, (VALUES ('subjective', 0), ('medications', 2), ('labs', 4), ('assessment', 6), ('plan', 8)) v(s, a)")
def note_sections(spark, sf):
    return clinical.sections(notes(spark, sf)).select("id", "section", "start_line", "content")


@register("note_items", "U21 F39", f"WITH {NOTES} SELECT id, 'medication' AS kind, 'Lisinopril' AS name, CAST(NULL AS DOUBLE) AS value FROM w UNION ALL SELECT id, 'lab', 'Na', CAST(id % 50 + 100 AS DOUBLE) FROM w UNION ALL SELECT id, 'diagnosis', 'hypertension, family history of it', NULL FROM w")
def note_items(spark, sf):
    return clinical.items(notes(spark, sf)).select("id", "kind", "name", "value")


@register("entity_context", "H5", f"WITH {NOTES} SELECT id, id % 3 = 0 AS negated, true AS family, false AS historical FROM w")
def entity_context(spark, sf):
    """Flags around the finding of the first line, and around hypertension."""
    n = notes(spark, sf).withColumn("text", F.regexp_replace("text", r"(denies|has) \w*", "$1 pain"))
    at, h = F.instr("text", "pain") - 1, F.instr("text", "hypertension") - 1
    a, b = phi.context(F.substring_index("text", "\n", 2), at, at + 4), phi.context(F.col("text"), h, h + 12)
    return n.select("id", a["negated"].alias("negated"), b["family"].alias("family"), a["historical"].alias("historical"))


@register("section_boost", "H7 H8", f"WITH {NOTES}, s AS (SELECT id, s, k, (id % 100) / 100.0 AS score FROM w, (VALUES ('ASSESSMENT', 0.9), ('plan', 0.6), ('xyz', 0.2)) v(s, k)) SELECT id, s AS section, round(CAST(score * k AS DOUBLE), 6) AS by_section, round(CAST(score * k * CASE id % 4 WHEN 0 THEN 0.3 WHEN 1 THEN 1.5 WHEN 2 THEN 0.3 ELSE 1.0 END AS DOUBLE), 6) AS negation_aware FROM s")
def section_boost(spark, sf):
    i = F.col("doc_id")
    said = F.when(i % 4 == 0, "Denies pain").when(i % 4 == 1, "positive for X").when(i % 4 == 2, "no evidence of X").otherwise("stable")
    s = table(spark, sf, "documents").select(i.alias("id"), F.explode(F.array(F.lit("ASSESSMENT"), F.lit("plan"), F.lit("xyz"))).alias("section"), (i % 100 / 100.0).alias("score"), said.alias("content"))
    w = F.col("score") * phi.section_weight(F.col("section"))
    return s.select("id", "section", F.round(w, 6).alias("by_section"), F.round(w * phi.negation_factor(F.col("content")), 6).alias("negation_aware"))


@register("two_stage_search", "H9", "WITH d AS (SELECT user_id % 3 AS query_id, user_id % 200 AS doc, max(value) AS score FROM events GROUP BY ALL), p AS (SELECT query_id, doc, e.i AS part, score * e.f AS s, e.sec FROM d, (VALUES (0, 0.5, 'history'), (1, 0.9, 'findings'), (2, 0.1, 'plan')) e(i, f, sec)), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS n FROM d), j AS (SELECT p.*, r.n FROM p JOIN r USING (query_id, doc) WHERE r.n <= 50), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc, part) AS m FROM j) SELECT query_id, doc, CAST(part AS INTEGER) AS part, round(CAST(s AS DOUBLE), 6) AS score FROM k WHERE m <= 10 OR (sec IN ('assessment', 'plan') AND n <= 3)")
def two_stage_search(spark, sf):
    d = table(spark, sf, "events").groupBy((F.col("user_id") % 3).alias("query_id"), (F.col("user_id") % 200).alias("doc")).agg(F.max("value").alias("score"))
    kinds = F.array(*[F.struct(F.lit(i).alias("part"), F.lit(f).alias("f"), F.lit(s).alias("section")) for i, f, s in ((0, 0.5, "history"), (1, 0.9, "findings"), (2, 0.1, "plan"))])
    p = d.select("query_id", "doc", "score", F.explode(kinds).alias("e")).select("query_id", "doc", "e.part", (F.col("score") * F.col("e.f")).alias("score"), "e.section")
    return clinical.two_stage(d, p).select("query_id", "doc", "part", F.round("score", 6).alias("score"))


@register("clinical_relations", "U23 H10", """WITH d AS (SELECT doc_id AS id, 'drug' || (doc_id % 9) AS a, 'Drug' || (doc_id % 9) AS b FROM documents)
SELECT id, 'Hypertension' AS source, a AS target, 'TREATED_BY' AS type, CAST(0.9 AS DOUBLE) AS confidence, 'Hypertension is treated with ' || a AS context FROM d
UNION ALL SELECT id, b, 'cough', 'ADVERSE_EVENT', CAST(0.9 AS DOUBLE), b || ' may cause cough' FROM d""")
def clinical_relations(spark, sf):
    n = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("Hypertension is treated with drug"), F.col("doc_id") % 9, F.lit(". Drug"), F.col("doc_id") % 9, F.lit(" may cause cough.")).alias("text"))
    return clinical.relations(n)


@register("ontology_lookup", "S19 F40 S20", f"WITH {FILES}, o(ontology, code, term) AS (VALUES ('icd10', 'en', 'English'), ('icd10', 'de', 'German'), ('loinc', 'fr', 'French')) SELECT id, ontology, term FROM files JOIN o ON o.code = lang")
def ontology_lookup(spark, sf):
    o = spark.createDataFrame([("icd10", "en", "English"), ("icd10", "de", "German"), ("loinc", "fr", "French")], "ontology string, code string, term string")
    return files(spark, sf).join(F.broadcast(o), F.col("lang") == F.col("code")).select("id", "ontology", "term")  # literal rows


@register("line_pages", "U11", """WITH RECURSIVE d AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text <> ''), l AS (SELECT doc_id, unnest(range(1, len(x) + 1)) AS i, length(unnest(x)) AS n FROM d),
w AS (SELECT doc_id, i, n, 0 AS page, n + 1 AS used FROM l WHERE i = 1
  UNION ALL SELECT l.doc_id, l.i, l.n, w.page + CAST(w.used + l.n + 1 > 1000 AS INTEGER), CASE WHEN w.used + l.n + 1 > 1000 THEN l.n + 1 ELSE w.used + l.n + 1 END FROM w JOIN l ON l.doc_id = w.doc_id AND l.i = w.i + 1)
SELECT doc_id, CAST(page AS INTEGER) AS page, CAST(sum(n) + count(*) - 1 AS INTEGER) AS n FROM w GROUP BY doc_id, page""")
def line_pages(spark, sf):
    return chunking.line_pages(table(spark, sf, "documents").select("doc_id", "text"), "doc_id").select("doc_id", "page", F.length("content").alias("n"))


@register("char_windows", "U10", """WITH RECURSIVE s AS (SELECT doc_id, text, 0 AS a, substr(text, 1, 1000) AS p FROM documents WHERE text <> ''),
w AS (SELECT doc_id, text, a, CASE WHEN a + 1000 < length(text) AND strpos(reverse(p), chr(10)) > 0 AND length(p) - strpos(reverse(p), chr(10)) > 600 THEN a + length(p) - strpos(reverse(p), chr(10)) ELSE least(length(text), a + 1000) END AS b FROM s
  UNION ALL SELECT doc_id, text, c, CASE WHEN c + 1000 < length(text) AND strpos(reverse(p), chr(10)) > 0 AND length(p) - strpos(reverse(p), chr(10)) > 600 THEN c + length(p) - strpos(reverse(p), chr(10)) ELSE least(length(text), c + 1000) END
  FROM (SELECT doc_id, text, greatest(a + 1, b - 100) AS c, substr(text, CAST(greatest(a + 1, b - 100) + 1 AS BIGINT), 1000) AS p FROM w WHERE b < length(text)))
SELECT doc_id, CAST(a AS INTEGER) AS start, CAST(b AS INTEGER) AS "end" FROM w WHERE regexp_matches(substr(text, CAST(a + 1 AS BIGINT), CAST(b - a AS BIGINT)), '\\S')""")
def char_windows(spark, sf):
    return chunking.char_windows(table(spark, sf, "documents").select("doc_id", "text"), "doc_id").select("doc_id", "start", "end")


@register("fixed_windows", "U10", "SELECT doc_id, CAST(s AS INTEGER) AS start, substr(text, CAST(s AS INTEGER) + 1, 500) AS content FROM documents, LATERAL (SELECT unnest(range(0, greatest(length(text), 1), 450)) AS s)")
def fixed_windows(spark, sf):
    """Windows of 500 characters every 450, JVM-side."""
    d = table(spark, sf, "documents")
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.length("text"), F.lit(1)) - 1, F.lit(450)))
    return d.select("doc_id", "text", at.alias("start")).select("doc_id", "start", F.substring("text", F.col("start") + 1, F.lit(500)).alias("content"))


@register("markdown_chunks", "U6 U7 U8 W12 W13", None)
def markdown_chunks(spark, sf):
    d = table(spark, sf, "documents")
    md = F.concat(F.lit("# "), F.col("source"), F.lit("\n\n## "), F.col("lang"), F.lit("\n\n"), F.replace("text", F.lit("\n"), F.lit("\n\n")))
    return chunking.markdown_sections(d.select("doc_id", md.alias("text")), "doc_id").select("doc_id", "path", "slug", "start_line", "end_line")


@register("regex_hits", "U12", """WITH t AS (SELECT doc_id, regexp_extract_all(text, '[Ll]icen[sc]e') AS m, regexp_split_to_array(text, '[Ll]icen[sc]e') AS p FROM documents),
h AS (SELECT doc_id, m, p, unnest(range(0, least(20, len(m)))) AS n FROM t), b AS (SELECT doc_id, m[n + 1] AS hit, array_to_string(p[1:n + 1], '') || array_to_string(m[1:n], '') AS x FROM h)
SELECT doc_id, CAST(length(x) AS INTEGER) AS start, CAST(length(x) + length(hit) AS INTEGER) AS "end", CAST(length(x) - length(replace(x, chr(10), '')) + 1 AS INTEGER) AS start_line, CAST(length(x) - length(replace(x, chr(10), '')) + 1 AS INTEGER) AS end_line, hit FROM b""")
def regex_hits(spark, sf):
    return chunking.regex_hits(table(spark, sf, "documents").select("doc_id", "text"), r"[Ll]icen[sc]e", "doc_id")


@register("code_spans", "U1 U2 U3 U4 U5 U26 T-4", """WITH w AS (SELECT doc_id, 'A_' || regexp_extract(lower(text), '([a-z]+)', 1) AS a, doc_id % 3 AS k FROM documents)
SELECT doc_id, a AS symbol, CASE WHEN k = 2 THEN 'type' ELSE 'class' END AS kind, 1 AS start_line, CAST([4, 5, 2][k + 1] AS INTEGER) AS end_line, CASE WHEN k = 0 THEN 'doc' ELSE '' END AS doc FROM w
UNION ALL SELECT doc_id, CASE WHEN k = 2 THEN 'A.Run' ELSE a || '.run' END, 'method', CAST([3, 2, 3][k + 1] AS INTEGER), 4, '' FROM w""")
def code_spans(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.regexp_extract(F.lower("text"), "([a-z]+)", 1).alias("w"), (F.col("doc_id") % 3).alias("k"))
    py = F.concat(F.lit("class A_"), "w", F.lit(":\n    '''doc'''\n    def run(self):\n        return 1\n"))
    js = F.concat(F.lit("class A_"), "w", F.lit(" {\n  run(x) {\n    return 1;\n  }\n}\n"))
    go = F.concat(F.lit("type A_"), "w", F.lit(" struct {\n}\nfunc (a *A) Run() {\n}\n"))
    t = d.select("doc_id", F.when(F.col("k") == 0, py).when(F.col("k") == 1, js).otherwise(go).alias("text"), F.when(F.col("k") == 0, "python").when(F.col("k") == 1, "javascript").otherwise("go").alias("lang"))
    return chunking.spans(t, "doc_id")


@register("python_graph", "U16 G17", """WITH m AS (SELECT 'm' || doc_id AS module FROM documents)
SELECT module, 'relation' AS what, 'mod:' || module AS a, 'IMPORTS' AS edge, 'mod:os' AS b FROM m UNION ALL SELECT module, 'entity', 'type:' || module || '.B', 'class', '2-4' FROM m
UNION ALL SELECT module, 'relation', 'type:' || module || '.B', 'EXTENDS', 'type:os.PathLike' FROM m UNION ALL SELECT module, 'entity', 'sym:' || module || '.B.f', 'method', '3-4' FROM m
UNION ALL SELECT module, 'relation', 'sym:' || module || '.B.f', 'CALLS', 'sym:os.getcwd' FROM m UNION ALL SELECT module, 'entity', 'sym:' || module || '.g', 'function', '5-6' FROM m
UNION ALL SELECT module, 'relation', 'sym:' || module || '.g', 'CALLS', 'sym:' || module || '.B' FROM m""")
def python_graph(spark, sf):
    d = table(spark, sf, "documents").select(F.concat(F.lit("m"), "doc_id").alias("module"), F.concat(F.lit("import os\nclass B(os.PathLike):\n    def f(self):\n        return os.getcwd()\ndef g():\n    return B()\n# "), F.col("doc_id")).alias("text"))
    return chunking.schema_graph(d)


@register("html_text", "S17 X7", r"""WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<head\b.*?</head\s*>|<!--.*?-->', ' ', 'g') AS t FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(t, '(?i)<(br|/p|/div|/li|/h[1-6]|/tr|/article|/section)\b[^>]*>', chr(10), 'g'), '<[^>]+>', '', 'g') AS t FROM a),
c AS (SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS t FROM b)
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), '\s*\n\s*', chr(10), 'g'), '^\s+|\s+$', '', 'g') AS text FROM c""")
def html_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", convert.html_text(F.col("html")).alias("text"))


@register("sidecars", "S18", f"WITH {FILES} SELECT id, '.sidecar/' || path || '.md.gz' AS sidecar, id % 4 = 0 OR (id % 3 = 0) AS stale FROM files")
def sidecars(spark, sf):
    made = F.when(F.col("id") % 4 != 0, F.when(F.col("id") % 3 == 0, F.col("mtime") - 1).otherwise(F.col("mtime")))
    return files(spark, sf).select("id", convert.sidecar(F.col("path")).alias("sidecar"), convert.stale(F.col("mtime"), made).alias("stale"))


@register("hash_embedding", "F18 X1 X2 R31", None)
def hash_embedding(spark, sf):
    from spanloom.operators.embed import hash_vectors

    return hash_vectors(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", dim=64).select("doc_id", F.round(F.col("vector")[0], 6).alias("first"), F.size("vector").alias("dim"))


@register("debounce_sessions", "T-2", f"WITH {TELE}, g AS (SELECT agent, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY agent ORDER BY ts) + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS n FROM tele), s AS (SELECT *, sum(n) OVER (PARTITION BY agent ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT agent, min(ts) AS start, max(ts) + INTERVAL 1 HOUR AS ready, count(*) AS n FROM s GROUP BY agent, k")
def debounce_sessions(spark, sf):
    d = state.debounce(telemetry(spark, sf), "agent", "ts", "1 hour")
    return d.select("agent", F.col("start").cast("timestamp_ntz").alias("start"), F.col("ready").cast("timestamp_ntz").alias("ready"), "n")


def _stream(spark, sf):
    from spanloom.streaming.sources import parquet_stream

    return parquet_stream(spark, sf, "events.parquet", table(spark, sf, "events").schema).withColumn("ts", F.col("ts").cast("timestamp"))


@register("stream_tumbling", "T-1", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark, sf):
    w = state.windowed(_stream(spark, sf), "ts", ["event_type"], "value", "1 hour")
    return state.run_once(w).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@register("stream_sliding", "T-1", "SELECT time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 12 HOUR * i AS start, count(*) AS n FROM events, (VALUES (-1), (0), (1)) v(i) WHERE ts >= time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 12 HOUR * i AND ts < time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 12 HOUR * i + INTERVAL 1 DAY GROUP BY 1")
def stream_sliding(spark, sf):
    w = state.windowed(_stream(spark, sf), "ts", [], "value", "1 day", "12 hours")
    return state.run_once(w).select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


@register("stream_escalation", "T-8", "SELECT user_id, count(*) AS failures, CAST(least(count(*) // 3, 1) AS INTEGER) AS tier, CAST(CASE WHEN count(*) >= 6 THEN 3 ELSE count(*) % 3 END AS INTEGER) AS attempts, count(*) >= 6 AS permanent FROM events WHERE event_type = 'error' GROUP BY user_id")
def stream_escalation(spark, sf):
    s = state.escalation_stream(_stream(spark, sf).filter("event_type = 'error'"), "user_id")
    r = state.run_once(s, "update")
    return r.groupBy("user_id").agg(F.max(F.struct("failures", "tier", "attempts", "permanent")).alias("x")).select("user_id", "x.*")


@register("retry_escalation", "T-8", f"WITH {QUEUE} SELECT span, count(*) AS failures, CAST(least(count(*) // 3, 1) AS INTEGER) AS tier, CAST(CASE WHEN count(*) >= 6 THEN 3 ELSE count(*) % 3 END AS INTEGER) AS attempts, count(*) >= 6 AS permanent FROM queue WHERE NOT ok GROUP BY span")
def retry_escalation(spark, sf):
    return state.escalation(queue(spark, sf).filter("NOT ok"), ["span"])


@register("queue_push", "T-5 T-3", f"WITH {QUEUE} SELECT repo, span, min(struct_pack(created, id)).id AS id FROM queue GROUP BY repo, span")
def queue_push(spark, sf):
    q = queue(spark, sf).withColumn("at", F.struct("created", "id"))
    return state.push(q, ["repo", "span"], "at").select("repo", "span", "id")


@register("orphan_claims", "T-9 T-10", f"WITH {QUEUE} SELECT claimed_by, span, max(created) AS last FROM queue WHERE claimed_by IS NOT NULL GROUP BY ALL HAVING max(created) < TIMESTAMP '{AS_OF}' - INTERVAL 600 SECOND")
def orphan_claims(spark, sf):
    o = state.orphans(queue(spark, sf).filter("claimed_by IS NOT NULL"), ["claimed_by", "span"], "created", AS_OF)
    return o.select("claimed_by", "span", F.col("last").cast("timestamp_ntz").alias("last"))


@register("rate_windows", "W15 T-15", "SELECT event_id AS id, count(*) OVER w AS requests, CAST(sum(user_id) OVER w AS BIGINT) AS used FROM (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events) WINDOW w AS (PARTITION BY event_type ORDER BY s RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW)")
def rate_windows(spark, sf):
    return state.sliding_rate(table(spark, sf, "events"), ["event_type"], "ts", "user_id", 3600).select(F.col("event_id").alias("id"), "requests", "used")


@register("breaker_state", "W16", f"WITH {TELE}, g AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY agent ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS g FROM tele), s AS (SELECT id, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY agent, g ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS n FROM g) SELECT id, CAST(n AS BIGINT) AS streak, n >= 2 AS open FROM s")
def breaker_state(spark, sf):
    return state.failure_runs(telemetry(spark, sf), "agent", ["ts", "id"], "ok", 2, F.date_trunc("day", "ts")).select("id", "streak", "open")


@register("scheduler", "T-12", f"WITH {QUEUE}, r AS (SELECT repo, max(created) AS last_at, count(*) FILTER (WHERE NOT ok) % 5 AS failures FROM queue GROUP BY repo) SELECT repo, failures < 3 AND last_at <= TIMESTAMP '{AS_OF}' - INTERVAL 5 MINUTE AS eligible FROM r")
def scheduler(spark, sf):
    r = queue(spark, sf).groupBy("repo").agg(F.max("created").alias("last_at"), (F.count_if(~F.col("ok")) % 5).alias("failures"))
    r = r.withColumn("running", F.lit(False)).withColumn("next_at", F.lit(None).cast("timestamp"))
    return state.eligible(r, AS_OF, "5 minutes", 3).select("repo", "eligible")


@register("enrichments_listed", "P5", "WITH d AS (SELECT doc_id % 50 AS span, doc_id, lang || ':' || source AS v, row_number() OVER (PARTITION BY doc_id % 50 ORDER BY doc_id) AS i FROM documents) SELECT span, count(*) AS n, string_agg(CASE WHEN i <= 100 THEN v END, ',' ORDER BY doc_id) AS items FROM d GROUP BY span")
def enrichments_listed(spark, sf):
    """How many enrichments a span has, and the first hundred as a list."""
    from spanloom.operators.search import top

    d = table(spark, sf, "documents").select((F.col("doc_id") % 50).alias("span"), "doc_id", F.concat("lang", F.lit(":"), "source").alias("v"))
    x = F.array_sort(F.collect_list(F.struct("doc_id", "v")))
    few = top(d, ["span"], 100, F.col("doc_id")).groupBy("span").agg(F.array_join(F.transform(x, lambda r: r["v"]), ",").alias("items"))
    return d.groupBy("span").agg(F.count("*").alias("n")).join(few, "span").select("span", "n", "items")
