"""Scalar functions and classifiers over documents, paths and queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions import classify as C
from spanloom.functions import paths as P
from spanloom.functions import symbols as S
from spanloom.functions import text as T
from spanloom.functions.times import backoff
from spanloom.plans.base import FILES, NODES, SPANS, TELE, files, nodes, spans, telemetry
from spanloom.plans.catalog import register
from spanloom.runtime import table

ENDS = ["", " how to configure the guide", " def main(x)", " sku AB-12345 price", " find bugs in router.py", " why does class Foo validate", " item order", " if return"]


def asked(spark, sf):
    """(item_id, q): whole benchmark texts with endings that different classes answer to."""
    end = F.element_at(F.array(*map(F.lit, ENDS)), (F.col("item_id") % 8 + 1).cast("int"))
    return table(spark, sf, "benchmark").select("item_id", F.concat(F.lower("text"), end).alias("q"))


ASKED = "asked AS (SELECT item_id, lower(text) || [" + ", ".join(f"'{e}'" for e in ENDS) + "][item_id % 8 + 1] AS q FROM benchmark)"


def sql_any(col: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({col}, '{w.replace(chr(39), chr(39) * 2)}')" for w in words) + ")"


def sql_count(col: str, words: list[str]) -> str:
    return "(" + " + ".join(f"CAST(contains({col}, '{w}') AS INTEGER)" for w in words) + ")"


TOK = "list_filter(regexp_extract_all(lower({}), '([a-z0-9_]+)', 1), lambda t: length(t) > 1)"


@register("token_functions", "F1 F3 F5 E7", f"""WITH t AS (SELECT doc_id, {TOK.format("text")} AS w FROM documents)
SELECT doc_id, CAST(len(w) AS INTEGER) AS n, w[1] AS first, CASE WHEN len(w) > 1 THEN w[1] || ' ' || w[2] END AS bigram, round(len(list_intersect(list_distinct(w), ['the', 'of', 'der', 'que'])) * 1.0 / len(list_distinct(list_concat(w, ['the', 'of', 'der', 'que']))), 6) AS overlap FROM t""")
def token_functions(spark, sf):
    t = table(spark, sf, "documents").select("doc_id", T.tokens(F.col("text")).alias("w"))
    few = F.array(*map(F.lit, ["the", "of", "der", "que"]))
    return t.select("doc_id", F.size("w").alias("n"), F.get("w", F.lit(0)).alias("first"), F.get(T.bigrams(F.col("w")), F.lit(0)).alias("bigram"), F.round(T.jaccard(F.col("w"), few), 6).alias("overlap"))


@register("plan_tokens", "F2 F6", "WITH t AS (SELECT item_id, list_filter(regexp_extract_all(lower(text), '([a-z0-9_]+)', 1), lambda t: NOT list_contains(['the', 'a', 'an', 'and', 'or', 'to', 'of', 'in', 'for', 'with', 'is', 'are', 'do', 'does', 'how', 'what', 'where', 'when', 'why', 'who', 'we', 'please'], t)) AS w FROM (SELECT item_id, 'How do we ' || text || [' please', ' this into that', ' does it'][item_id % 3 + 1] AS text FROM benchmark)) SELECT item_id, CAST(len(w) AS INTEGER) AS n, CASE WHEN len(w) > 0 THEN array_to_string(w[1:4], '-') ELSE 'general_query' END AS intent FROM t")
def plan_tokens(spark, sf):
    end = F.element_at(F.array(*map(F.lit, [" please", " this into that", " does it"])), (F.col("item_id") % 3 + 1).cast("int"))
    t = table(spark, sf, "benchmark").select("item_id", T.plan_tokens(F.concat(F.lit("How do we "), "text", end)).alias("w"))
    return t.select("item_id", F.size("w").alias("n"), T.intent_slug(F.col("w")).alias("intent"))


@register("word_overlap", "F5 F4", "WITH w AS (SELECT d.doc_id, list_distinct(list_filter(regexp_split_to_array(lower(d.text), '\\s+'), lambda x: x <> '')) AS a, list_distinct(list_filter(regexp_split_to_array(lower(b.text), '\\s+'), lambda x: x <> '')) AS b, CASE WHEN contains(lower(d.text), lower(substr(b.text, 1, 20))) THEN 1.0 ELSE 0.0 END AS p FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % 40) SELECT doc_id, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS jaccard, CAST(p AS DOUBLE) AS presence FROM w")
def word_overlap(spark, sf):
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("k"), F.col("text").alias("q"))
    d = table(spark, sf, "documents").withColumn("k", F.col("doc_id") % 40).join(b, "k")
    return d.select("doc_id", F.round(T.word_jaccard(F.col("text"), F.col("q")), 6).alias("jaccard"), T.presence(F.substring("q", 1, 20), F.col("text")).alias("presence"))


@register("score_transforms", "F7 F8 F33 F34 F35", f"WITH {TELE} SELECT id, round(CASE WHEN latency_ms <= 0 THEN 0 ELSE least(0.99, latency_ms / (latency_ms + 4)) END, 6) AS confidence, round(1 / (1 + greatest(0, latency_ms - 1)), 6) AS bm25n, least(power(2.0, k % 9), 60.0) AS delay, CAST(floor((k * 100 + 1000 - 700) * 0.9) AS BIGINT) AS budget, round((k * 0.15 + size * 0.6) / 1000000.0, 9) AS cost FROM tele")
def score_transforms(spark, sf):
    from spanloom.operators.search import normalize_bm25

    v = F.col("latency_ms")
    return telemetry(spark, sf).select("id", F.round(T.score_confidence(v), 6).alias("confidence"), F.round(normalize_bm25(v - 1), 6).alias("bm25n"), backoff(F.col("k") % 9, 1.0, 60.0).alias("delay"), F.floor((F.col("k") * 100 + 1000 - 700) * F.lit(0.9)).alias("budget"), F.round((F.col("k") * 0.15 + F.col("size") * 0.6) / 1e6, 9).alias("cost"))


@register("path_functions", "F10 F26 F29 F30 F42 F46 R3", f"""WITH {FILES}, e AS (SELECT id, path, regexp_extract(path, '(\\.[a-z]+)$', 1) AS x FROM files)
SELECT id, CAST(CASE WHEN x IN ('.py', '.ts') THEN 1.0 WHEN x = '.md' THEN 0.3 ELSE 0.7 END AS DOUBLE) AS weight, CAST(CASE WHEN x IN ('.py', '.ts') THEN 3 WHEN x = '.md' THEN 7 ELSE 5 END AS INTEGER) AS priority, CASE x WHEN '.py' THEN 'python' WHEN '.ts' THEN 'typescript' WHEN '.md' THEN 'markdown' ELSE 'json' END AS language,
CASE WHEN x = '.md' THEN 'docs' ELSE 'code' END AS kind, x IN ('.py', '.ts', '.json') AS is_code, CAST(CASE WHEN x IN ('.py', '.ts') THEN 0.15 WHEN x = '.md' THEN -0.12 ELSE 0.0 END AS DOUBLE) AS boost FROM e""")
def path_functions(spark, sf):
    p = F.col("path")
    return files(spark, sf).select("id", C.extension_weight(p).alias("weight"), P.priority(p).alias("priority"), P.language(p).alias("language"), P.provenance(p).alias("kind"), P.is_code(p).alias("is_code"), C.extension_score(p, F.lit("neutral")).alias("boost"))


KINDS_OF_FILE = ["mjs", "cjs", "cc", "hpp", "hh", "bash", "markdown", "toml", "rb", "html", "css", "txt", "JS", "Scala", "ps1", "hrl", "yml", "h", "rst", "vue", "tar.gz", "exs", "clj", "cmd"]


@register("extension_tables", "F29 F46", """WITH p AS (SELECT doc_id, lower('.' || ['mjs', 'cjs', 'cc', 'hpp', 'hh', 'bash', 'markdown', 'toml', 'rb', 'html', 'css', 'txt', 'JS', 'Scala', 'ps1', 'hrl', 'yml', 'h', 'rst', 'vue', 'gz', 'exs', 'clj', 'cmd'][doc_id % 24 + 1]) AS x FROM documents)
SELECT doc_id, CASE WHEN x IN ('.js', '.mjs', '.cjs', '.jsx') THEN 'javascript' WHEN x = '.ts' THEN 'typescript' WHEN x = '.tsx' THEN 'tsx' WHEN x = '.py' THEN 'python' WHEN x IN ('.c', '.h') THEN 'c'
  WHEN x IN ('.cc', '.cpp', '.hpp', '.hh') THEN 'cpp' WHEN x IN ('.sh', '.bash') THEN 'bash' WHEN x IN ('.yaml', '.yml') THEN 'yaml' WHEN x IN ('.md', '.markdown') THEN 'markdown' END AS language,
 x IN ('.py', '.ts', '.js', '.rs', '.go', '.c', '.cpp', '.h', '.hpp', '.java', '.scala', '.kt', '.swift', '.rb', '.php', '.sh', '.bash', '.yaml', '.yml', '.json', '.toml', '.xml', '.html', '.css', '.scss', '.sql', '.lua', '.pl', '.pm',
  '.r', '.m', '.fs', '.fsi', '.hs', '.ex', '.exs', '.erl', '.hrl', '.clj', '.cljs', '.lisp', '.scm', '.el', '.vim', '.zsh', '.fish', '.bat', '.cmd', '.ps1') AS is_code FROM p""")
def extension_tables(spark, sf):
    p = F.concat(F.lit("src/a."), F.element_at(F.array(*map(F.lit, KINDS_OF_FILE)), (F.col("doc_id") % len(KINDS_OF_FILE) + 1).cast("int")))
    return table(spark, sf, "documents").select("doc_id", P.language(p).alias("language"), P.is_code(p).alias("is_code"))


@register("filename_match", "R2", f"WITH {FILES} SELECT id, CAST(CASE WHEN 'doc' || (id % 3) || '.py' = b THEN 0.35 WHEN 'doc' || (id % 3) = regexp_replace(b, '\\.[^.]*$', '') THEN 0.30 WHEN contains(b, 'doc' || (id % 3)) THEN 0.08 ELSE 0.0 END AS DOUBLE) AS score FROM (SELECT id, split_part(path, '/', 3) AS b FROM files)")
def filename_match(spark, sf):
    q = F.concat(F.lit("doc"), F.col("id") % 3)
    s = C.filename_score(F.concat(q, F.lit(".py")), F.col("path"))
    return files(spark, sf).select("id", F.greatest(F.when(s == 0.35, s).otherwise(0.0), C.filename_score(q, F.col("path"))).alias("score"))


@register("hash_functions", "F12 F13 F14 F15 F44", f"WITH {SPANS} SELECT s.id, substr(md5(f.path || ':' || start_line || ':' || end_line), 1, 16) AS entity_hash, sha1(lower(f.path) || '|' || start_line || '|' || end_line) AS location_hash, f.path || '#' || symbol AS span_ref, substr(sha256(f.file_hash || ':v1'), 1, 16) AS input_hash FROM spans s JOIN files f ON f.id = s.file_id")
def hash_functions(spark, sf):
    s = spans(spark, sf).join(files(spark, sf).select(F.col("id").alias("file_id"), "path", "file_hash"), "file_id")
    at = lambda sep, p: F.concat_ws(sep, p, "start_line", "end_line")
    return s.select("id", F.substring(F.md5(at(":", F.col("path"))), 1, 16).alias("entity_hash"), F.sha1(at("|", F.lower("path"))).alias("location_hash"), F.concat("path", F.lit("#"), "symbol").alias("span_ref"), F.substring(F.sha2(F.concat("file_hash", F.lit(":v1")), 256), 1, 16).alias("input_hash"))


@register("truncate_functions", "F22 F23 F25 P4 F45 R28", f"""WITH {FILES} SELECT id, CASE WHEN length(text) > 40 THEN substr(text, 1, 39) || '…' ELSE text END AS cut, array_to_string(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')[1:5], ' ') AS words,
trim(regexp_replace(regexp_replace(lower(substr(text, 1, 30)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS slug, CASE WHEN length(text) // 3 + 1 > 100 THEN substr(text, 1, 300) || chr(10) || '[truncated]' ELSE text END AS head, CAST(length('File: ' || path || chr(10) || 'Symbol: s' || chr(10) || 'Language: ' || lang || chr(10) || 'Lines: 1-9' || chr(10) || chr(10) || substr(text, 1, 4000)) AS INTEGER) AS embed_chars FROM files""")
def truncate_functions(spark, sf):
    x = F.col("text")
    return files(spark, sf).select("id", T.ellipsis(x, 40).alias("cut"), T.first_words(x, 5).alias("words"), T.slug(F.substring(x, 1, 30)).alias("slug"), T.head_trim(x, 100).alias("head"), F.length(T.embedding_text(F.col("path"), F.lit("s"), F.col("lang"), F.lit("1"), F.lit("9"), x)).alias("embed_chars"))


@register("token_estimates", "F32", "SELECT doc_id, length(text) // 4 AS by_chars, length(text) // 3 + 1 AS of_prompt, CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS INTEGER) AS by_words, NOT regexp_matches(text, '[^\\x00-\\x{FF}]') AS latin1 FROM documents")
def token_estimates(spark, sf):
    x = F.col("text")
    return table(spark, sf, "documents").select("doc_id", T.tokens_by_chars(x).alias("by_chars"), T.tokens_of_prompt(x).alias("of_prompt"), T.tokens_by_words(x).alias("by_words"), T.latin1(x).alias("latin1"))


@register("vector_functions", "F16 F17 R30", """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), n AS (SELECT *, sqrt(list_inner_product(v, v)) AS n FROM v)
SELECT vec_id, round(n, 6) AS norm, round(CASE WHEN n > 0 THEN v[1] / n ELSE v[1] END, 6) AS unit_first, round(list_sum(list_transform(v, lambda x: abs(x))), 5) AS l1 FROM n""")
def vector_functions(spark, sf):
    from spanloom.functions.vectors import norm, unit

    e = F.col("embedding")
    return table(spark, sf, "embeddings").select("vec_id", F.round(norm(e), 6).alias("norm"), F.round(unit(e)[0], 6).alias("unit_first"), F.round(F.aggregate(e, F.lit(0.0), lambda a, x: a + F.abs(x.cast("double"))), 5).alias("l1"))


@register("symbol_keys", "F27 F28", f"WITH {SPANS} SELECT id, string_split(symbol, '.')[-1] AS leaf, CASE WHEN string_split(symbol, '.')[-1] = '' THEN symbol ELSE symbol || ',' || string_split(symbol, '.')[-1] END AS keys, CAST(length(symbol) - length(replace(symbol, '.', '')) AS INTEGER) AS depth FROM spans")
def symbol_keys(spark, sf):
    s = F.col("symbol")
    return spans(spark, sf).select("id", S.leaf(s).alias("leaf"), F.array_join(S.candidate_keys(s), ",").alias("keys"), (F.size(F.split(s, r"\.")) - 1).alias("depth"))


@register("sniff_content", "F37", f"WITH {FILES} SELECT id, CASE WHEN path LIKE '%.py' THEN 'code/python' WHEN path LIKE '%.ts' THEN 'code/typescript' WHEN path LIKE '%.md' THEN 'markdown' ELSE 'json' END AS by_path, 'text' AS by_sample FROM files")
def sniff_content(spark, sf):
    return files(spark, sf).select("id", C.sniff(F.col("path"), F.col("text")).alias("by_path"), C.sniff(F.lit("x"), F.concat(F.lit("x"), F.col("text"))).alias("by_sample"))


@register("query_intent", "C7", f"WITH {ASKED} SELECT item_id, CASE WHEN {sql_any('lower(q)', C.INTENT_DOCS)} THEN 'docs' WHEN {sql_any('lower(q)', P.CODE)} OR {sql_any('lower(q)', C.INTENT_CODE)} OR len(list_filter(regexp_split_to_array(q, '\\s+'), lambda w: (contains(w, '_') AND NOT starts_with(w, '_') AND NOT ends_with(w, '_')) OR (regexp_matches(w, '\\p{{Lu}}') AND regexp_matches(w, '\\p{{Ll}}')))) > 0 THEN 'code' ELSE 'neutral' END AS intent FROM asked")
def query_intent(spark, sf):
    return asked(spark, sf).select("item_id", C.query_intent(F.col("q")).alias("intent"))


SIGNALS = f"""{ASKED}, sig AS (SELECT item_id, q, CASE WHEN {sql_any('lower(q)', C.QUERY_EXTENSIONS)} THEN 0.95 WHEN {' OR '.join(f"regexp_matches(q, '{p}')" for p in C.CODE_SHAPES)} THEN 0.85
 WHEN len(list_intersect(list_distinct(regexp_extract_all(q, '(\\w+)', 1)), [{', '.join(f"'{w}'" for w in C.CODE_WORDS)}])) >= 2 THEN 0.8 WHEN len(list_intersect(list_distinct(regexp_extract_all(q, '(\\w+)', 1)), [{', '.join(f"'{w}'" for w in C.CODE_WORDS)}])) = 1 THEN 0.6 END AS c,
 CASE WHEN regexp_matches(q, '\\b[A-Z]{{1,4}}-\\d{{4,6}}\\b') THEN 0.85 WHEN {sql_count('lower(q)', C.ERP_WORDS)} >= 2 THEN 0.7 WHEN {sql_count('lower(q)', C.ERP_WORDS)} = 1 THEN 0.55 END AS e FROM asked)"""


@register("route_query", "C2 C3 C4 X3", f"WITH {SIGNALS} SELECT item_id, CASE WHEN c IS NOT NULL AND e IS NULL THEN 'code' WHEN c IS NULL AND e IS NOT NULL THEN 'erp' WHEN c IS NULL THEN 'docs' WHEN abs(c - e) <= 0.1 OR c > e THEN 'code' ELSE 'erp' END AS route, CAST(CASE WHEN c IS NOT NULL AND e IS NULL THEN c WHEN c IS NULL AND e IS NOT NULL THEN e WHEN c IS NULL THEN 0.5 WHEN abs(c - e) <= 0.1 THEN greatest(c, 0.8) ELSE greatest(c, e) END AS DOUBLE) AS confidence FROM sig")
def route_query(spark, sf):
    r = C.route(F.col("q"))
    return asked(spark, sf).select("item_id", r["route"].alias("route"), r["confidence"].alias("confidence"))


@register("lookup_intent", "C6", f"WITH {ASKED}, n AS (SELECT item_id, {sql_count('lower(q)', C.LOOKUP_CODE)} AS c, {sql_count('lower(q)', C.LOOKUP_DOCS)} AS d FROM asked) SELECT item_id, CASE WHEN c > d THEN 'CODE_LOOKUP' WHEN d > c THEN 'CONCEPT_EXPLORATION' ELSE 'MIXED' END AS intent, round(CAST(CASE WHEN c = d THEN 0.5 ELSE least(0.5 + greatest(c, d) * 0.1, 0.85) END AS DOUBLE), 6) AS confidence FROM n")
def lookup_intent(spark, sf):
    r = C.lookup_intent(F.col("q"))
    return asked(spark, sf).select("item_id", r["intent"].alias("intent"), r["confidence"].alias("confidence"))


@register("tier_router", "C8 C16", f"""WITH {ASKED}, p AS (SELECT item_id, lower(q) AS q, (item_id % 10) / 10.0 AS conf, item_id % 5 AS spans, item_id % 13 AS syms, (item_id % 7) * 6000 AS ctx FROM asked)
SELECT item_id, CASE WHEN {sql_any('q', C.FORCED[0][1])} THEN 'local' WHEN {sql_any('q', C.FORCED[1][1])} THEN 'mid' WHEN {sql_any('q', C.FORCED[2][1])} THEN 'premium' WHEN {sql_any('q', C.VALIDATION)} THEN 'premium'
WHEN NOT (conf > 0.8 AND spans <= 3) AND (syms > 10 OR conf < 0.5) AND {sql_any('q', C.REASONING)} THEN 'premium' WHEN ctx > 32000 THEN 'premium' WHEN conf > 0.8 AND spans <= 3 THEN 'local' ELSE 'mid' END AS tier,
CASE WHEN {sql_any('q', C.RUN)} THEN 'run' WHEN {sql_any('q', C.WALK)} THEN 'walk' ELSE 'crawl' END AS tool_tier FROM p""")
def tier_router(spark, sf):
    i = F.col("item_id")
    return asked(spark, sf).select("item_id", C.tier(F.col("q"), i % 10 / 10.0, i % 5, i % 13, (i % 7) * 6000).alias("tier"), C.tool_tier(F.col("q")).alias("tool_tier"))


@register("slice_type", "C1 C13", f"""WITH {FILES} SELECT id, CASE WHEN path LIKE '%.json' AND regexp_matches(substr(text, 1, 2000), '(?i)["'']?(sku|upc|asin|model_number|product_id|catalog_ref)["'']?\\s*[:=]') THEN 'erp_product' WHEN path LIKE '%.py' OR path LIKE '%.ts' THEN 'code' WHEN path LIKE '%.json' THEN 'config' ELSE 'docs' END AS type,
CASE lang WHEN 'en' THEN 'code' WHEN 'de' THEN 'docs' WHEN 'fr' THEN 'erp_product' ELSE 'other' END AS alias FROM files""")
def slice_type(spark, sf):
    raw = F.when(F.col("lang") == "en", " Python").when(F.col("lang") == "de", "MD").when(F.col("lang") == "fr", "erp").otherwise("Other")
    return files(spark, sf).select("id", C.slice_type(F.col("path"), F.col("text"))["type"].alias("type"), C.slice_alias(raw).alias("alias"))


@register("summary_quality", "C9 A19", """WITH s AS (SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN '' WHEN 1 THEN ' ... ' WHEN 2 THEN '—' WHEN 3 THEN 'TODO later' WHEN 4 THEN '短い' WHEN 5 THEN '日本語のとても長い要約文です' WHEN 6 THEN 'word' ELSE substr(text, 1, 40) END AS s FROM documents),
p AS (SELECT doc_id, s, trim(regexp_replace(s, '[\\s.,;:!?()\\[\\]{}"''`~…—–•。、《》，；：]+', ' ', 'g')) AS p FROM s),
c AS (SELECT doc_id, CASE WHEN trim(s) = '' THEN 'EMPTY' WHEN regexp_matches(lower(trim(s)), 'auto-summary generated offline|\\bplaceholder\\b|\\blorem\\b|\\btodo\\b|\\btbd\\b|\\bfake\\b|^\\s*(-|—|\\.\\.\\.|\\*\\*\\*)\\s*$') THEN 'PLACEHOLDER' WHEN p = '' THEN 'EMPTY'
 WHEN regexp_matches(p, '[一-鿿぀-ヿ가-힯]') THEN CASE WHEN length(p) >= 10 THEN 'OK' ELSE 'SHORT' END WHEN len(regexp_extract_all(p, '([\\p{L}\\p{N}_]+)', 1)) >= 2 THEN 'OK' WHEN length(p) < 10 THEN 'SHORT' ELSE 'OK' END AS c FROM p) SELECT c AS quality, count(*) AS n, count(*) FILTER (WHERE c = 'OK') * 100.0 / sum(count(*)) OVER () AS ok_share FROM c GROUP BY c""")
def summary_quality(spark, sf):
    from pyspark.sql import Window as W

    d = table(spark, sf, "documents")
    cases = ["", " ... ", "—", "TODO later", "短い", "日本語のとても長い要約文です", "word"]
    s = F.substring("text", 1, 40)
    for i, x in enumerate(cases):
        s = F.when(F.col("doc_id") % 8 == i, x).otherwise(s)
    c = d.select(C.summary_quality(s).alias("quality")).groupBy("quality").agg(F.count("*").alias("n"))
    return c.select("quality", "n", (F.when(F.col("quality") == "OK", F.col("n")).otherwise(0) * 100.0 / F.sum("n").over(W.partitionBy())).alias("ok_share"))  # four rows


@register("query_complexity", "C14 C18", f"WITH {ASKED} SELECT item_id, CAST(least(least(item_id % 6, 4) + least({sql_count('lower(q)', C.RELATION)}, 3) + CASE WHEN {sql_any('lower(q)', C.MULTI_HOP)} THEN 2 ELSE 0 END + CASE WHEN len(list_filter(regexp_split_to_array(q, '\\s+'), lambda w: w <> '')) > 15 THEN 1 ELSE 0 END, 10) AS INTEGER) AS complexity, {sql_any('lower(q)', C.RELATION)} AS relational FROM asked")
def query_complexity(spark, sf):
    return asked(spark, sf).select("item_id", C.complexity(F.col("q"), (F.col("item_id") % 6).cast("int")).alias("complexity"), C.has_any(F.lower("q"), C.RELATION).alias("relational"))


@register("freshness_route", "C15", f"WITH {FILES} SELECT id, CASE WHEN id % 5 = 0 THEN 'UNKNOWN' WHEN id % 3 = 0 THEN 'FRESH' ELSE 'STALE' END AS state FROM files")
def freshness_route(spark, sf):
    h = F.col("file_hash")
    head = F.when(F.col("id") % 5 != 0, h)
    return files(spark, sf).select("id", C.freshness(head, F.when(F.col("id") % 3 == 0, h).otherwise(F.reverse(h))).alias("state"))


@register("entity_importance", "O10 O5 O11", f"WITH {NODES} SELECT id, CAST(CASE kind WHEN 'class' THEN 100 WHEN 'function' THEN 50 WHEN 'method' THEN 40 WHEN 'variable' THEN 10 ELSE 0 END + CASE WHEN contains(lower(string_split(name, '.')[-1]), 'test') THEN -10 ELSE 0 END + least((length(name) % 30) * 0.5, 50.0) + least((length(id) % 5) * 5, 50) + least(length(id), 20) AS DOUBLE) AS score FROM nodes")
def entity_importance(spark, sf):
    return nodes(spark, sf).select("id", S.importance(F.col("kind"), F.col("name"), F.length("name") % 30, F.length("id") % 5, F.length("id")).alias("score"))


@register("important_spans", "O3 O12", f"WITH {SPANS} SELECT id, file_id, CAST(n AS INTEGER) AS n FROM (SELECT id, file_id, row_number() OVER (PARTITION BY file_id ORDER BY CASE WHEN kind = 'module' THEN 1 WHEN kind = 'class' THEN 2 WHEN kind = 'function' AND NOT contains(symbol, '.') THEN 3 ELSE 4 END, start_line) AS n FROM spans) WHERE n <= 5")
def important_spans(spark, sf):
    from spanloom.operators.search import top

    r = F.when(F.col("kind") == "module", 1).when(F.col("kind") == "class", 2).when((F.col("kind") == "function") & ~F.col("symbol").contains("."), 3).otherwise(4)
    return top(spans(spark, sf), ["file_id"], 5, r, F.col("start_line")).select("id", "file_id", F.col("rank").alias("n"))


@register("symbol_resolution", "R24 R25 R26 G20", f"""WITH {NODES}, q(s) AS (VALUES ('FRANCE'), ('france'), ('5'), ('part')), m AS (SELECT s, id, kind, CASE WHEN name = s THEN 1.0 WHEN lower(name) = lower(s) THEN 0.9 WHEN ends_with(lower(name), '.' || lower(s)) THEN 0.7 WHEN contains(lower(name), lower(s)) THEN 0.5 END AS score FROM q, nodes)
SELECT s, id, CAST(score AS DOUBLE) AS score, CAST(n AS INTEGER) AS "rank" FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY score DESC, CASE kind WHEN 'class' THEN 10 WHEN 'function' THEN 8 WHEN 'method' THEN 7 WHEN 'variable' THEN 5 ELSE 0 END DESC, id) AS n FROM m WHERE score IS NOT NULL) WHERE n <= 5""")
def symbol_resolution(spark, sf):
    from spanloom.operators.search import top

    q = spark.createDataFrame([("FRANCE",), ("france",), ("5",), ("part",)], "s string")
    m = nodes(spark, sf).crossJoin(F.broadcast(q)).withColumn("score", S.match_score(F.col("s"), F.col("name"))).filter("score IS NOT NULL")  # four given symbols
    return top(m, ["s"], 5, F.desc("score"), F.desc(S.by_kind(F.col("kind"), S.PRIORITY)), F.col("id")).select("s", "id", "score", "rank")


@register("payload_validation", "C17 P1", "WITH p AS (SELECT doc_id, length(text) % 50 + 1 AS a, length(text) % 50 + doc_id % 30 AS b, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS w FROM documents) SELECT doc_id, CAST((CASE WHEN a BETWEEN 1 AND 60 AND b BETWEEN 1 AND 60 THEN 0 ELSE 1 END) + (CASE WHEN w > 120 THEN 1 ELSE 0 END) AS INTEGER) AS errors FROM p")
def payload_validation(spark, sf):
    from spanloom.operators.validate import enrichment_errors

    n = F.length("text") % 50
    js = F.to_json(F.struct(F.col("text").alias("summary_120w"), F.array(F.struct(F.lit("x").alias("field"), F.array((n + 1).cast("int"), (n + F.col("doc_id") % 30).cast("int")).alias("lines"))).alias("evidence")))
    d = table(spark, sf, "documents").select("doc_id", js.alias("payload"))
    return d.select("doc_id", F.size(enrichment_errors(F.col("payload"), F.lit(1), F.lit(60))).alias("errors"))
