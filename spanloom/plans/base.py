"""The supplied tables seen as the engine's data model: files, spans, enrichments, graph, telemetry, queue.

Each view exists twice: as a DataFrame and as a DuckDB common table expression for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.runtime import table

EXT = {"en": ".py", "de": ".ts", "fr": ".md"}


def files(spark: SparkSession, sf: str) -> DataFrame:
    """(id, path, lang, file_hash, size, mtime, text)"""
    d = table(spark, sf, "documents")
    ext = F.lit(".json")
    for k, v in EXT.items():
        ext = F.when(F.col("lang") == k, v).otherwise(ext)
    path = F.concat("source", F.lit("/"), "lang", F.lit("/doc"), "doc_id", ext)
    return d.select(F.col("doc_id").alias("id"), path.alias("path"), "lang", F.sha2("text", 256).alias("file_hash"), F.col("n_chars").alias("size"), (F.col("doc_id") % 100000).cast("double").alias("mtime"), "text")


FILES = """files AS (SELECT doc_id AS id, source || '/' || lang || '/doc' || doc_id || CASE lang WHEN 'en' THEN '.py' WHEN 'de' THEN '.ts' WHEN 'fr' THEN '.md' ELSE '.json' END AS path,
 lang, sha256(text) AS file_hash, n_chars AS size, CAST(doc_id % 100000 AS DOUBLE) AS mtime, text FROM documents)"""

KINDS = ("function", "class", "method", "module")


def spans(spark: SparkSession, sf: str) -> DataFrame:
    """(id, file_id, pos, symbol, kind, start_line, end_line, lang, span_hash, text): a span per line of a document."""
    f = files(spark, sf).select(F.col("id").alias("file_id"), "lang", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    word = F.regexp_extract(F.lower("text"), "([a-z]+)", 1)
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("pos") % 4 + 1)
    return f.select(
        (F.col("file_id") * 100000 + F.col("pos")).alias("id"), "file_id", "pos", F.concat(F.lit("mod"), F.col("file_id") % 7, F.lit("."), word).alias("symbol"), kind.alias("kind"),
        (F.col("pos") * 3 + 1).alias("start_line"), (F.col("pos") * 3 + 3).alias("end_line"), "lang", span_hash(F.col("lang"), F.col("text")).alias("span_hash"), "text",
    )


def span_hash(lang: Column, text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.concat(lang, F.lit("\0"), text), 256))


SPANS = FILES + """, lines AS (SELECT id AS file_id, lang, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM files),
spans AS (SELECT file_id * 100000 + pos AS id, file_id, CAST(pos AS INTEGER) AS pos, 'mod' || (file_id % 7) || '.' || regexp_extract(lower(text), '([a-z]+)', 1) AS symbol,
 ['function', 'class', 'method', 'module'][pos % 4 + 1] AS kind, CAST(pos * 3 + 1 AS INTEGER) AS start_line, CAST(pos * 3 + 3 AS INTEGER) AS end_line, lang,
 'sha256:' || sha256(lang || chr(0) || text) AS span_hash, text FROM lines)"""


def enrichments(spark: SparkSession, sf: str) -> DataFrame:
    """(span_hash, summary, model, quality): one for the first span of each labelled document."""
    s = spans(spark, sf).filter("pos = 0").join(table(spark, sf, "labels"), F.col("file_id") == F.col("doc_id"))
    return s.groupBy("span_hash").agg(F.min(F.substring("text", 1, 200)).alias("summary"), F.concat(F.lit("model"), F.min(F.col("doc_id") % 3)).alias("model"), F.max("quality").alias("quality"))


ENR = SPANS + """, enrichments AS (SELECT span_hash, min(substr(text, 1, 200)) AS summary, 'model' || min(doc_id % 3) AS model, max(quality) AS quality
 FROM spans JOIN labels ON file_id = doc_id WHERE pos = 0 GROUP BY span_hash)"""


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    """(id, name, kind, path): regions, nations, suppliers, customers and parts as entities of files."""
    t = lambda n: table(spark, sf, n)
    out = None
    for name, kind, key, label in (("region", "module", "r_regionkey", "r_name"), ("nation", "class", "n_nationkey", "n_name"), ("supplier", "function", "s_suppkey", "s_name"), ("customer", "method", "c_custkey", "c_name"), ("part", "variable", "p_partkey", "p_name")):
        k = F.col(key).cast("long")
        x = t(name).select(F.concat(F.lit(name[0] + ":"), k).alias("id"), F.col(label).alias("name"), F.lit(kind).alias("kind"), F.concat(F.lit(name + "/f"), k % 40, F.lit(".py")).alias("path"))
        out = x if out is None else out.unionByName(x)
    return out


NODES = """nodes AS (SELECT 'r:' || r_regionkey AS id, r_name AS name, 'module' AS kind, 'region/f' || (r_regionkey % 40) || '.py' AS path FROM region
 UNION ALL SELECT 'n:' || n_nationkey, n_name, 'class', 'nation/f' || (n_nationkey % 40) || '.py' FROM nation
 UNION ALL SELECT 's:' || s_suppkey, s_name, 'function', 'supplier/f' || (s_suppkey % 40) || '.py' FROM supplier
 UNION ALL SELECT 'c:' || c_custkey, c_name, 'method', 'customer/f' || (c_custkey % 40) || '.py' FROM customer
 UNION ALL SELECT 'p:' || p_partkey, p_name, 'variable', 'part/f' || (p_partkey % 40) || '.py' FROM part)"""


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """(src, dst, type), distinct."""
    t = lambda n: table(spark, sf, n)
    tag = lambda p, c: F.concat(F.lit(p + ":"), F.col(c).cast("long"))
    e = t("nation").select(tag("n", "n_nationkey").alias("src"), tag("r", "n_regionkey").alias("dst"), F.lit("EXTENDS").alias("type"))
    e = e.unionByName(t("supplier").select(tag("s", "s_suppkey").alias("src"), tag("n", "s_nationkey").alias("dst"), F.lit("IMPORTS").alias("type")))
    e = e.unionByName(t("customer").select(tag("c", "c_custkey").alias("src"), tag("n", "c_nationkey").alias("dst"), F.lit("USES").alias("type")))
    calls = t("lineitem").select(F.col("l_partkey").cast("long"), F.col("l_suppkey").cast("long")).distinct()  # numbers, before they become names
    return e.unionByName(calls.select(tag("p", "l_partkey").alias("src"), tag("s", "l_suppkey").alias("dst"), F.lit("CALLS").alias("type")))


EDGES = """edges AS (SELECT 'n:' || n_nationkey AS src, 'r:' || n_regionkey AS dst, 'EXTENDS' AS type FROM nation
 UNION ALL SELECT 's:' || s_suppkey, 'n:' || s_nationkey, 'IMPORTS' FROM supplier
 UNION ALL SELECT 'c:' || c_custkey, 'n:' || c_nationkey, 'USES' FROM customer
 UNION ALL SELECT DISTINCT 'p:' || l_partkey, 's:' || l_suppkey, 'CALLS' FROM lineitem)"""


def telemetry(spark: SparkSession, sf: str) -> DataFrame:
    """(id, ts, agent, cmd, mode, latency_ms, size, ok, k)"""
    e = table(spark, sf, "events")
    mode = F.when(F.col("event_type").isin("view", "click"), "enriched").when(F.col("event_type") == "error", "passthrough").otherwise("raw")
    return e.select(
        F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("agent"), F.col("event_type").alias("cmd"), mode.alias("mode"), F.col("value").alias("latency_ms"),
        F.length("props").alias("size"), (F.col("event_type") != "error").alias("ok"), F.get_json_object("props", "$.k").cast("long").alias("k"), "props",
    )


TELE = """tele AS (SELECT event_id AS id, ts, user_id AS agent, event_type AS cmd, CASE WHEN event_type IN ('view', 'click') THEN 'enriched' WHEN event_type = 'error' THEN 'passthrough' ELSE 'raw' END AS mode,
 value AS latency_ms, CAST(length(props) AS INTEGER) AS size, event_type <> 'error' AS ok, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, props FROM events)"""


def queue(spark: SparkSession, sf: str) -> DataFrame:
    """(id, repo, span, priority, created, claimed_by, attempts, tier)"""
    t = telemetry(spark, sf)
    return t.select("id", F.concat(F.lit("repo"), F.col("agent") % 5).alias("repo"), (F.col("id") % 997).alias("span"), F.when(F.col("cmd") == "purchase", 3).when(F.col("cmd") == "view", 7).otherwise(5).alias("priority"), F.col("ts").alias("created"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("w"), F.col("agent") % 4)).alias("claimed_by"), (F.col("id") % 4).alias("attempts"), (F.col("id") % 3).alias("tier"), "ok")


QUEUE = TELE + """, queue AS (SELECT id, 'repo' || (agent % 5) AS repo, id % 997 AS span, CASE cmd WHEN 'purchase' THEN 3 WHEN 'view' THEN 7 ELSE 5 END AS priority, ts AS created,
 CASE WHEN id % 3 = 0 THEN 'w' || (agent % 4) END AS claimed_by, id % 4 AS attempts, id % 3 AS tier, ok FROM tele)"""


#: The instant that time filters count back from.
AS_OF = "2024-01-30 00:00:00"
