"""Plans of work for models, what is attached to results, and training examples of tool calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.operators.search import top

# What a model is asked for.
CONTRACT = {
    "schema_version": "enrichment.v1",
    "fields": ["summary_120w", "inputs", "outputs", "side_effects", "pitfalls", "usage_snippet", "evidence"],
    "word_caps": {"summary_120w": 120, "usage_snippet": 12},
    "instructions": "Return ONLY valid JSON per schema. Cite exact line ranges for every claim. If unsure, use null.",
}
#: Fixed value: characters of a span that a plan shows.
SNIPPET_CHARS = 800
#: The vector indexes.
INDEXES = ["embeddings", "emb_code"]


def shortened(text: Column, most: int) -> Column:
    """A text of at most ``most`` characters; a longer one ends in an ellipsis."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def pending(spans: DataFrame, done: DataFrame, now: float, cooldown: float, limit: int) -> DataFrame:
    """Spans (id, path, span_hash, mtime, ...) without an enrichment (span_hash), the first ``limit`` by id: one a hash, the first; those of files touched within the cooldown wait.

    A null mtime counts as 0. The first span of a hash decides whether the hash waits.
    """
    few = [c for c in spans.columns if c not in ("span_hash", "id")]
    p = spans.join(done.select("span_hash"), "span_hash", "left_anti").groupBy("span_hash").agg(F.min(F.struct("id", *few)).alias("x")).select("span_hash", "x.*")
    if cooldown:
        p = p.filter(F.lit(float(now)) - F.coalesce("mtime", F.lit(0.0)) >= cooldown)
    return p.orderBy("id").limit(limit)


def plan(spans: DataFrame, texts: DataFrame, done: DataFrame, ignored: Column, now: float, cooldown: float = 0, limit: int = 10, chars: int = SNIPPET_CHARS) -> tuple[DataFrame, DataFrame]:
    """(plan, missing): rows (span_hash, path, lang, lines, code_snippet, content_type, llm_contract) to send to a model, and the paths (path) of pending spans whose file is gone.

    spans (id, path, span_hash, mtime, lang, kind, start_line, end_line); texts (path, text) are the files that exist, read by line. Ignored paths are left out
    silently, and are not missing; both take part in the limit.
    """
    p = pending(spans.select("id", "path", "span_hash", "mtime", "lang", "kind", "start_line", "end_line"), done, now, cooldown, limit).filter(~F.coalesce(ignored, F.lit(False)))
    t = p.join(texts.select("path", F.coalesce("text", F.lit("")).alias("text")), "path", "left")
    code = F.array_join(F.slice(F.split("text", "\n"), F.greatest("start_line", F.lit(1)), F.greatest(F.col("end_line") - F.greatest("start_line", F.lit(1)) + 1, F.lit(0))), "\n")
    contract = F.struct(
        F.lit(CONTRACT["schema_version"]).alias("schema_version"), F.array(*map(F.lit, CONTRACT["fields"])).alias("fields"),
        F.struct(*[F.lit(v).alias(k) for k, v in CONTRACT["word_caps"].items()]).alias("word_caps"), F.lit(CONTRACT["instructions"]).alias("instructions"),
    )
    rows = t.filter("text IS NOT NULL").select(
        "id", "span_hash", "path", "lang", F.array("start_line", "end_line").alias("lines"), shortened(code, chars).alias("code_snippet"), F.coalesce("kind", F.lit("other")).alias("content_type"), contract.alias("llm_contract"),
    )
    return rows, t.filter("text IS NULL").select("path").distinct()


def attached(items: DataFrame, snippets: DataFrame, limit: int = 1, chars: int | None = None) -> DataFrame:
    """Items (item, path, line, span_hash) and their enrichments: (item, strategy, n, summary, truncated), a row per snippet.

    Snippets (span_hash, path, line, summary) are looked up by hash, then by path and line, then by path; the first way that finds any is taken, and of it the first ``limit`` by
    line and summary. Items that nothing fits have no row, null keys fit nothing. Longer summaries end in an ellipsis.
    """
    keyed = [("span", 0, ["span_hash"]), ("line", 1, ["path", "line"]), ("path", 2, ["path"])]
    found = None
    for name, at, keys in keyed:
        known = snippets.dropna(subset=keys)
        # what no item can use leaves before the join: no key brings more than ``limit`` rows
        best = top(known.select("span_hash", "path", "line", "summary"), keys, limit, F.col("line"), F.col("summary"), F.col("span_hash")).select(*keys, "rank", "summary")
        f = items.select("item", *keys).join(best, keys).select("item", F.lit(at).alias("_at"), F.lit(name).alias("strategy"), "rank", "summary")
        found = f if found is None else found.unionByName(f)
    first = found.groupBy("item").agg(F.min("_at").alias("_at"))
    r = found.join(first, ["item", "_at"])
    cut = F.length("summary") > chars if chars else F.lit(False)
    return r.select("item", "strategy", F.col("rank").alias("n"), (shortened(F.col("summary"), chars) if chars else F.col("summary")).alias("summary"), F.coalesce(cut, F.lit(False)).alias("truncated"))


def who(symbols: DataFrame, edges: DataFrame, limit: int = 10, sides: tuple = (("CALLED BY", "CALLS", "in"), ("CALLS", "CALLS", "out"), ("IMPORTED BY", "IMPORTS", "in"), ("IMPORTS", "IMPORTS", "out"))) -> DataFrame:
    """(id, title, n, first) of symbols (id): how many edges (src, dst, type) of a kind come in or go out, and the first ``limit`` others, joined by commas; a side without edges has 0 and null."""
    asked = symbols.select("id").distinct()
    parts = []
    for title, kind, way in sides:
        here, there = ("dst", "src") if way == "in" else ("src", "dst")
        parts.append(edges.filter(F.col("type") == kind).select(F.col(here).alias("id"), F.col(there).alias("other"), F.lit(title).alias("title")))
    e = parts[0]
    for p in parts[1:]:
        e = e.unionByName(p)
    e = e.join(asked, "id", "left_semi")
    n = e.groupBy("id", "title").agg(F.count("*").alias("n"))
    few = top(e, ["id", "title"], limit, F.col("other")).groupBy("id", "title").agg(F.array_join(F.array_sort(F.collect_list("other")), ",").alias("first"))
    titles = F.explode(F.array(*[F.lit(t) for t, _, _ in sides])).alias("title")
    return asked.select("id", titles).join(n, ["id", "title"], "left").join(few, ["id", "title"], "left").select("id", "title", F.coalesce("n", F.lit(0)).alias("n"), "first")


def index_name(base: str, repo: Column, sharing: str, suffix: str = "") -> Column:
    """The name of an index: shared, or one per repository."""
    return F.lit(base) if sharing == "shared" else F.concat(F.lit(f"{base}_"), repo, F.lit(suffix))


def upsert_vectors(old: DataFrame, new: DataFrame, indexes: list[str] = INDEXES) -> DataFrame:
    """Vectors (index_name, span_hash, vector, route, profile): new ones replace those of the same index and hash. A name that is no index fails."""
    known = F.when(F.col("index_name").isin(*indexes), F.col("index_name")).otherwise(F.raise_error(F.concat(F.lit("no such index: "), F.coalesce("index_name", F.lit("null")))))
    n = new.withColumn("index_name", known.cast("string"))
    return old.join(n.select("index_name", "span_hash").distinct(), ["index_name", "span_hash"], "left_anti").unionByName(n)


def vector_scan(vectors: DataFrame, spans: DataFrame, files: DataFrame, enrichments: DataFrame) -> DataFrame:
    """Vectors (span_hash, vector) with their spans (span_hash, file_id, symbol, kind, start_line, end_line, doc_hint), files (id, path) and the first of summary, hint and '' that is there."""
    s = vectors.join(spans, "span_hash").join(files.select(F.col("id").alias("file_id"), "path"), "file_id").join(enrichments.select("span_hash", F.col("summary").alias("_s")), "span_hash", "left")
    return s.select("span_hash", "symbol", "kind", "start_line", "end_line", "path", F.coalesce("_s", "doc_hint", F.lit("")).alias("summary"), "vector")


def tool_examples(calls: DataFrame) -> DataFrame:
    """(value): a line of JSON per call (tool, arguments map, query, output): messages of the user, of the assistant with the call, and of the tool."""
    call = F.concat(F.lit("call_"), F.substring(F.md5(F.concat_ws("\0", "tool", "query", F.to_json("arguments"), "output")), 1, 12))
    none = F.lit(None).cast("string")
    kind = "array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>"
    made = F.array(F.struct(call.alias("id"), F.lit("function").alias("type"), F.struct(F.col("tool").alias("name"), F.to_json("arguments").alias("arguments")).alias("function"))).cast(kind)
    m = lambda role, content, calls=None, ident=None, name=None: F.struct(F.lit(role).alias("role"), content.alias("content"), (F.lit(None).cast(kind) if calls is None else calls).alias("tool_calls"), (none if ident is None else ident).alias("tool_call_id"), (none if name is None else name).alias("name"))
    messages = F.array(m("user", F.col("query")), m("assistant", none, made), m("tool", F.col("output"), None, call, F.col("tool")))
    return calls.select(F.to_json(F.struct(messages.alias("messages"))).alias("value"))
