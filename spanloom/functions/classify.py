"""Classifiers and routers as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.functions.paths import CODE, DOCS, basename, extension, is_test, stem

# Word lists, patterns and constants that classifications depend on.
INTENT_DOCS = ["how to", "guide", "tutorial", "explain", "overview", "what is"]
INTENT_CODE = ["function", "class", "def ", "import ", "return ", "async "]
QUERY_EXTENSIONS = [".py", ".ts", ".js", ".rs", ".go", ".c", ".cpp", ".h", ".tsx", ".jsx", ".vue", ".rb", ".java", ".kt", ".swift", ".cs", ".php", ".scala", ".lua", ".sh", ".bash", ".zsh"]
CODE_SHAPES = [
    r"(?:^|\n)\s*(def|async\s+def|class)\s+\w+", r"(?:^|\n)\s*from\s+\w+", r"(?:^|\n)\s*import\s+\w+", r"(?:^|\n)\s*\w+\s*=\s*[^=\n]+",
    r"\bfor\s+\w+\s+in\s+[^:\n]+:?\s*", r"\bwhile\s+[^:\n]+:?\s*", r"\blambda\s+\w+\s*:\s*[^:\n]+", r"\b\w+\s*\([^()\n]*\)",
]
CODE_WORDS = [
    "if", "elif", "else", "for", "while", "return", "def", "class", "import", "from", "try", "except", "with", "lambda", "yield", "self", "cls", "print",
    "function", "var", "const", "let", "async", "await", "args", "kwargs", "dict", "list", "tuple", "int", "str", "bool", "None",
]
ERP_WORDS = ["sku", "upc", "asin", "model", "model number", "item", "product", "catalog", "inventory", "price", "stock", "order", "invoice", "po", "so"]
ERP_KEYS = r"(?i)[\"']?(?:sku|upc|asin|model_number|product_id|catalog_ref)[\"']?\s*[:=]"
LOOKUP_CODE = ["where is", "definition of", "function", "class", "method", "implemented", "implementation", "source code", "code for", ".py", ".ts", ".js", "def ", "async def"]
LOOKUP_DOCS = ["how to", "what is", "explain", "documentation", "guide", "tutorial", "example", "why", "configure", "setup"]
FORCED = [
    ("local", ["format", "add comments", "fix", "rename variable"]), ("mid", ["write tests", "generate test cases", "find bugs", "stress test"]),
    ("premium", ["design", "review security", "validate", "complex refactor"]),
]
REASONING = ["why", "how", "explain", "design", "architecture", "tradeoff", "should i", "compare", "evaluate"]
VALIDATION = ["validate", "review", "correct", "check my", "is this right", "am i doing this"]
RELATION = ["calls", "call", "calling", "invokes", "uses", "use", "using", "depends", "dependency", "reads", "read", "writes", "write", "inherits", "inherit", "extends", "extend", "returns", "return", "breaks", "break", "impacts", "impact", "which", "what", "where", "trace"]
MULTI_HOP = ["chain", "transitive", "indirect", "all", "complete"]
WALK = ["show me", "read", "view", "see", "look at", "contents of", "what's in", "open", "display", "print"]
RUN = ["edit", "change", "modify", "update", "fix", "add", "remove", "create", "write", "delete", "replace", "refactor"]
SLICE_TYPES = {
    "code": [".py", ".js", ".ts", ".tsx", ".jsx", ".c", ".h", ".cpp", ".hpp", ".java", ".go", ".rs", ".cs", ".php", ".rb", ".kt", ".swift"],
    "config": [".yml", ".yaml", ".toml", ".ini", ".cfg", ".json", ".xml"], "docs": [".md", ".rst", ".txt", ".adoc"], "data": [".csv", ".tsv"],
}
SLICE_ALIASES = {
    "python": "code", "javascript": "code", "typescript": "code", "java": "code", "rust": "code", "go": "code", "c": "code", "cpp": "code", "c++": "code", "markdown": "docs", "md": "docs",
    "rst": "docs", "text": "docs", "txt": "docs", "documentation": "docs", "erp": "erp_product", "product": "erp_product", "plan": "project_plan", "planning": "project_plan",
}
PLACEHOLDER = r"auto-summary generated offline|\bplaceholder\b|\blorem\b|\btodo\b|\btbd\b|\bfake\b|^\s*(?:-|—|\.\.\.|\*\*\*)\s*$"
STRIPPED = r"[\s.,;:!?()\[\]{}\"'`~…—–•。、《》，；：]+"
CJK = r"[一-鿿぀-ヿ가-힯]"
LOG_LINE = r"^(?:\d{4}[-/]\d{2}[-/]\d{2}|\[?(?:ERROR|WARN|INFO|DEBUG)\]?|\w{3}\s+\d{1,2}\s+\d{2}:\d{2})"
SNIFFED = {".py": "code/python", ".js": "code/javascript", ".ts": "code/typescript", ".json": "json", ".yaml": "yaml", ".yml": "yaml", ".toml": "toml", ".md": "markdown", ".log": "log", ".csv": "tabular", ".tsv": "tabular", ".sql": "code/sql", ".sh": "code/shell", ".rs": "code/rust", ".go": "code/go", ".java": "code/java"}
DEFINITION = [r"^\s*(?:def|class|function|const|let|var|type|interface)\s+", r"^\s*\w+\s*[=:]\s*(?:function|async|class|\()", r"^\s*export\s+(?:default\s+)?(?:function|class|const|let|var)"]


def has_any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def count_of(text: Column, words: list[str]) -> Column:
    """How many of the words a text contains."""
    return reduce(lambda a, b: a + b, [text.contains(w).cast("int") for w in words])


def query_intent(query: Column) -> Column:
    """docs, code or neutral."""
    q = F.lower(query)
    words = F.split(query, r"\s+")
    codelike = lambda w: (w.contains("_") & ~w.startswith("_") & ~w.endswith("_")) | (w.rlike(r"\p{Lu}") & w.rlike(r"\p{Ll}"))
    return F.when(has_any(q, INTENT_DOCS), "docs").when(has_any(q, CODE) | has_any(q, INTENT_CODE) | F.exists(words, codelike), "code").otherwise("neutral")


def extension_score(path: Column, intent: Column) -> Column:
    e = extension(path)
    code = F.when(intent == "docs", -0.05).when(intent == "code", 0.15 * 1.5).otherwise(0.15)
    docs = F.when(intent == "docs", 0.10).when(intent == "code", -0.12 * 1.5).otherwise(-0.12)
    return F.when(F.lower(path).contains("test"), -0.10).when(e.isin(*CODE), code).when(e.isin(*DOCS), docs).otherwise(0.0)


def extension_weight(path: Column) -> Column:
    e = extension(path)
    return F.when(F.lower(path).contains("test"), 0.2).when(e.isin(*CODE), 1.0).when(e.isin(*DOCS), 0.3).otherwise(0.7)


def filename_score(query: Column, path: Column) -> Column:
    q, b = F.lower(F.trim(query)), F.lower(basename(path))
    return F.when(query == "", 0.0).when(q == b, 0.35).when(q == F.lower(stem(path)), 0.30).when(F.contains(b, q), 0.08).otherwise(0.0)


def fenced(text: Column) -> Column:
    """Whether a text has a paired fence of code."""
    return text.rlike(r"(?s)(?:^|[\s:,(){}\[\]])```[\w-]*\s*\n.*?```")


def code_signal(text: Column) -> Column:
    words = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(\w+)"), F.lit(1)))
    n = F.size(F.array_intersect(words, F.array(*map(F.lit, CODE_WORDS))))
    shaped = reduce(lambda a, b: a | b, [text.rlike(p) for p in CODE_SHAPES])
    return F.when(has_any(F.lower(text), QUERY_EXTENSIONS) | fenced(text), 0.95).when(shaped, 0.85).when(n >= 2, 0.8).when(n == 1, 0.6)


def erp_signal(text: Column) -> Column:
    n = count_of(F.lower(text), ERP_WORDS)
    return F.when(text.rlike(r"\b[A-Z]{1,4}-\d{4,6}\b"), 0.85).when(n >= 2, 0.70).when(n == 1, 0.55)


def route(text: Column, tool: Column | None = None, prefer_code: bool = True, margin: float = 0.1) -> Column:
    """Struct (route, confidence): tool hint first, then the stronger of both signals, code in a near tie."""
    t = F.coalesce(text, F.lit(""))
    c, e = code_signal(t), erp_signal(t)
    near = F.abs(c - e) <= margin + 1e-12
    s = lambda r, v: F.struct(F.lit(r).alias("route"), v.cast("double").alias("confidence"))
    best = F.greatest(c if prefer_code else e, F.lit(0.8))
    out = F.when(F.trim(t) == "", s("docs", F.lit(0.2)))
    if tool is not None:
        h = F.lower(tool)
        out = out.when(has_any(h, ["code", "refactor", "analyze"]), s("code", F.lit(1.0))).when(has_any(h, ["erp", "product", "lookup"]), s("erp", F.lit(1.0)))
    return (
        out.when(c.isNotNull() & e.isNull(), s("code", c)).when(c.isNull() & e.isNotNull(), s("erp", e)).when(c.isNull() & e.isNull(), s("docs", F.lit(0.5)))
        .when(near, s("code" if prefer_code else "erp", best)).when(c > e, s("code", c)).otherwise(s("erp", e))
    )


def lookup_intent(query: Column) -> Column:
    q = F.lower(query)
    c, d = count_of(q, LOOKUP_CODE), count_of(q, LOOKUP_DOCS)
    s = lambda r, v: F.struct(F.lit(r).alias("intent"), F.round(v, 6).alias("confidence"))
    conf = lambda n: F.least(0.5 + n * 0.1, F.lit(0.85))
    return F.when(c > d, s("CODE_LOOKUP", conf(c))).when(d > c, s("CONCEPT_EXPLORATION", conf(d))).otherwise(s("MIXED", F.lit(0.5)))


def forced_tier(query: Column) -> Column:
    q, out = F.lower(query), F.lit(None).cast("string")
    for tier, words in reversed(FORCED):
        out = F.when(has_any(q, words), tier).otherwise(out)
    return out


def tier(query: Column, confidence: Column, n_spans: Column, n_symbols: Column, context: Column) -> Column:
    """local, mid or premium: a forced pattern, or what the plan's confidence, size and the query's words ask for."""
    q = F.lower(query)
    simple, hard = (confidence > 0.8) & (n_spans <= 3), (n_symbols > 10) | (confidence < 0.5)
    complexity = F.when(simple, "simple").when(hard, "complex").otherwise("medium")
    premium = has_any(q, VALIDATION) | ((complexity == "complex") & has_any(q, REASONING)) | (context > 32000)
    local = (complexity == "simple") & ((confidence > 0.8) | ~((n_spans > 0) & (confidence > 0.6)))
    return F.coalesce(forced_tier(query), F.when(premium, "premium").when(local, "local").otherwise("mid"))


def tool_tier(prompt: Column) -> Column:
    p = F.lower(prompt)
    return F.when(has_any(p, RUN), "run").when(has_any(p, WALK), "walk").otherwise("crawl")


def slice_type(path: Column, text: Column) -> Column:
    """Struct (type, confidence)."""
    e = extension(path)
    erp_path = F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, ["erp", "pim", "products", "catalog"])))
    erp_keys = e.isin(".json", ".yaml", ".yml", ".csv", ".xml") & F.substring(text, 1, 2000).rlike(ERP_KEYS)
    shebang = F.substring_index(text, "\n", 1).rlike(r"^#!.*(?:python|bash|sh|node)")
    s = lambda t, c: F.struct(F.lit(t).alias("type"), F.lit(c).alias("confidence"))
    out = F.when(erp_path & erp_keys, s("erp_product", 1.0)).when(erp_path | erp_keys, s("erp_product", 0.8)).when(shebang, s("code", 1.0))
    for name, exts in SLICE_TYPES.items():
        out = out.when(e.isin(*exts), s(name, 1.0))
    return out.otherwise(s("other", 0.0))


def slice_alias(kind: Column) -> Column:
    k = F.lower(F.trim(F.coalesce(kind, F.lit(""))))
    return F.when(k == "", "unknown").otherwise(F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in SLICE_ALIASES.items() for x in kv]), k), k))


def summary_quality(summary: Column) -> Column:
    """OK, SHORT, PLACEHOLDER or EMPTY."""
    t = F.coalesce(summary, F.lit(""))
    plain = F.trim(F.regexp_replace(t, STRIPPED, " "))
    n = F.size(F.regexp_extract_all(plain, F.lit(r"(?U)(\w+)"), F.lit(1)))
    return (
        F.when(t.rlike(r"^\s*$"), "EMPTY").when(F.lower(F.trim(t)).rlike(PLACEHOLDER), "PLACEHOLDER").when(plain == "", "EMPTY")
        .when(plain.rlike(CJK), F.when(F.length(plain) >= 10, "OK").otherwise("SHORT")).when(n >= 2, "OK").when(F.length(plain) < 10, "SHORT").otherwise("OK")
    )


def sniff(path: Column, sample: Column) -> Column:
    lines = F.slice(F.split(sample, "\n"), 1, 5)
    logs = F.size(F.filter(lines, lambda x: x.rlike(LOG_LINE)))
    t = F.trim(sample)
    known = F.element_at(F.create_map(*[F.lit(x) for kv in SNIFFED.items() for x in kv]), extension(path))
    js = (t.startswith("{") | t.startswith("[")) & (t.endswith("}") | t.endswith("]"))
    return F.coalesce(known, F.when(logs >= 2, "log").when(js, "json").otherwise("text"))


def is_definition(line: Column) -> Column:
    return reduce(lambda a, b: a | b, [line.rlike(p) for p in DEFINITION])


def match_class(line: Column, path: Column) -> Column:
    """0 for a definition outside tests, 1 for another line outside tests, 2 for a definition in a test, else 3."""
    return F.when(is_test(path), F.when(is_definition(line), 2).otherwise(3)).otherwise(F.when(is_definition(line), 0).otherwise(1))


def complexity(query: Column, n_entities: Column) -> Column:
    """0 to 10 by entities, relation words, hints at several hops, and length."""
    q = F.lower(query)
    score = F.least(n_entities, F.lit(4)) + F.least(count_of(q, RELATION), F.lit(3)) + F.when(has_any(q, MULTI_HOP), 2).otherwise(0)
    return F.least(score + F.when(F.size(F.filter(F.split(query, r"\s+"), lambda w: w != "")) > 15, 1).otherwise(0), F.lit(10))


def freshness(head: Column, indexed: Column) -> Column:
    return F.when(head.isNull() | indexed.isNull(), "UNKNOWN").when(head == indexed, "FRESH").otherwise("STALE")


def match_order(nodes, symbol: str):
    """Nodes (id, name, kind, path) that match a symbol, best first, with their score."""
    from spanloom.functions.symbols import PRIORITY, by_kind, match_score

    m = nodes.withColumn("score", match_score(F.lit(symbol), F.col("name"))).filter("score IS NOT NULL")
    return m.orderBy(F.desc("score"), F.desc(by_kind(F.col("kind"), PRIORITY)), "id")
